"""The reference registry: rule and prompt files, alias and hierarchy seeds, matching modes, provenance."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rules(spark: SparkSession, path: str) -> list[dict]:
    """Named patterns, each perhaps bound to sources: a small file in any store that Spark reads. A rule without a name or with a broken pattern raises."""
    rules = json.loads(spark.read.text(path, wholetext=True).first().value)
    for r in rules:
        if not r.get("name"):
            raise ValueError("a rule has no name")
        re.compile(r["pattern"])
    return rules


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_name, prompt_version, prompt_text) of files called <name>_v<number>.txt, the text byte for byte."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
    part = lambda k: F.regexp_extract("f", r"^(.*)_v([0-9]+)\.txt$", k)
    return raw.where(F.col("f").rlike(r"_v[0-9]+\.txt$")).select(part(1).alias("prompt_name"), part(2).cast("int").alias("prompt_version"), F.col("value").alias("prompt_text"))


def active_entries(entries: DataFrame, modes: list[str]) -> DataFrame:
    return entries.where(F.col("active") & F.col("match_mode").isin(modes))


def alias_seeds(named: DataFrame, objects: DataFrame, mode: str = "exact") -> DataFrame:
    """(object_id, alias, match_mode): aliases given by an object's canonical name, where an active object has it."""
    own = objects.where("active").select("object_id", "canonical_name")
    return named.join(own, "canonical_name").select("object_id", "alias", F.lit(mode).alias("match_mode")).distinct()


def shared_aliases(objects: DataFrame, aliases: list[str], mode: str = "exact") -> DataFrame:
    """Each of the objects with each of a short list of aliases: the product is made inside the row."""
    return objects.select("object_id", F.explode(F.array(*map(F.lit, aliases))).alias("alias"), F.lit(mode).alias("match_mode"))


def hierarchy(pairs: DataFrame, objects: DataFrame) -> DataFrame:
    """(child, parent): pairs of canonical names (child_name, parent_name) as object ids; names that no object has give no row."""
    side = lambda x: objects.select(F.col("canonical_name").alias(f"{x}_name"), F.col("object_id").alias(x))
    return pairs.join(side("child"), "child_name").join(side("parent"), "parent_name").select("child", "parent").distinct()


def closure(edges: DataFrame, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, ancestor, depth) over all levels of (child, parent); of several ways the shortest counts. Cycles end: a pair that is known is
    not followed again. stored writes a table and reads it back."""
    edges = stored(edges.select("child", "parent").distinct())
    found = level = stored(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    while True:
        longer = level.join(edges, level["ancestor"] == edges["child"]).select("node", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth")).distinct()
        level = stored(longer.join(found, ["node", "ancestor"], "left_anti"))
        if level.isEmpty():
            return found
        found = found.union(level)


def verified(rows: DataFrame, rules: list[tuple[Column, str, str | None]], on: str) -> DataFrame:
    """rows with verification_status, verified_on and source_note as the rules say, one after the other: (condition, status, new note or None)."""
    for condition, status, note in rules:
        hit = F.coalesce(condition, F.lit(False))
        # the condition sees the row as the rules before left it
        rows = rows.withColumn("_hit", hit).withColumn("verification_status", F.when(F.col("_hit"), status).otherwise(F.col("verification_status"))).withColumn("verified_on", F.when(F.col("_hit"), F.lit(on).cast("date")).otherwise(F.col("verified_on")))
        rows = rows.withColumn("source_note", F.when(F.col("_hit"), F.lit(note)).otherwise(F.col("source_note"))) if note is not None else rows
        rows = rows.drop("_hit")
    return rows


def semantic_references(entries: DataFrame, objects: DataFrame, vectors: DataFrame) -> DataFrame:
    """(reference_id, object_id, reference_text, canonical_name, embedding) of active entries that match by meaning and have a vector; entries without an object keep null."""
    found = active_entries(entries, ["semantic", "both"]).join(objects.select("object_id", "canonical_name"), "object_id", "left").join(vectors.select("reference_id", "embedding"), "reference_id")
    return found.select("reference_id", "object_id", "reference_text", "canonical_name", "embedding")
