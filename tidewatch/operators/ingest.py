"""Idempotent ingestion of deliveries: five outcomes, content by hash, occurrences by (source, reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 30


def outcomes(raw: DataFrame, known_occurrences: DataFrame | None = None, known_content: DataFrame | None = None) -> DataFrame:
    """raw with outcome: what a sequential pass by arrival would say. Arrivals are distinct.

    The first accepted delivery of a (source, reference), or the stored one, fixes its hash: later ones are
    dup_occurrence or changed_unprocessed. Of the first ones, the first of a new hash is new_content. Both are aggregations that
    combine before the shuffle, over hashes and arrivals alone; the deliveries themselves, with their texts, move once,
    to meet their reference's row, in a join whose hot keys Spark can split.
    """
    accepted = F.coalesce(F.length("canonical_text") >= MIN_LENGTH, F.lit(False))
    refs = raw.where(accepted).groupBy("source_id", "external_ref").agg(F.min("arrival").alias("_arrival"), F.min_by("content_hash", "arrival").alias("_hash"))
    if known_occurrences is not None:
        held = known_occurrences.select(F.col("source_id").alias("_s"), F.col("external_ref").alias("_r"), F.col("content_hash").alias("_stored"))
        refs = refs.join(held, F.col("source_id").eqNullSafe(F.col("_s")) & F.col("external_ref").eqNullSafe(F.col("_r")), "left").drop("_s", "_r")
    else:
        refs = refs.withColumn("_stored", F.lit(None).cast("string"))
    founders = refs.where("_stored is null").groupBy("_hash").agg(F.min("_arrival").alias("_arrival"), F.lit(True).alias("_new"))
    if known_content is not None:
        founders = founders.join(known_content.select(F.col("content_hash").alias("_hash")), "_hash", "left_anti")
    refs = refs.join(founders, ["_hash", "_arrival"], "left").withColumnsRenamed({"source_id": "_s", "external_ref": "_r"})
    df = raw.join(refs, F.col("source_id").eqNullSafe(F.col("_s")) & F.col("external_ref").eqNullSafe(F.col("_r")), "left")
    first = F.col("_stored").isNull() & (F.col("arrival") == F.col("_arrival"))
    outcome = (
        F.when(~accepted, "rejected")
        .when(~first, F.when(F.coalesce("_stored", "_hash") == F.col("content_hash"), "dup_occurrence").otherwise("changed_unprocessed"))
        .when(F.col("_new"), "new_content")
        .otherwise("new_occurrence")
    )
    return df.select(*[raw[c] for c in raw.columns], outcome.alias("outcome"))


def content_items(done: DataFrame) -> DataFrame:
    return done.where("outcome = 'new_content'").select(F.col("doc_id").alias("content_id"), "content_hash", "canonical_text", F.col("collected_at").alias("first_seen"))


def item_occurrences(done: DataFrame, content: DataFrame) -> DataFrame:
    new = done.where("outcome in ('new_content', 'new_occurrence')").select("source_id", "external_ref", "content_hash", "collected_at")
    return new.join(content.select("content_hash", "content_id"), "content_hash").select("source_id", "external_ref", "content_id", "content_hash", "collected_at")
