"""Contour assignment: exact aliases of registered objects, deterministic rules, semantic facets, and diagnostics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def alias_hits(content: DataFrame, aliases: list[tuple[int, int, str]], col: str = "norm") -> DataFrame:
    """(content_id, object_id, reference_id, alias): for each object the hit with the smallest reference id.

    aliases is a bounded registry of (reference_id, object_id, alias). One alternation of all aliases keeps most
    content out in a single pass; what is left is matched alias by alias inside the row. No join, no shuffle.
    """
    quoted = "|".join(r"\Q" + a + r"\E" for _, _, a in aliases)
    near = content.where(F.col(col).rlike(rf"(?U)(?<!\w)(?:{quoted})(?!\w)"))
    tried = [F.when(F.col(col).rlike(r"(?U)(?<!\w)\Q" + a + r"\E(?!\w)"), F.struct(F.lit(o).cast("long").alias("object_id"), F.lit(r).cast("long").alias("reference_id"), F.lit(a).alias("alias"))) for r, o, a in sorted(aliases)]
    found = near.select("content_id", F.explode(F.filter(F.array(*tried), lambda x: x.isNotNull())).alias("h")).select("content_id", "h.*")
    return found.groupBy("content_id", "object_id").agg(F.min_by(F.struct("reference_id", "alias"), "reference_id").alias("m")).select("content_id", "object_id", "m.reference_id", "m.alias")


def rule_hits(content: DataFrame, rules: dict[str, list[str]], col: str = "norm") -> DataFrame:
    """(content_id, facet) for each facet of which any pattern matches."""
    matched = lambda ps: [F.col(col).rlike("(?iU)" + p) for p in ps]

    def any_of(ps: list[str]) -> Column:
        out, *rest = matched(ps)
        for m in rest:
            out = out | m
        return out

    labels = F.array(*[F.when(any_of(ps), F.lit(name)) for name, ps in rules.items()])
    return content.select("content_id", F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("facet"))


def facet_passes(content: DataFrame, facets: dict[str, list[str]], col: str = "norm") -> DataFrame:
    """content_id with a boolean for each facet: does any of its anchors match? One pass for all facets."""
    return content.select("content_id", *[F.col(col).rlike("(?U)" + "|".join(f"(?:{p})" for p in ps)).alias(f) for f, ps in facets.items()])


def assignments(content: DataFrame, aliases: list[tuple[int, int, str]], rules: dict[str, list[str]], contour_of: dict[str, int]) -> DataFrame:
    """(content_id, contour_id, facet, object_id, method): positives only, one row for each key."""
    exact = alias_hits(content, aliases).select("content_id", F.lit(1).alias("contour_id"), F.lit(None).cast("string").alias("facet"), "object_id", F.lit("alias").alias("method"))
    pairs = F.create_map(*[F.lit(x) for kv in contour_of.items() for x in kv])
    ruled = rule_hits(content, rules).select("content_id", pairs[F.col("facet")].alias("contour_id"), "facet", F.lit(None).cast("long").alias("object_id"), F.lit("rule").alias("method"))
    return exact.union(ruled)


def missing_facets(rules: DataFrame, registry: DataFrame) -> DataFrame:
    """(contour_id, facet) of rules that no active registry entry names: must be empty."""
    return rules.select("contour_id", "facet").exceptAll(registry.where("active").select("contour_id", "facet"))


def structural_hits(content: DataFrame, names: list[str], unit_terms: list[str], near: int = 80, col: str = "norm") -> DataFrame:
    """(content_id, name): the number that a registered name begins with, within near characters of a unit term, in either order. Names without a number find nothing."""
    units, gap = "(?:" + "|".join(unit_terms) + ")", f".{{0,{near}}}"
    tried = [F.when(F.col(col).rlike(rf"(?U)(?:(?<!\w){n}(?!\w){gap}{units}|{units}{gap}(?<!\w){n}(?!\w))"), F.lit(name)) for name in names if (n := number_of(name))]
    if not tried:
        return content.select("content_id", F.lit("").alias("name")).limit(0)
    return content.select("content_id", F.explode(F.filter(F.array(*tried), lambda x: x.isNotNull())).alias("name"))


def number_of(name: str) -> str:
    """The leading number of a registered name, '' without one: leading_number() for the registry's names on the driver."""
    m = re.match(r"\s*(\d{1,4})\b", name)
    return m[1] if m else ""


def leading_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*(\d{1,4})\b", 1)


def lexical_cues(content: DataFrame, cues: dict[str, str], col: str = "norm") -> DataFrame:
    """(content_id, labels): the labels of all cue patterns that match, in registry order; content without any has no row."""
    labels = F.filter(F.array(*[F.when(F.col(col).rlike("(?U)" + p), F.lit(name)) for name, p in cues.items()]), lambda x: x.isNotNull())
    return content.select("content_id", labels.alias("labels")).where(F.size("labels") > 0)


def recall_gap(content_ids: DataFrame, semantic: DataFrame, exact: DataFrame, lexical: DataFrame, structural: DataFrame, top: int = 120) -> DataFrame:
    """(content_id, signals, score, labels, names): content that exact matching lacks and a signal names, best first.

    Signals: lexical cues, structural hits, and being one of the top by semantic score (content_id, score) among content without an exact
    hit. Ranked by their number, then by score, -1 where there is none. All counts are bounded joins on content_id.
    """
    sure = exact.select("content_id").distinct()
    best = semantic.join(sure, "content_id", "left_anti").orderBy(F.desc("score"), F.desc("content_id")).limit(top).select("content_id", F.lit(1).alias("top"))
    named = structural.groupBy("content_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    out = content_ids.select("content_id").join(sure, "content_id", "left_anti")
    out = out.join(lexical.select("content_id", "labels"), "content_id", "left").join(named, "content_id", "left").join(best, "content_id", "left").join(semantic.select("content_id", "score"), "content_id", "left")
    signals = F.col("labels").isNotNull().cast("int") + F.col("names").isNotNull().cast("int") + F.coalesce("top", F.lit(0))
    none = F.array().cast("array<string>")
    found = out.withColumn("signals", signals).where("signals > 0")
    return found.select("content_id", "signals", F.coalesce("score", F.lit(-1.0)).alias("score"), F.coalesce("labels", none).alias("labels"), F.coalesce("names", none).alias("names")).orderBy(F.desc("signals"), F.desc("score"), F.desc("content_id"))


def without_embedding(anchored: DataFrame, vectors: DataFrame) -> DataFrame:
    """Anchored content that has no vector."""
    return anchored.select("content_id").distinct().join(vectors.select("content_id"), "content_id", "left_anti")


def threshold_grid(scored: DataFrame, col: str, flag: str, cuts: list[float]) -> DataFrame:
    """(cut, kept, dropped, outside): one pass for all cuts."""
    aggs = [F.struct(F.lit(c).alias("cut"), F.count_if((F.col(col) >= c) & F.col(flag)).alias("kept"), F.count_if((F.col(col) < c) & F.col(flag)).alias("dropped"), F.count_if((F.col(col) >= c) & ~F.col(flag)).alias("outside")) for c in cuts]
    return scored.agg(F.array(*aggs).alias("g")).select(F.explode("g").alias("g")).select("g.*")


def norm(content: DataFrame, title: Column | None = None) -> DataFrame:
    return content.withColumn("norm", T.norm_text(title if title is not None else F.lit(""), F.col("canonical_text")))
