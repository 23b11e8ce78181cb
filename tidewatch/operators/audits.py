"""Read-only audits of routing and contours: keyword hits, provenance splits, strata, prototype ablation, run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from .routing import hash_order, top_per_group


def keyword_hits(rows: DataFrame, title: Column, keywords: list[str]) -> DataFrame:
    """rows whose lower-cased title holds any keyword as a substring, with the matched ones in registry order."""
    lowered = F.lower(F.coalesce(title, F.lit("")))
    matched = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(lowered, k))
    return rows.withColumn("matched", matched).where(F.size("matched") > 0)


def with_flag(rows: DataFrame, key: str, holders: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean: does holders name the key? The existence test as a column."""
    named = holders.select(key).distinct().withColumn("_has", F.lit(True))
    return rows.join(named, key, "left").withColumn(flag, F.col("_has").isNotNull()).drop("_has")


def quadrants(rows: DataFrame, score: str, flag: str) -> DataFrame:
    """(quadrant, n): scores at or above the floor-rank p75 with and without the flag, and flagged ones under the median."""
    cuts = S.floor_ranks(rows, score, _hi=0.75, _mid=0.5)
    name = F.when((F.col(score) >= F.col("_hi")) & F.col(flag), "high_in").when(F.col(score) >= F.col("_hi"), "high_out").when((F.col(score) < F.col("_mid")) & F.col(flag), "low_in")
    return rows.crossJoin(F.broadcast(cuts)).select(name.alias("quadrant")).where("quadrant is not null").groupBy("quadrant").agg(F.count("*").alias("n"))


def distribution(rows: DataFrame, score: str, group: str) -> DataFrame:
    """(group, n, p10, p50, p90), linearly interpolated."""
    at = F.percentile(score, [0.1, 0.5, 0.9])
    return rows.groupBy(group).agg(F.count("*").alias("n"), at.alias("p")).select(group, "n", *[F.round(F.col("p")[i], 6).alias(f"p{x}") for i, x in enumerate((10, 50, 90))])


def stratified_sample(rows: DataFrame, key: str, score: str, flag: str, n: int, seed: int = 42) -> DataFrame:
    """(key, stratum, rank): n rows of each stratum in hash order. Strata of flagged rows: at most their q10, q45 to q55, at least q90; of others: at least their q90."""
    inside = rows.where(F.col(flag)).agg(F.percentile(score, [0.1, 0.45, 0.55, 0.9]).alias("_in"))
    outside = rows.where(~F.col(flag)).agg(F.percentile(score, 0.9).alias("_out"))
    v, q = F.col(score), F.col("_in")
    stratum = F.when(~F.col(flag), F.when(v >= F.col("_out"), "out_q90")).when(v <= q[0], "in_q10").when(v.between(q[1], q[2]), "in_mid").when(v >= q[3], "in_q90")
    placed = rows.crossJoin(F.broadcast(inside)).crossJoin(F.broadcast(outside)).select(key, stratum.alias("stratum")).where("stratum is not null")
    return top_per_group(placed, ["stratum"], [hash_order(key, seed), F.col(key)], n).select(key, "stratum", "rank")


def prototype_ablation(vectors: DataFrame, relevant: list, irrelevant: list, analyze: float = 0.10, skip: float = -0.07) -> DataFrame:
    """(dropped, n_changed, n_left_analyze): the decisions that change when one relevant prototype is left out. Each dot product is taken once; one narrow projection and one aggregation."""
    scored = vectors.select(S.dots(F.col("embedding"), [p for _, p in relevant]).alias("d"), S.best(F.col("embedding"), irrelevant)["score"].alias("irr"))
    margin = lambda best: F.round(best - F.col("irr"), 6)
    whole = scored.select("d", "irr", S.decide(margin(F.array_max("d")), analyze, skip).alias("old"))
    one_out = F.transform(F.sequence(F.lit(0), F.lit(len(relevant) - 1)), lambda i: F.array_max(F.filter("d", lambda _, j: j != i)))
    each = whole.select("old", "irr", F.posexplode(one_out).alias("i", "best")).withColumn("new", S.decide(margin(F.col("best")), analyze, skip))
    counted = each.groupBy("i").agg(F.count_if(F.col("new") != F.col("old")).alias("n_changed"), F.count_if((F.col("old") == "analyze") & (F.col("new") != "analyze")).alias("n_left_analyze"))
    return counted.select(F.lit([name for name, _ in relevant])[F.col("i")].alias("dropped"), "n_changed", "n_left_analyze")


def pool(exact: DataFrame, *pools: DataFrame, key: str = "content_id") -> DataFrame:
    """Distinct keys of any pool that exact lacks."""
    out = pools[0].select(key)
    for p in pools[1:]:
        out = out.union(p.select(key))
    return out.distinct().join(exact.select(key), key, "left_anti")


def run_report(verdicts: DataFrame, valid: Column) -> DataFrame:
    """One row (n, n_valid, pass_rate): the rate has three digits and is null where nothing ran."""
    counted = verdicts.agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"))
    return counted.withColumn("pass_rate", F.when(F.col("n") > 0, F.round(F.col("n_valid") / F.col("n"), 3)))


def report_lines(rows: DataFrame, *scores: str) -> DataFrame:
    """rows as JSON objects (column value), scores with four digits; nulls stay visible."""
    shown = [F.round(c, 4).alias(c) if c in scores else F.col(c) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("value"))


def matching_modes(aliases: DataFrame, objects: DataFrame) -> DataFrame:
    """aliases (object_id, alias, match_mode, ...) where an alias that is its object's canonical name matches in both modes."""
    named = objects.select("object_id", F.col("canonical_name").alias("alias"), F.lit("both").alias("_mode")).distinct()
    return aliases.join(named, ["object_id", "alias"], "left").withColumn("match_mode", F.coalesce("_mode", "match_mode")).select(*aliases.columns)


def renamed(rows: DataFrame, col: str, names: dict[str, str]) -> DataFrame:
    """rows with the mapped values of a column; others stay."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.withColumn(col, F.coalesce(pairs[F.col(col)], F.col(col)))
