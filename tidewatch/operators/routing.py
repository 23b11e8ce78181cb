"""Semantic routing against prototype registries, and its diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def route(vectors: DataFrame, relevant: list, irrelevant: list, analyze: float = 0.10, skip: float = -0.07) -> DataFrame:
    """vectors with rel, irr, margin and decision: one narrow projection."""
    scored = vectors.withColumn("rel", S.best(F.col("embedding"), relevant)["score"]).withColumn("irr", S.best(F.col("embedding"), irrelevant)["score"])
    margin = F.round(F.col("rel") - F.col("irr"), 6)
    return scored.withColumn("margin", margin).withColumn("decision", S.decide(F.col("margin"), analyze, skip))


def noise(vectors: DataFrame, prototypes: list) -> DataFrame:
    b = S.best(F.col("embedding"), prototypes)
    return vectors.withColumn("_b", b).withColumn("noise_score", F.round("_b.score", 6)).withColumn("category", F.col("_b.label")).drop("_b")


def transitions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Counts of (old decision, new decision), with zeroes; content without an old decision is its own label."""
    kinds = ["analyze", "maybe", "skip"]
    both = new.select(key, F.col("decision").alias("new")).join(old.select(key, F.col("decision").alias("old")), key, "left")
    return both.groupBy(F.coalesce("old", F.lit("NO_ROUTING_DECISION")).alias("old")).pivot("new", kinds).count().na.fill(0, kinds)


def terciles(df: DataFrame, col: str) -> DataFrame:
    """df with band by floor-rank cuts."""
    cuts = S.floor_ranks(df, col, _lo=1 / 3, _hi=2 / 3)
    band = F.when(F.col(col) < F.col("_lo"), "low").when(F.col(col) < F.col("_hi"), "mid").otherwise("high")
    return df.crossJoin(F.broadcast(cuts)).withColumn("band", band).drop("_lo", "_hi")


def top_per_group(df: DataFrame, group: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def placed(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """df with each row's place in its group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def listing(old: DataFrame, new: DataFrame, key: str, changes: list[tuple[str, str]]) -> DataFrame:
    """(key, old, new, margin, place) of the decisions that changed in one of the named ways, the highest new margin first in each."""
    both = new.select(key, F.col("decision").alias("new"), "margin").join(old.select(key, F.col("decision").alias("old")), key)
    kept = both.where(F.concat_ws(">", "old", "new").isin(*[f"{a}>{b}" for a, b in changes]))
    return placed(kept, ["old", "new"], [F.desc("margin"), F.col(key)], "place").select(key, "old", "new", "margin", "place")


def regression_cases(decisions: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, ok) for a short list of named cases; content without a decision is missing."""
    found = cases.join(decisions.select(key, "decision"), key, "left")
    actual = F.coalesce("decision", F.lit("missing"))
    return found.select(key, "expected", actual.alias("actual"), (actual == F.col("expected")).alias("ok"))


def hash_order(key: str, seed: int = 42) -> Column:
    """An order that depends on the key and the seed alone, and that other engines can repeat."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The same n rows for a seed, whatever the partitioning."""
    return df.orderBy(hash_order(key, seed), key).limit(n)
