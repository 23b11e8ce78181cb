"""Constraints as named violation counts. A null check is no violation, as in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, predicate: str) -> DataFrame:
    return df.select(F.lit(name).alias("name"), F.expr(f"NOT ({predicate})").alias("bad")).groupBy("name").agg(F.count_if(F.coalesce("bad", F.lit(False))).alias("violations"))


def unique(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; nulls are equal."""
    return df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("violations")).select(F.lit(name).alias("name"), "violations")


def foreign_key(child: DataFrame, parent: DataFrame, name: str, keys: list[str]) -> DataFrame:
    full = child.dropna(subset=keys)
    return full.join(parent.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")


# Predicates of the model's tables by name.
PREDICATES = {
    "status_iff_value": "(status = 'valid') = (value IS NOT NULL)",
    "summary_iff_positive": "(decision = positive) = (summary IS NOT NULL)",
    "referent_gate": "label NOT IN ('contradiction', 'same_fact', 'same_event') OR referent_status IS NULL OR (referent_status = 'confirmed' AND trim(evidence) <> '')",
    "anchor_shape": "(role = 'anchor') = (source_rank IS NULL)",
    "pair_order": "a < b",
    "span_arithmetic": "span_end = span_start + length(span)",
}
