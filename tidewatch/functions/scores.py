"""Vector and statistical expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _products(prototypes: list[list[float]]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function of a column of vectors: (products with all prototypes, which rows are not null). One matrix product for an Arrow batch:
    about ten times as fast as sums over array expressions, which Spark evaluates boxed, element by element."""
    m = np.array(prototypes, np.float64).T

    def run(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        held = v.is_valid().to_numpy(zero_copy_only=False)
        rows = v.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(m))
        out = np.full((len(v), m.shape[1]), np.nan)
        out[held] = rows @ m
        return out, held

    return run


def dots(v: Column, prototypes: list[list[float]]) -> Column:
    """The products of a vector with each of a short list, as an array; null of a null vector. A vector of another dimension fails the job."""
    products, n = _products(prototypes), len(prototypes)

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        found, held = products(vectors)
        return pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), n, mask=pa.array(~held)).cast(pa.list_(pa.float64()))

    return run(v)


def best(v: Column, prototypes: list[tuple[str, list[float]]]) -> Column:
    """struct(score, label) of the best prototype; the first one wins ties. The prototypes are a small registry that goes along with the function: no join, no shuffle."""
    products, labels = _products([p for _, p in prototypes]), np.array([label for label, _ in prototypes], object)

    @F.arrow_udf("score double, label string")
    def run(vectors: pa.Array) -> pa.Array:
        found, held = products(vectors)
        at = np.where(held, np.nan_to_num(found, nan=-np.inf).argmax(axis=1), 0)
        return pa.StructArray.from_arrays([pa.array(found[np.arange(len(at)), at], pa.float64(), mask=~held), pa.array(labels[at], pa.string(), mask=~held)], names=["score", "label"])

    return run(v)


def decide(margin: Column, analyze: float = 0.10, skip: float = -0.07) -> Column:
    return F.when(margin >= analyze, "analyze").when(margin <= skip, "skip").otherwise("maybe")


def floor_ranks(df: DataFrame, c: str, /, **shares: float) -> DataFrame:
    """One row: for each named share p, sorted[int(p * (n - 1))] of the values that are not null; percentile_disc is another definition.

    Values are counted first. Running counts of buckets 1/1024 wide, then of the values inside each bucket, find the
    ranks, so no task holds the column: scores lie in [-2, 2], which bounds the buckets to 4097. Null where there is no value.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("v") * 1024))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.orderBy("bucket")) - F.col("size")
    placed = buckets.select("bucket", before.alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))
    end = F.col("before") + F.sum("n").over(Window.partitionBy("bucket").orderBy("v"))
    ranked = counts.join(F.broadcast(placed), "bucket").select("v", "n", "total", end.alias("end"))
    rank = {name: F.floor(F.lit(p) * (F.col("total") - 1)) for name, p in shares.items()}
    return ranked.agg(*[F.max(F.when((r < F.col("end")) & (r >= F.col("end") - F.col("n")), F.col("v"))).alias(name) for name, r in rank.items()])


def log_odds(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """Difference of smoothed log odds."""
    odds = lambda x, n: F.ln(((x + 0.5) / (n + 1)) / (1 - (x + 0.5) / (n + 1)))
    return odds(a, n_a) - odds(b, n_b)


def percentage(part: Column, whole: Column) -> Column:
    """Null where the whole is empty."""
    return F.when(whole > 0, 100.0 * part / whole)
