"""Write semantics over immutable tables: insert if absent, upsert, ranked inserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of batch to append: the first of each key, and only keys that target lacks. Null keys are equal."""
    first = batch.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    b, t = first.alias("b"), target.select(*keys).alias("t")
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return b.join(t, cond, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """target with batch's new rows, and the named columns of known ones replaced."""
    t, b = target.alias("t"), batch.withColumn("_new", F.lit(True)).alias("b")
    joined = t.join(b, keys, "full")
    return joined.select(*keys, *[(F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")) if c in update else F.coalesce(F.col(f"t.{c}"), F.col(f"b.{c}"))).alias(c) for c in target.columns if c not in keys])


def top_then_insert(target: DataFrame, ranked: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The best n of all; of these, the ones that target lacks."""
    return ranked.orderBy(*order).limit(n).join(target.select(*keys), keys, "left_anti")


def insert_then_top(target: DataFrame, ranked: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The best n of those that target lacks."""
    return ranked.join(target.select(*keys), keys, "left_anti").orderBy(*order).limit(n)


def parents_with_children(target: DataFrame, parents: DataFrame, children: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """New parents, and the children of new parents only."""
    new = parents.join(target.select(*keys), keys, "left_anti")
    return new, children.join(new.select(*keys), keys, "left_semi")


def backlog(rows: DataFrame, done: DataFrame, keys: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """Rows not yet processed, in their order."""
    todo = rows.join(done.select(*keys).distinct(), keys, "left_anti").orderBy(*order)
    return todo if limit is None else todo.limit(limit)


def insert_counts(ranked: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row (attempted, inserted): how many were offered and how many were new."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(ranked, "attempted").crossJoin(count(inserted, "inserted"))


def insert_decisions(decisions: DataFrame, target: DataFrame, version: str, revision: str) -> DataFrame:
    """The routing decisions to append: those that this version has not made yet."""
    new = decisions.withColumn("routing_version", F.lit(version)).withColumn("code_revision", F.lit(revision))
    return new.join(target.select("content_id", "routing_version"), ["content_id", "routing_version"], "left_anti")


def append_runs(runs: DataFrame, children: DataFrame, root: str, stored: Callable[[DataFrame], DataFrame], key: str = "run_id") -> dict[str, int]:
    """Append runs and what hangs on them: the children first, the runs last, so that a run in the table means that all of it is there.
    Runs that the table has are not written again. Returns the count of each status."""
    spark = runs.sparkSession
    runs = stored(runs)
    known = read_or_none(spark, f"{root}/runs", runs)
    new = runs if known is None else stored(runs.join(known.select(key), key, "left_anti"))
    children.join(new.select(key), key, "left_semi").write.mode("append").parquet(f"{root}/children")
    new.write.mode("append").parquet(f"{root}/runs")
    return {r.status: r["count"] for r in new.groupBy("status").count().collect()}


def committed_children(spark: SparkSession, root: str, ids: list[str], key: str = "run_id") -> DataFrame:
    """The children of runs that are in the run table, each once: what a batch that broke off left behind does not count."""
    return spark.read.parquet(f"{root}/children").join(spark.read.parquet(f"{root}/runs").select(key), key, "left_semi").dropDuplicates(ids)


def read_or_none(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return None


def written_or_shown(df: DataFrame, path: str, revision: str, write: bool = False) -> DataFrame:
    """A dry run unless write is set: the rows as they would be written. Writing refuses a revision with changes."""
    if write:
        if revision.endswith("+dirty"):
            raise ValueError("the working tree has changes")
        df.write.mode("append").parquet(path)
    return df
