"""Helpers shared by the training-data operators: column picking, the shared folder, Arrow row maps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
#: Rows that one Python step holds at a time, whatever the Arrow batch size is.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Select columns by exact name, even if another column differs from one of them in case only."""
    lowered = [c.lower() for c in df.columns]
    if any(lowered.count(n.lower()) > 1 for n in names):
        at = {}
        for i, c in enumerate(df.columns):
            at.setdefault(c, i)
        plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
        return plain.select(*[F.col(f"_c{at[n]}").alias(n) for n in names])
    return df.select(*names)


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """(df with its columns named by position, the new names of the named columns, a function that takes a frame back to
    df's columns and names). Whatever df's columns are called, none of them clashes with a stage's own."""
    inner = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    lowered = [c.lower() for c in df.columns]
    at = [df.columns.index(n) if n in df.columns else lowered.index(n.lower()) for n in names]
    return inner, [f"_c{i}" for i in at], lambda out: out.select(*inner.columns).toDF(*df.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tidewatch-"))
    return _OWN_DIR[0]


#: What this process has put into the shared folder, oldest first.
WRITTEN: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    WRITTEN.append(f"{shared_dir(spark)}/tidewatch-{label}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def drop_written(spark: SparkSession, mark: int, keep: tuple[str, ...] = ()) -> None:
    """Delete what was written since WRITTEN had mark entries: for callers who have stored the result and read nothing of it again."""
    for path in [p for p in WRITTEN[mark:] if p not in keep]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        WRITTEN.remove(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    # small row groups: a writing task holds one in memory
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(schema).parquet(path)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()),
}


#: Rows and bytes that Spark hands to Python at once: texts may be long, and two tasks share an executor's memory.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch bounds of this session; smaller ones stay."""
    for key, most in BATCH_CONF.items():
        now = spark.conf.get(key, None)
        if now is None or int(now) <= 0 or int(now) > int(most):
            spark.conf.set(key, most)


def release() -> None:
    """Give freed memory back at a task's end: Python workers live on, next to those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in ddl.split(", ")])


def map_rows(df: DataFrame, start: Callable[[], Callable[..., Iterable[tuple]]], ddl: str) -> DataFrame:
    """Arrow map. start() runs once in each task and returns f(*row) -> iterable of output tuples."""
    schema = arrow_schema(ddl)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                out: list[tuple] = []
                for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    out.extend(f(*row))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)
        del f
        release()

    return df.mapInArrow(run, ddl)


#: A key that holds 1/HOT_KEYS of all rows or more is hot: there are at most HOT_KEYS of them, which bounds their broadcast.
HOT_KEYS, SALTS = 1000, 64


def spread_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, by: str) -> DataFrame:
    """rows joined to facts, which has one row for each key and, as weight, the number of rows that hold it. Rows of hot
    keys are dealt over SALTS partitions by the column by, and their facts are repeated there. facts is read twice: a written table."""
    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = facts.where(F.col(weight) * HOT_KEYS >= total).select(key, F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by, F.lit(11)), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    copies = F.when(F.col(weight) * HOT_KEYS >= total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(facts.withColumn("_salt", F.explode(copies)), [key, "_salt"]).drop("_salt")


#: An id filter has 10 bits for each id, up to this many bytes in all.
FILTER_BYTES = 16 << 20


def _bit(ids: np.ndarray, size: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) & np.uint64(size - 1)).astype(np.int64)


def id_filter(ids: DataFrame):
    """A bit filter of a column of ids as a broadcast of bounded size, None beyond the bound: it spares other rows a shuffle, joins then select exactly."""
    size = 1 << max(10, (10 * max(1, ids.count()) - 1).bit_length())
    if size // 8 > FILTER_BYTES:
        return None
    bits = np.zeros(size // 8, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 8, np.uint8)
        for b in batches:
            at = _bit(b.column(0).to_numpy(zero_copy_only=False), size)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["bits"])

    for r in ids.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits)


def may_hold(bits: np.ndarray, ids: pa.Array) -> pa.Array:
    """Null ids are in no filter."""
    at = _bit(ids.fill_null(0).to_numpy(zero_copy_only=False), 8 * len(bits))
    hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
    return pa.array(hit & ids.is_valid().to_numpy(zero_copy_only=False))


def holds(bits: np.ndarray, one: int) -> bool:
    """The same for one id."""
    x = one * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    at = (x ^ x >> 29) & (8 * len(bits) - 1)
    return bool(int(bits[at >> 3]) >> (at & 7) & 1)


def held_by(sent) -> Callable:
    """An Arrow UDF on a column of ids: may the filter hold it?"""

    @F.arrow_udf("boolean")
    def held(ids: pa.Array) -> pa.Array:
        return may_hold(sent.value, ids)

    return held


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
