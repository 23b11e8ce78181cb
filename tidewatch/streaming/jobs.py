"""Streaming forms: micro-batch ingestion with idempotent appends, and windowed event aggregates."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a table holds so far; nothing before its first append."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


OCCURRENCES = "source_id string, external_ref long, content_id long, content_hash string, collected_at timestamp"
REQUIRED = ("doc_id", "source_id", "external_ref", "arrival", "content_hash", "collected_at")
CONTENT = "content_id long, content_hash string, canonical_text string, first_seen timestamp"


def ingest_batch(batch: DataFrame, root: str) -> dict[str, int]:
    """Append one batch: occurrences and content by anti-join, raw rows with their outcome last. A replayed batch adds nothing but raw rows.
    Deliveries that lack what ingestion needs go to a table of their own with the reason and stop nothing."""
    spark = batch.sparkSession
    lacks = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())
    bad = batch.withColumn("reason", F.concat(F.lit("no "), F.array_join(lacks, ", "))).where(F.size(lacks) > 0)
    n_bad = bad.count()
    if n_bad:
        bad.write.mode("append").parquet(f"{root}/dead_letter")
        batch = batch.dropna(subset=list(REQUIRED))
    occ, content = stored(spark, f"{root}/occurrences", OCCURRENCES), stored(spark, f"{root}/content", CONTENT)
    # a cache would be refreshed by the appends below and then see them; a staged table is not
    staged = f"{root}/_staging/{uuid.uuid4().hex}"
    ingest.outcomes(batch, occ, content).write.parquet(staged)
    done = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in batch.schema)}, outcome string").parquet(staged)
    new_content = ingest.content_items(done)
    new_content.write.mode("append").parquet(f"{root}/content")
    known = stored(spark, f"{root}/content", CONTENT)
    ingest.item_occurrences(done, known).write.mode("append").parquet(f"{root}/occurrences")
    done.write.mode("append").parquet(f"{root}/raw")
    counts = {r.outcome: r["count"] for r in done.groupBy("outcome").count().collect()}
    return counts | {"dead_letter": n_bad} if n_bad else counts


def ingest_stream(deliveries: DataFrame, root: str, checkpoint: str, once: bool = True, every: str = "300 seconds"):
    """Run ingestion over a stream of deliveries; once: all that is there, then stop."""
    writer = deliveries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest_batch(df, root) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
