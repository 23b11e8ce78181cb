"""The model's tables over the test tables, and readers of the small configuration inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    base = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct().withColumn("n", F.regexp_extract("source_id", r"([0-9]+)$", 1).cast("int"))
    return base.select(
        "source_id", "n", F.when(n % 2 == 0, "rss").otherwise("telegram").alias("source_type"), F.when(n % 5 != 4, n % 5 + 1).alias("contour_id"),
        F.when(n < 8, "group_a").when(n < 16, "group_b").otherwise("other").alias("source_group"), (n != 19).alias("is_active"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery for each document, and a second one of some."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), T.collapse(F.col("text")).alias("canonical_text"))
    ref = F.when((F.col("doc_id") % 40 >= 20) & (F.col("doc_id") % 10 == 0), F.col("doc_id") - 20).otherwise(F.col("doc_id"))
    again = F.explode(F.when(F.col("doc_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return docs.select("doc_id", "source_id", "canonical_text", ref.alias("external_ref"), again.alias("delivery")).select(
        "doc_id", "source_id", "canonical_text", "external_ref", (F.col("doc_id") + F.col("delivery") * 1_000_000_000).alias("arrival"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60).alias("collected_at"), T.content_hash(F.col("canonical_text")).alias("content_hash"),
    )


#: The one registered embedding model of the test tables.
MODEL_ID = 1


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("content_id"), "embedding", "label", F.lit(MODEL_ID).alias("embedding_model_id"))


def prototypes(spark: SparkSession, sf_dir: str) -> dict[str, list[tuple[str, list[float]]]]:
    """The registry's 56 vectors: a fixed size, whatever the data."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id < 56").orderBy("vec_id").select("vec_id", "embedding").collect()
    named = [(r.vec_id, list(r.embedding)) for r in rows]
    return {
        "relevant": [(str(i), v) for i, v in named if i < 12],
        "irrelevant": [(str(i), v) for i, v in named if 12 <= i < 22],
        "noise": [(f"c{(i - 22) % 14:02d}", v) for i, v in named if i >= 22],
    }


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One term a line; blank lines and # comments go."""
    return spark.read.text(path).select(F.lower(T.strip(F.col("value"))).alias("term")).where("term <> '' and not startswith(term, '#')")


def read_prototype_sets(spark: SparkSession, path: str) -> DataFrame:
    """{set: [texts]} as (set_name, ordinal, text)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("set_name", "texts")).select("set_name", F.posexplode("texts").alias("ordinal", "text"))


def read_jsonl(spark: SparkSession, path: str, schema: str, where: str | None = None) -> DataFrame:
    """One object a line; lines that are none raise."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if where is None else rows.where(where)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """A list, or {"evidence": [...]}; anything else raises. A file is parsed as one row, so many items belong in many files; texts may have any length."""
    item = "struct<evidence_id:string,content_id:string,source:string,contour_id:int,reported_at:string,text:string>"
    raw = spark.read.text(path, wholetext=True)
    any_length = {"maxStringLen": str(2**31 - 1)}
    listed, held = F.from_json("value", f"array<{item}>", any_length), F.from_json("value", f"struct<evidence:array<{item}>>", any_length)
    found = raw.select(F.when(F.ltrim("value").startswith("["), listed).otherwise(held.getField("evidence")).alias("e"))
    return found.select(F.explode(F.when(F.col("e").isNotNull(), F.col("e")).otherwise(F.raise_error(F.lit("unknown fixture shape")).cast(f"array<{item}>"))).alias("e")).select("e.*")


def active_sources(src: DataFrame, kind: str) -> DataFrame:
    return src.where((F.col("source_type") == kind) & F.col("is_active"))


def parse_feed(entries: DataFrame) -> DataFrame:
    """Feed entries (source_id, link, title, summary, published) as deliveries; no link gives the reference ''."""
    return entries.select(
        "source_id", F.coalesce(T.canonical_url(F.col("link")), F.lit("")).alias("external_ref"), "title",
        T.canonical_text(F.col("title"), T.strip_html(F.coalesce("summary", F.lit("")))).alias("canonical_text"),
        F.coalesce(F.try_to_timestamp(F.regexp_replace("published", r"^[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("published")).alias("published_at"),
    )
