"""The training-corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, decontam, linededup, neardup, quality
from tidewatch.llm.common import WRITTEN, drop_written, new_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one of them."""
    return linededup.without_repeated_lines(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id."""
    return neardup.one_of_each(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontam.clean_only(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each remaining document, as digests and counts."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", neardup_stage),
    ("benchmark decontamination", decontam_stage),
    ("BPE encoding and decoding", token_stage),
]

#: SQL can express neither the classifier nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared folder and read again. What a stage wrote on its way goes
    when its result is there; results of earlier stages go too."""
    docs, mark = table(spark, sf_dir, "documents"), len(WRITTEN)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage{k}")
            docs.write.parquet(path)
            drop_written(spark, mark, keep=(path,))
            docs = spark.read.parquet(path)
    return docs
