"""Token counts by a separator scan over flat token files.

A flat file is a run of little-endian ids of WIDTH bytes, each document followed by the end-of-document id, without any
index. It is read in blocks of fixed size that know nothing of documents, by ranges of a file: no task loads a
file. Each block is searched for the separator in one vectorised comparison; a prefix scan over the blocks'
summaries (separators so far, place of the last separator) stitches the documents that cross block
boundaries. The scan has two levels, groups of blocks and files, so that one huge file is no single task's.

Spark's text writer writes the files: a document's ids are a row's bytes, the separator's are the line separator. So any store that
Spark writes to will do, and failed tasks leave nothing behind. Ranges are read through Arrow's file systems; files of
a scheme they do not know are read whole, and refused beyond 2 GB.

Text is encoded as ordinary text (the separator's own string in a document is not the separator), so that the
separator is unambiguous.

Edge cases: null and empty texts count 0; an empty file has no documents; tokens after the last separator are an
unfinished document, counted if asked for; a document may span any number of blocks; null doc_ids stay null; repeated rows
are each counted; an empty table gives no rows; other columns, also ones whose names differ from doc_id or text in
case only, play no part. A file whose size is no multiple of WIDTH is refused.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import on_worker, send
from .common import arrow_schema, map_rows, new_path, pick, small_batches, written

EOD, WIDTH = 50256, 2
#: Ids of a block, blocks of a range that a task reads at a time, blocks of a group of the prefix scan.
BLOCK_TOKENS, RANGE_BLOCKS, GROUP_BLOCKS = 1 << 16, 256, 1024
_TYPES, _PACK = {2: "<u2", 4: "<u4"}, {2: "<H", 4: "<I"}


def write_flat(docs: DataFrame, folder: str, path: str | None = None, eod: int = EOD, width: int = WIDTH) -> None:
    """Encode documents into flat files in a folder, one for each partition that has rows."""
    sent, kind = send(docs.sparkSession, path), _TYPES[width]

    def start():
        bpe = on_worker(sent, specials=False)
        if len(bpe.strings) > 1 << 8 * width:
            raise ValueError(f"ids of this vocabulary do not fit into {width} bytes")
        return lambda text: [(np.frombuffer(bpe.encode(text), np.uint32).astype(kind).tobytes(),)]

    ids = map_rows(pick(docs, "text"), start, "ids binary")
    # the writer puts the line separator's bytes behind each row's
    separator = struct.pack(_PACK[width], eod).decode("latin-1")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("compression", "none").text(folder)


def numbered(docs: DataFrame) -> DataFrame:
    """(part, ordinal, doc_id): each row's partition and place in it."""
    schema = arrow_schema("part long, ordinal long, doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(done, done + n)), batch.column(0).cast(pa.int64())], schema=schema)
            done += n

    return pick(docs, "doc_id").mapInArrow(run, "part long, ordinal long, doc_id long")


def _opened(name: str) -> tuple[fs.FileSystem, str]:
    if (local := re.match(r"file:/+", name)) is not None:
        return fs.LocalFileSystem(), "/" + name[local.end() :]
    return fs.FileSystem.from_uri(name)


def blocks_of_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = WIDTH) -> DataFrame:
    """(file, block, tokens) of flat files; file is the path. Blocks come from ranges of a file."""
    size = width * block_tokens
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    files = files.withColumn("path", F.when(F.col("length") % width == 0, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no flat token file: "), "path"))))
    first = files.select("path").first()
    try:
        if first is not None:
            _opened(first.path)
    except (OSError, pa.ArrowInvalid):

        def start():
            def row(name: str, content: bytes) -> Iterator[tuple]:
                for k in range(0, len(content), size):
                    yield name, k // size, content[k : k + size]

            return row

        return map_rows(files.select("path", "content"), start, "file string, block long, tokens binary")
    span = size * RANGE_BLOCKS
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / span))).alias("k")).repartition("path", "k")
    schema = arrow_schema("file string, block long, tokens binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, k in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, place = _opened(name)
                with store.open_input_file(place) as f:
                    for at in range(k * span, min(length, (k + 1) * span), size):
                        tokens = f.read_at(min(size, length - at), at)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // size]), pa.array([tokens], pa.binary())], schema=schema)

    return ranges.mapInArrow(run, "file string, block long, tokens binary")


def scan(blocks: DataFrame, eod: int = EOD, unfinished: bool = False, block_tokens: int = BLOCK_TOKENS, width: int = WIDTH) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the flat files in (file, block, tokens)."""
    kind, ids = dict(blocks.dtypes)["file"].replace("bigint", "long"), _TYPES[width]

    def start():
        def row(file, block: int, tokens: bytes) -> Iterator[tuple]:
            x = np.frombuffer(tokens, ids)
            at = np.flatnonzero(x == eod)
            if len(at):
                yield file, block, len(x), len(at), int(at[0]), int(len(x) - at[-1] - 1), (np.diff(at) - 1).tolist()
            else:
                yield file, block, len(x), 0, len(x), len(x), []

        return row

    found = written(map_rows(blocks.select("file", "block", "tokens"), start, f"file {kind}, block long, n long, seps long, head long, tail long, inner array<long>"), "blocks")
    slim = found.select("file", "block", F.floor(F.col("block") / GROUP_BLOCKS).alias("group"), "n", "seps", "tail", (F.col("block") * block_tokens).alias("start"))
    # behind the last separator of a block
    slim = slim.withColumn("last", F.when(F.col("seps") > 0, F.col("start") + F.col("n") - F.col("tail")))
    upper = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = slim.groupBy("file", "group").agg(F.sum("seps").alias("s"), F.max("last").alias("l")).select("file", "group", zero(F.sum("s").over(upper)).alias("s"), zero(F.max("l").over(upper)).alias("l"))
    lower = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = slim.join(groups, ["file", "group"]).select("file", "block", (zero(F.sum("seps").over(lower)) + F.col("s")).alias("done"), (F.col("start") - F.greatest(zero(F.max("last").over(lower)), "l")).alias("open"))
    both = found.join(carried, ["file", "block"])
    first = F.array(F.col("head") + F.col("open"))
    ended = both.where("seps > 0").select("file", "done", F.posexplode(F.concat(first, "inner")).alias("k", "n_tokens")).select("file", (F.col("done") + F.col("k")).alias("ordinal"), "n_tokens")
    if not unfinished:
        return ended
    final = both.groupBy("file").agg(F.max_by(F.struct("done", "seps", "tail", "open"), "block").alias("f")).select("file", "f.*")
    rest = final.select("file", (F.col("done") + F.col("seps")).alias("ordinal"), F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("open")).alias("n_tokens"))
    return ended.union(rest.where("n_tokens > 0"))


def token_counts(docs: DataFrame, path: str | None = None, eod: int = EOD, block_tokens: int = BLOCK_TOKENS, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_tokens. The flat files are written, read block by block, and counted. Rows are
    told apart by partition and place, so a table that a shuffle deals out is written first."""
    small_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = written(docs, "documents")
    folder = new_path(docs.sparkSession, "flat")
    write_flat(docs, folder, path, eod, width)
    counted = scan(blocks_of_files(docs.sparkSession, folder, block_tokens, width), eod, False, block_tokens, width)
    counted = counted.select(F.regexp_extract("file", r"part-([0-9]+)-[^/]*$", 1).cast("long").alias("part"), "ordinal", "n_tokens")
    return numbered(docs).join(counted, ["part", "ordinal"]).select("doc_id", "n_tokens")
