"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A LineIndex is the stored state. Its reference table holds (key, doc_id): which documents hold a line. Its counts say how
many do and which of them keeps the line; a cuckoo filter for each shard of the keys holds the fingerprints of the
lines that enough documents hold. insert_documents() adds references, delete_documents() takes exactly those of the
named documents away; both count only the keys they touch anew and put into or take out of the stored filters
only keys that crossed the threshold, so a later result is as if deleted documents had never been there. dedup_lines() and
without_repeated_lines() insert their documents into an empty index. Documents probe the filters first, and only
lines that pass are looked up in the exact counts, which also removes the filters' false positives.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least 20 code points
that at least 3 documents hold lose all their lines but those of the largest doc_id that holds them.

Plans that depend on sizes, with the same rows either way: filters of up to BROADCAST_BYTES are broadcast, larger ones are
met by shard; where the ids of documents that lose lines fit into a bit filter (common.FILTER_BYTES), only these documents
are shuffled to meet their lost keys, else all. Lines that very many documents hold are dealt over several tasks.

Edge cases: null and empty texts are one empty line; a text of any length is taken whole, by one task; a null doc_id
holds no references and loses no line; rows that repeat a doc_id are one document when holders are counted; several lines
of the keeper stay; among holders the largest doc_id keeps a line, so there are no ties; an empty table gives no rows; other
columns, also ones whose names differ from doc_id or text in case only, play no part and stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_by, holds, id_filter, map_rows, pick, positional, small_batches, spread_join, utf8, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys that one filter shard is made for: an index with more keys a shard gets more shards.
SHARD_KEYS = 50_000
#: Parts of a reference table before they are written as one.
MAX_PARTS = 16
#: Filters up to this size in all are broadcast; larger ones are joined by shard.
BROADCAST_BYTES = 32 << 20
_STRIP = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit key of a line, None where it is too short to count."""
    line = line.strip(_STRIP)
    if len(line) < min_chars:
        return None
    return hashlib.blake2b(utf8(line).lower(), digest_size=16).digest()


class CuckooFilter:
    """Partial-key cuckoo filter with 4 slots a bucket and 16-bit fingerprints. What finds no place after the last kick
    goes to an exact overflow list, so nothing inserted is ever missed."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int, table: np.ndarray | None = None, overflow: list[tuple[int, int]] | None = None):
        buckets = 1
        while buckets * self.SLOTS * 0.9 < max(1, capacity):
            buckets *= 2
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self.overflow = overflow or []
        self._turn = 0

    @property
    def mask(self) -> int:
        return len(self.table) - 1

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[4:6], "little") or 1
        at = int.from_bytes(key[6:14], "little") & self.mask
        return mark, at, self._other(at, mark)

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & self.mask

    def insert(self, key: bytes) -> None:
        mark, a, b = self._place(key)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        at = b
        for _ in range(self.KICKS):
            self._turn = (self._turn + 1) % self.SLOTS
            mark, self.table[at, self._turn] = int(self.table[at, self._turn]), mark
            at = self._other(at, mark)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        self.overflow.append((mark, min(at, self._other(at, mark))))

    def delete(self, key: bytes) -> bool:
        """Take one copy of a key out; only keys that were inserted may be deleted."""
        mark, a, b = self._place(key)
        for at in (a, b):
            hit = np.flatnonzero(self.table[at] == mark)
            if len(hit):
                self.table[at, hit[0]] = 0
                return True
        if (mark, min(a, b)) in self.overflow:
            self.overflow.remove((mark, min(a, b)))
            return True
        return False

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._place(key)
        return bool((self.table[a] == mark).any() or (self.table[b] == mark).any() or (mark, min(a, b)) in self.overflow)

    def dump(self) -> bytes:
        head = np.array([len(self.table), len(self.overflow)], np.uint64)
        return head.tobytes() + self.table.tobytes() + np.array(self.overflow, np.uint64).tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        n, m = np.frombuffer(data, np.uint64, 2).tolist()
        table = np.frombuffer(data, np.uint16, n * cls.SLOTS, 16).reshape(n, cls.SLOTS).copy()
        over = np.frombuffer(data, np.uint64, 2 * m, 16 + table.nbytes).reshape(m, 2)
        return cls(1, table, [tuple(x) for x in over.tolist()])


def shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[:4], "big") % shards


def _shard_column(shards: int):
    return F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % shards


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id): each long line of each document, once for a row."""

    def start():
        def row(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            if doc_id is not None:
                for key in {line_key(x, min_chars) for x in (text or "").split("\n")} - {None}:
                    yield key, doc_id

        return row

    return map_rows(pick(docs, "doc_id", "text"), start, "key binary, doc_id long")


def counts(table: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, keeper, n_docs) of the lines that at least min_docs documents hold; counted before the shuffle too."""
    return table.groupBy("key").agg(F.max("doc_id").alias("keeper"), F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def updated(sieves: DataFrame, before: DataFrame, after: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): stored filters brought from the keys of before to those of after. Only keys that crossed the threshold are taken out or put in."""
    both = before.select("key", F.lit(-1).alias("change")).union(after.select("key", F.lit(1)))
    changes = both.groupBy("key").agg(F.sum("change").alias("change")).where("change <> 0").select("key", "change", _shard_column(shards).alias("shard"))
    capacity = SHARD_KEYS

    def apply(key, stored, changed):
        f = CuckooFilter.load(bytes(stored["filter"].iloc[0])) if len(stored) else CuckooFilter(capacity)
        for k, change in sorted(zip(map(bytes, changed["key"]), changed["change"]), key=lambda x: x[1]):
            f.delete(k) if change < 0 else f.insert(k)
        return type(changed)({"shard": [int(key[0])], "filter": [f.dump()]})

    return sieves.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(apply, SIEVES)


REFERENCES, COUNTS, SIEVES = "key binary, doc_id long", "key binary, keeper long, n_docs long", "shard long, filter binary"


@dataclass(frozen=True)
class LineIndex:
    """Stored tables: references (key, doc_id), each once, in a number of parts; repeated (key, keeper, n_docs); sieves (shard, filter)."""

    references: DataFrame
    repeated: DataFrame
    sieves: DataFrame
    shards: int
    min_docs: int
    parts: int = 1


def empty_index(spark: SparkSession, min_docs: int = MIN_DOCS) -> LineIndex:
    none = lambda ddl: spark.createDataFrame([], ddl)
    return LineIndex(none(REFERENCES), none(COUNTS), none(SIEVES), 0, min_docs)


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the lines of docs; documents that it holds already gain the lines they did not have."""
    fresh = references(docs).distinct()
    if index.shards:
        fresh = fresh.join(index.references, ["key", "doc_id"], "left_anti")
    fresh = written(fresh, "references")
    if not index.shards:
        return _moved(index, fresh, fresh, 1)
    table = index.references.union(fresh)
    # after many insertions the parts become one table
    return _moved(index, table, fresh, index.parts + 1) if index.parts < MAX_PARTS else _moved(index, written(table, "references"), fresh, 1)


def delete_documents(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents named in doc_ids."""
    named = pick(doc_ids, "doc_id").distinct()
    gone = written(index.references.join(named, "doc_id", "left_semi").select("key", "doc_id"), "deleted")
    return _moved(index, written(index.references.join(named, "doc_id", "left_anti").select("key", "doc_id"), "references"), gone, 1)


def _moved(index: LineIndex, table: DataFrame, touched: DataFrame, parts: int) -> LineIndex:
    """index with a new reference table, whose keys in touched are counted anew."""
    if index.shards:
        keys = touched.select("key").distinct()
        now = index.repeated.join(keys, "key", "left_anti").select("key", "keeper", "n_docs").union(counts(table.join(keys, "key", "left_semi"), index.min_docs))
    else:
        now = counts(table, index.min_docs)
    now = written(now, "linecounts")
    shards = max(1, index.shards, -(-now.count() // SHARD_KEYS))
    # with more shards every key has another home: all filters are made again
    same = shards == index.shards
    old = empty_index(table.sparkSession) if not same else index
    return LineIndex(table, now, written(updated(old.sieves, old.repeated, now, shards), "sieves"), shards, index.min_docs, parts)


def flagged(docs: DataFrame, index: LineIndex) -> DataFrame:
    """(key, doc_id) of the lines that pass the filters: probes on the executors, never a shuffle of texts."""
    shards = index.shards
    if shards * len(CuckooFilter(SHARD_KEYS).dump()) <= BROADCAST_BYTES:
        sent = docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.filter) for r in index.sieves.collect()})

        def start():
            loaded = {k: CuckooFilter.load(v) for k, v in sent.value.items()}

            def row(doc_id: int | None, text: str | None) -> Iterator[tuple]:
                if doc_id is not None:
                    for key in {line_key(x) for x in (text or "").split("\n")} - {None}:
                        if (s := loaded.get(shard_of(key, shards))) is not None and key in s:
                            yield key, doc_id

            return row

        return map_rows(pick(docs, "doc_id", "text"), start, REFERENCES)

    # too large to send: the lines travel to the shards instead
    def probe(key, pdf_lines, pdf_filter):
        if not len(pdf_filter) or not len(pdf_lines):
            return pdf_lines[["key", "doc_id"]].iloc[:0]
        s = CuckooFilter.load(bytes(pdf_filter["filter"].iloc[0]))
        return pdf_lines[[bytes(k) in s for k in pdf_lines["key"]]][["key", "doc_id"]]

    salted = references(docs).withColumn("shard", _shard_column(shards)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    spread = index.sieves.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(probe, REFERENCES)


def dropped_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """(doc_id, keys): the keys whose lines each document loses."""
    lost = spread_join(flagged(docs, index), index.repeated, "key", "n_docs", "doc_id").where("doc_id <> keeper").select("doc_id", "key")
    return written(lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "lostlines")


def _met(some: DataFrame, doc_id: str, lost: DataFrame) -> DataFrame:
    """Documents with the keys that they lose as lost_keys."""
    named = lost.select(F.col("doc_id").alias("lost_id"), F.col("keys").alias("lost_keys"))
    return some.join(named.hint("shuffle_hash"), F.col(doc_id) == F.col("lost_id"), "left").drop("lost_id")


def _kept(text: str | None, keys: list[bytes] | None) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    if not keys:
        return len(lines), 0, text or ""
    gone = set(keys)
    stay = [x for x in lines if (k := line_key(x)) is None or k not in gone]
    return len(lines), len(lines) - len(stay), "\n".join(stay)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = pick(docs, "doc_id", "text")
    lost = dropped_lines(docs, insert_documents(empty_index(docs.sparkSession, min_docs), docs))
    sent = id_filter(lost.select("doc_id"))

    def start():
        def row(doc_id: int | None, text: str | None, keys: list[bytes] | None) -> Iterator[tuple]:
            n, gone, kept = _kept(text, keys)
            yield doc_id, n, gone, hashlib.sha256(utf8(kept)).hexdigest()

        return row

    def untouched():
        row, bits = start(), None if sent is None else sent.value

        def other(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            # one Python step both selects and counts
            if doc_id is None or (bits is not None and not holds(bits, doc_id)):
                yield from row(doc_id, text, None)

        return other

    result = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    some, others = (docs.where("doc_id is not null"), docs.where("doc_id is null")) if sent is None else (docs.where(held_by(sent)("doc_id")), docs)
    return map_rows(_met(some, "doc_id", lost).select("doc_id", "text", "lost_keys"), start, result).union(map_rows(others, untouched, result))


def without_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, all columns, with the texts that are left; n_chars follows the text where there is such a column."""
    lines = pick(docs, "doc_id", "text")
    lost = dropped_lines(lines, insert_documents(empty_index(docs.sparkSession, min_docs), lines))
    inner, (doc_id, text), back = positional(docs, "doc_id", "text")

    @F.pandas_udf("string")
    def kept(texts, keys):
        return type(texts)([t if k is None else _kept(t, list(k))[2] for t, k in zip(texts, keys, strict=True)], dtype=object)

    small_batches(docs.sparkSession)
    sent = id_filter(lost.select("doc_id"))
    hit = F.col(doc_id).isNotNull() if sent is None else held_by(sent)(doc_id)
    some, others = _met(inner.where(hit), doc_id, lost), inner.where(~hit)
    changed = F.when(F.col("lost_keys").isNull(), F.col(text)).otherwise(kept(text, "lost_keys"))
    out = some.withColumn(text, changed).drop("lost_keys").union(others)
    if "n_chars" in docs.columns:
        n_chars = positional(docs, "n_chars")[1][0]
        out = out.withColumn(n_chars, F.length(text).cast(inner.schema[n_chars].dataType))
    return back(out)
