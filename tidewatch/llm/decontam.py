"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window: 13 consecutive words of a benchmark item, or all words of a shorter item. Patterns of
one length form one table. Blocks are pairs of words (single words for length 1): the shift table says how
far the end of the window may jump for each block; where it says 0, the suffix bucket names the candidate
patterns, the prefix (first word) rejects most, and direct comparison confirms.

The tables go to the executors as broadcasts of at most max_patterns windows each. A larger benchmark is cut
by the hash of id and text into several such shards; each shard scans the documents and the hits are united, so no benchmark
size needs more memory.

Edge cases: null and empty texts have no words and are never contaminated; texts of any length are searched whole, in
memory linear in their words; items without words are ignored; a null doc_id stays null; windows of items with a null
item_id count in n_hit and contaminated, but not in n_items and items_sha256; rows that repeat an item_id
are one item with all their windows; repeated documents are each judged; equal windows of several items name all of
them; with an empty benchmark nothing is hit, with no documents there are no rows; other columns, also ones whose names
differ from doc_id or text in case only, play no part and stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pick, positional, small_batches, utf8, written

WIDTH = 13
MAX_PATTERNS = 200_000
#: Lower-cases A-Z and blanks every byte that belongs to no word: words are digits, letters a-z, and bytes from 0x80.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORD_BYTES).split()


def windows(text: str | None, width: int = WIDTH) -> list[tuple[bytes, ...]]:
    w = words(text)
    if not w:
        return []
    n = min(width, len(w))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


class WuManber:
    """Patterns of one length m. find() yields (start, pattern number) of every occurrence, by start."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.patterns, self.m = patterns, len(patterns[0])
        self.block = min(2, self.m)
        self.default = self.m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.suffix: dict[tuple[bytes, ...], dict[bytes, list[int]]] = {}
        for k, p in enumerate(patterns):
            for end in range(self.block, self.m + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.default), self.m - end)
            self.suffix.setdefault(p[self.m - self.block :], {}).setdefault(p[0], []).append(k)

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        m, block, shift, default = self.m, self.block, self.shift, self.default
        at, n = m, len(text)
        while at <= n:
            b = tuple(text[at - block : at])
            jump = shift.get(b, default)
            if jump:
                at += jump
                continue
            first = at - m
            for k in self.suffix[b].get(text[first], ()):
                if self.patterns[k] == tuple(text[first:at]):
                    yield first, k
            at += 1


class Searcher:
    """All windows of a set of items, by length."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], width: int = WIDTH):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in windows(text, width):
                found = owners.setdefault(w, set())
                if item is not None:
                    found.add(item)
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for w in sorted(owners):
            by_length.setdefault(len(w), []).append(w)
        self.tables = [(WuManber(p), [sorted(owners[w]) for w in p]) for _, p in sorted(by_length.items())]

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(hit word ranges, items that occur)."""
        ranges, items = [], set()
        for table, owners in self.tables:
            for start, k in table.find(text):
                ranges.append((start, start + table.m))
                items.update(owners[k])
        return ranges, items


def covered(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges united where they meet."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _verdict(doc_id: int | None, n: int, ranges: list[tuple[int, int]], items: set[str]) -> tuple:
    hit = sum(b - a for a, b in covered(ranges))
    return doc_id, n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and 20 * hit >= n


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _shards(benchmark: DataFrame, width: int, max_patterns: int) -> list[tuple[int, int]]:
    """(k, n) of the shards that hold about max_patterns windows each."""
    # a word and the gap behind it take two bytes at least
    bound = F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 2))
    total = pick(benchmark, "item_id", "text").agg(F.coalesce(F.sum(bound), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // max_patterns))
    return [(k, n) for k in range(n)]


def _items(benchmark: DataFrame, shard: tuple[int, int]) -> list[tuple[str | None, str | None]]:
    k, n = shard
    items = pick(benchmark, "item_id", "text")
    # the text too, since all null ids have one hash
    return [(None if r[0] is None else str(r[0]), r[1]) for r in (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. One scan, no shuffle, for a benchmark within max_patterns."""
    docs = pick(docs, "doc_id", "text")
    shards = _shards(benchmark, width, max_patterns)
    if len(shards) > 1:
        return _united(written(docs.withColumn("row", F.monotonically_increasing_id()), "decontam"), benchmark, shards, width).drop("row")
    sent = docs.sparkSession.sparkContext.broadcast(_items(benchmark, shards[0]))

    def start():
        searcher = Searcher(sent.value, width)

        def row(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            w = words(text)
            yield _verdict(doc_id, len(w), *searcher.search(w))

        return row

    return map_rows(docs, start, RESULT)


def _united(numbered: DataFrame, benchmark: DataFrame, shards: list, width: int) -> DataFrame:
    """The verdicts, with the row number, where hits of several shards count together. Each shard's hits are written before the next shard is sent."""
    found = None
    for shard in shards:
        sent = numbered.sparkSession.sparkContext.broadcast(_items(benchmark, shard))

        def begin(sent=sent):
            searcher = Searcher(sent.value, width)

            def row(number: int, doc_id: int | None, text: str | None) -> Iterator[tuple]:
                w = words(text)
                ranges, items = searcher.search(w)
                yield number, doc_id, len(w), [x for r in covered(ranges) for x in r], [i.encode() for i in sorted(items)]

            return row

        part = written(map_rows(numbered.select("row", "doc_id", "text"), begin, "row long, doc_id long, n long, ranges array<long>, items array<binary>"), "hits")
        sent.destroy()
        found = part if found is None else found.union(part)

    def judge():
        def row(number: int, doc_id: int | None, n: int, ranges: list[list[int]], items: list[list[bytes]]) -> Iterator[tuple]:
            spans = [(r[i], r[i + 1]) for r in ranges for i in range(0, len(r), 2)]
            yield number, *_verdict(doc_id, n, spans, {bytes(i).decode() for part in items for i in part})

        return row

    met = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.collect_list("ranges").alias("ranges"), F.collect_list("items").alias("items"))

    def flat():
        return lambda number, doc_id, n, ranges, items: judge()(number, doc_id, n, ranges, items)

    return map_rows(met.select("row", "doc_id", "n", "ranges", "items"), flat, f"row long, {RESULT}")


def clean_only(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    shards = _shards(benchmark, width, max_patterns)
    inner, (doc_id, text), back = positional(docs, "doc_id", "text")
    if len(shards) == 1:
        small_batches(docs.sparkSession)
        return back(inner.where(~_bad_udf(docs.sparkSession.sparkContext.broadcast(_items(benchmark, shards[0])), width)(F.coalesce(text, F.lit("")))))
    numbered = written(inner.withColumn("row", F.monotonically_increasing_id()), "decontam")
    verdicts = _united(numbered.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "row"), benchmark, shards, width)
    return back(numbered.join(verdicts.where("contaminated").select("row"), "row", "left_anti"))


def _bad_udf(sent, width: int):
    state: dict[str, Searcher] = {}

    @F.pandas_udf("boolean")
    def bad(texts):
        if "s" not in state:
            state["s"] = Searcher(sent.value, width)
        out = []
        for t in texts:
            w = words(t)
            out.append(_verdict(None, len(w), *state["s"].search(w))[-1])
        return type(texts)(out, dtype=bool)

    return bad
