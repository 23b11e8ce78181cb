"""Near duplicates by bottom-k sketches from one hash function.

A document's set holds its distinct five-word shingles as 64-bit hashes; the k smallest are its sketch.
Equal sets form one class, and all later work is on classes.

1. Inverted lists of retained values generate overlaps. Two sets with Jaccard similarity of 0.75 or
   more share at least NEED of their LIST_K smallest values (the chance to fall short is under 1e-9),
   or 3/4 of their values where both sets are small. So each class enters the lists of only its
   (held - need + 1) rarest values: two similar classes still meet in one of them, and values that many
   documents share (common passages) seldom become lists.
2. Every class is paired with the most central class of each of its lists: a star instead of all pairs.
3. The union-sketch estimate drops pairs; full sets verify the rest.
4. Lists of three or more whose members are still in different components are compared member by member.
   Lists with the same smallest member form one group, so that a family of documents that share many
   values travels once for a group and not once for a list. Groups are compared inside tasks, in
   blocks of bounded size that are dealt by (group, block, block), so no task ever holds a whole hot group
   and none is expanded into pairs. Only blocks whose set sizes are near enough meet. Only members that share
   a list are compared, and only in the first group in which they do. Sets that fit into the
   sketch are verified right there. Of larger sets that the estimate cannot rule out the members are named, not
   the pairs: these come again with their whole sets, in blocks cut by the sizes of the sets, and are verified.
   A task returns at most one edge and one name for each of its members. Every pair that shares a list and is not
   connected is compared: no link between components is lost.
   A group of M unlike members of like sizes costs M * M / BLOCK rows and up to M * M comparisons.
5. Components: alternating large-star and small-star passes until nothing changes.

Plans that depend on sizes, with the same rows either way: where the ids that a join selects fit into a bit
filter (common.FILTER_BYTES), other rows are dropped before they are shuffled, else the join alone selects.

Edge cases: null and empty texts have an empty set and no links; fewer than five words make one shingle; a
text of any length is one set of all its shingles, held by one task; rows with a null doc_id take no part and are their
own (component_id null, kept true); rows that repeat a doc_id count as one document, linked through any of its
texts; an empty table gives no rows; other columns, also ones whose names differ from doc_id or text in case
only, play no part and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, arrow_schema, id_filter, map_rows, may_hold, pick, positional, release, spread_join, utf8, written

WORDS, SKETCH_K, LIST_K, NEED = 5, 256, 48, 16
#: Under this estimate no pair of sketches of SKETCH_K values belongs to sets with similarity 0.75 (6 sigma).
LEAST_ESTIMATE = 0.58
#: Members of a block of a list, rows compared at once, and shingles of a block of full sets.
BLOCK, STRIP, BLOCK_SHINGLES = 512, 256, 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    """Word to 64-bit hash; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: _WordHash, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. Words end at ASCII white space; A-Z are lower-cased."""
    found = utf8(text).lower().split()
    if not found:
        return np.empty(0, np.uint64)
    x = np.array([words[w] for w in found], np.uint64)
    m = min(width, len(x))
    n = len(x) - m + 1
    h = np.full(n, m, np.uint64)
    for i in range(m):
        h = h * _P + x[i : i + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), set_key (128-bit hash of the set), sketch (its smallest values)."""

    def start():
        words = _WordHash()

        def row(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            s = shingle_set(text, words)
            yield doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), s[:SKETCH_K].tobytes()

        return row

    return map_rows(docs, start, "doc_id long, n long, set_key binary, sketch binary")


def _postings(classes: DataFrame) -> DataFrame:
    """(value, node, n, central): the lists that each class enters; central counts its LIST_K values that others hold too."""

    def start():
        def row(node: int, n: int, low: bytes) -> Iterator[tuple]:
            for v in np.frombuffer(low, np.int64).tolist():
                yield v, node, n

        return row

    held = map_rows(classes.select("node", "n", "low"), start, "value long, node long, n long")
    shared = written(held.groupBy("value").agg(F.count("*").alias("freq")).where("freq > 1"), "values")
    size = F.least(F.col("n"), F.lit(LIST_K))
    need = F.when(F.col("n") <= LIST_K * 3 // 4, F.ceil(F.col("n") * 3 / 4)).otherwise(F.lit(NEED))
    mine = spread_join(held, shared, "value", "freq", "node").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "value"))).alias("vs"))
    # values that no other class holds come first in the order of rarity and make no list
    left = F.greatest(F.lit(0), size - need + 1 - (size - F.size("vs")))
    chosen = mine.select("node", "n", F.size("vs").alias("central"), F.slice("vs", F.lit(1), left.cast("int")).alias("vs"))
    return chosen.select("node", "n", "central", F.explode("vs.value").alias("value")).select("value", "node", "n", "central")


def _sketches_of(rows: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, sketch) of the named nodes."""
    picked, sent = rows.select("doc_id", "n", "set_key", "sketch"), id_filter(nodes)
    if sent is not None:

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(may_hold(sent.value, b.column(0)))

        picked = picked.mapInArrow(sift, "doc_id long, n long, set_key binary, sketch binary")
    wanted = nodes.join(classes.select("node", "set_key"), "node")
    return picked.select(F.col("doc_id").alias("node"), "n", "set_key", "sketch").join(wanted, ["node", "set_key"], "left_semi").dropDuplicates(["node", "set_key"]).select("node", "n", "sketch")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the union's SKETCH_K smallest values that both sketches hold."""
    union = np.union1d(a, b)[:SKETCH_K]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / max(1, len(union))


def _judge(na: int, nb: int, a: np.ndarray, b: np.ndarray) -> int:
    """1: linked, 0: not linked, -1: only the full sets can tell."""
    if 4 * min(na, nb) < 3 * max(na, nb):
        return 0
    if na <= SKETCH_K and nb <= SKETCH_K:
        return int(_similar(a, b))
    return -1 if estimate(a, b) >= LEAST_ESTIMATE else 0


def _verified(pairs: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of pairs (a, b)."""
    half = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def judged():
        def row(a: int, b: int, na: int, nb: int, sa: bytes, sb: bytes) -> Iterator[tuple]:
            j = _judge(na, nb, np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64))
            if j:
                yield a, b, j

        return row

    told = written(map_rows(pairs.join(half("a"), "a").join(half("b"), "b").select("a", "b", "na", "nb", "sa", "sb"), judged, "a long, b long, j int"), "judged")
    unsure = told.where("j < 0").select("a", "b")
    return told.where("j > 0").select("a", "b").union(_by_full_sets(unsure, docs)).distinct()


def _tasks(df: DataFrame) -> int:
    """A number of partitions that Spark does not lower: comparing costs far more time than its bytes say."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _full_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, n, s): the whole sets of the named documents (doc_id)."""
    sent = id_filter(nodes)
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("s", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHash()
        for batch in batches:
            if sent is not None:
                batch = batch.filter(may_hold(sent.value, batch.column(0)))
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                ids, texts = (c.to_pylist() for c in batch.slice(lo, SLICE_ROWS).columns)
                made = [shingle_set(t, words) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())], schema=schema)

    # either the filter or the join comes first; there is one Python step in the stage
    picked = docs if sent is not None else docs.join(nodes, "doc_id", "left_semi")
    full = picked.select("doc_id", "text").mapInArrow(sets, "node long, n long, s binary")
    return written(full.join(nodes, full["node"] == nodes["doc_id"], "left_semi").distinct(), "sets")


def _by_full_sets(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of pairs, by full sets. Pairs are gathered by the cluster they form, cut into blocks of bounded size, so that a set travels once for a block and not once for a pair."""
    pairs = written(pairs.distinct(), "unsure")
    full = _full_sets(written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "unsurenodes"), docs)
    home = full.select("node", "n").join(components(pairs, "clusters"), "node", "left").select("node", "n", F.coalesce("comp", "node").alias("cluster"))
    blocks = home.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    at = lambda x: F.pmod(F.xxhash64(x, F.lit(5)), F.col("blocks")).cast("int")
    dealt = pairs.join(home.select(F.col("node").alias("a"), "cluster").distinct(), "a").join(blocks, "cluster").select("cluster", F.least(at("a"), at("b")).alias("i"), F.greatest(at("a"), at("b")).alias("j"), "a", "b")
    members = dealt.select("cluster", "i", "j", F.explode(F.array("a", "b")).alias("node")).distinct().join(full.select("node", "s"), "node")
    both = members.select("cluster", "i", "j", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "s").union(dealt.select("cluster", "i", "j", F.lit(1), "a", "b", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, union = None, {}, _Union()
        for batch in batches:
            out = []
            for *here, kind, a, b, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if here != key:
                    key, held, union = here, {}, _Union()
                if not kind:
                    held.setdefault(a, []).append(np.frombuffer(s, np.uint64))
                    continue
                x, y = union.top(a), union.top(b)
                if x != y and any(_similar(p, q) for p in held[a] for q in held[b]):
                    union[max(x, y)] = min(x, y)
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return both.repartition(_tasks(both), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "kind").mapInArrow(run, "a long, b long")


class _Union(dict):
    def top(self, x: int) -> int:
        while (p := self.get(x, x)) != x:
            self[x] = self.get(p, p)
            x = p
        return x


def _common(rows: np.ndarray, items: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each strip of rows, the counts of the items that they share with every row."""
    _, inverse, counts = np.unique(items, return_inverse=True, return_counts=True)
    useful = counts[inverse] > 1
    cols, rows = np.unique(inverse[useful], return_inverse=True)[1], rows[useful]
    width, step = int(cols.max()) + 1 if len(cols) else 0, 2048
    slices = [(rows[here], cols[here] - lo, min(step, width - lo)) for lo in range(0, width, step) for here in [(cols >= lo) & (cols < lo + step)]]
    dense = None
    if len(slices) == 1:
        dense = _dense(slices[0], n)
    for top in range(0, n, STRIP):
        out = np.zeros((min(STRIP, n - top), n), np.float32)
        for part in slices:
            d = dense if dense is not None else _dense(part, n)
            out += d[top : top + STRIP] @ d.T
        yield out


def _dense(part: tuple, n: int) -> np.ndarray:
    out = np.zeros((n, part[2]), np.float32)
    out[part[0], part[1]] = 1
    return out


def _held(lists: list[np.ndarray], n: int) -> Iterator[np.ndarray]:
    return _common(np.repeat(np.arange(n), [len(x) for x in lists]), np.concatenate(lists), n)


def _likely(side: np.ndarray, comp: np.ndarray, n: np.ndarray, here: list, before: list, sketch: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, exact) for strips of pairs of members, in the order of n, that sketches alone do not rule out: members of
    different components and allowed sides that share a list of here, but none of before. exact: the sketches are the sets, which are similar."""
    size = len(sketch)
    held, todo = np.minimum(n, SKETCH_K), []
    for k, (share, met) in enumerate(zip(_held(here, size), _held(before, size), strict=True)):
        # sorted by n: a row and the columns behind it
        top = k * STRIP
        rows = np.arange(top, top + len(met))[:, None]
        open_ = (share > 0) & (met == 0) & (np.arange(size)[None, :] > rows) & (comp[rows] != comp[None, :]) & (4 * n[rows] >= 3 * n[None, :]) & ((side[rows] == 2) | (side[rows] != side[None, :])).all(axis=2)
        i, j = np.nonzero(open_)
        if len(i):
            todo.append((top, i, j))
    if not todo:
        return
    many = sum(len(i) for _, i, _ in todo) > 4 * size
    strips = _held(sketch, size) if many else iter(())
    at_strip = -STRIP
    for top, i, j in todo:
        while many and at_strip < top:
            shared, at_strip = next(strips), at_strip + STRIP
        a, b = i + top, j
        c = shared[i, j] if many else np.array([len(np.intersect1d(sketch[x], sketch[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        exact = n[b] <= SKETCH_K
        found = np.flatnonzero(np.where(exact, 100 * c >= 75 * (n[a] + n[b] - c), c >= LEAST_ESTIMATE * np.maximum(held[a], held[b]) - 1))
        # sure ones first: they spare others
        found = found[np.argsort(~exact[found], kind="stable")]
        yield a[found], b[found], exact[found]


def compare_block(side: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, here: list, before: list, sets: list, whole: bool = False) -> tuple[list[tuple[int, int]], list[int]]:
    """(edges among the members of one block pair, at most one for each member; the members whose pairs only full sets can judge).

    side (members x 1 or more): 0 and 1 for the two blocks of a pair, 2 for all members of a block that is compared with itself;
    every column must allow a pair. sets: the members' sketches, or their whole sets, which leave nothing unjudged.
    """
    order = np.argsort(n, kind="stable")
    node, comp, n, side = node[order], comp[order], n[order], side[order]
    sets, here, before = ([x[i] for i in order] for x in (sets, here, before))
    sketch = [x[:SKETCH_K] for x in sets]
    union, edges, unsure = _Union(), [], np.zeros(len(node), bool)
    for a, b, exact in _likely(side, comp, n, here, before, sketch):
        for i, j, sure in zip(a.tolist(), b.tolist(), exact.tolist(), strict=True):
            if not whole and not sure:
                if not (unsure[i] and unsure[j]) and estimate(sketch[i], sketch[j]) >= LEAST_ESTIMATE:
                    unsure[i] = unsure[j] = True
                continue
            if whole and sure:
                continue
            x, y = union.top(int(comp[i])), union.top(int(comp[j]))
            if x != y and (sure or (estimate(sketch[i], sketch[j]) >= LEAST_ESTIMATE and _similar(sets[i], sets[j]))):
                union[max(x, y)] = min(x, y)
                edges.append((int(node[i]), int(node[j])))
    return edges, order[unsure].tolist()


def _band():
    """Sets of similarity 0.75 have sizes of the same or of neighbouring bands."""
    return F.floor(F.ln("n") / F.ln(F.lit(4 / 3)) + 1e-9)


_MEMBER = "grp long, i long, j long, node long, comp long, side int, here array<long>, before array<long>"


def _residual(lists: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """Compare, inside tasks, the members of each list that are still in different components. Lists of two were compared as stars.
    Rows (a, b) are edges; rows without b are members of a block pair that whole sets must judge."""
    marked = lists.select("value", "node", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    found = marked.groupBy("value").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("grp"))
    open_lists = written(found.where("lo < hi and size > 2").select("value", "size", "grp"), "openlists")
    # a node is in a bounded number of lists; those of one group go together
    entered = spread_join(marked, open_lists, "value", "size", "node").groupBy("node", "n", "comp").agg(F.collect_list(F.struct("grp", "value")).alias("vs"))
    each = entered.select("node", "n", "comp", "vs", F.explode(F.array_distinct("vs.grp")).alias("grp"))
    of = lambda keep: F.transform(F.filter("vs", keep), lambda v: v["value"])
    members = written(each.select("grp", "node", "comp", _band().alias("band"), of(lambda v: v["grp"] == F.col("grp")).alias("here"), of(lambda v: v["grp"] < F.col("grp")).alias("before")), "members")
    bands = members.groupBy("grp", "band").agg(F.count("*").alias("size"))
    # a group that fits into one block is one; others have blocks for each band of sizes
    blocks = F.map_from_entries(F.transform("bands", lambda x: F.struct(x["band"], F.ceil(x["size"] / BLOCK))))
    groups = bands.groupBy("grp").agg(F.sum("size").alias("size"), F.collect_list(F.struct("band", "size")).alias("bands"))
    groups = written(groups.select("grp", "size", F.when(F.col("size") > BLOCK, blocks).alias("blocks")), "groups")
    chunks = lambda band: F.coalesce(F.try_element_at("blocks", band), F.lit(0).cast("long"))
    block = lambda band, k: band * (1 << 32) + k
    own = F.when(F.col("blocks").isNull(), F.lit(0).cast("long")).otherwise(block(F.col("band"), F.pmod(F.xxhash64("node", F.lit(5)), chunks(F.col("band")))))
    met = lambda band: F.when(chunks(band) > 0, F.transform(F.sequence(F.lit(0).cast("long"), chunks(band) - 1), lambda k: block(band, k))).otherwise(F.array().cast("array<long>"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.concat(*[met(F.col("band") + d) for d in (-1, 0, 1)]))
    dealt = (
        spread_join(members, groups, "grp", "size", "node")
        .select("grp", "node", "comp", "here", "before", own.alias("own"), F.explode(others).alias("other"))
        .select("grp", "node", "comp", "here", "before", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
        .join(known.select("node", "n", "sketch"), "node")
    )

    return _compared(dealt.select(*[f.split()[0] for f in _MEMBER.split(", ")], F.lit(0).alias("si"), F.lit(0).alias("sj"), F.lit(2).alias("sub"), "n", F.col("sketch").alias("s")), False)


def _deep(flagged: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): the edges among flagged members of block pairs, by whole sets. Blocks are cut again, so that a task's sets are bounded; no pair is listed."""
    full = _full_sets(written(flagged.select(F.col("node").alias("doc_id")).distinct(), "deepnodes"), docs)
    sized = flagged.join(full.groupBy("node").agg(F.sum("n").alias("n")), "node").groupBy("grp", "i", "j").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node", F.lit(6)), F.col("parts")).cast("int")
    each = flagged.join(sized, ["grp", "i", "j"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    si, sj = F.least("own", "other"), F.greatest("own", "other")
    sub = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    dealt = each.select(*[f.split()[0] for f in _MEMBER.split(", ")], si.alias("si"), sj.alias("sj"), sub.alias("sub")).join(full.select("node", "n", "s"), "node")
    return _compared(dealt, True).where("b is not null").select("a", "b").distinct()


def _compared(dealt: DataFrame, whole: bool) -> DataFrame:
    """Members dealt by (grp, i, j, si, sj) with their sketches or whole sets, compared: (a, b) for edges, (a, null, member columns) for members left to whole sets."""
    fields = [f.split()[0] for f in _MEMBER.split(", ")]
    schema = arrow_schema(f"a long, b long, {_MEMBER}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush():
            if len(held) < 2 or len({h[1] for h in held}) < 2:
                return None
            node, comp, side, here, before, sub, n, data = zip(*held, strict=True)
            arrays = [[np.array(x, np.int64) for x in lists] for lists in (here, before)]
            edges, unsure = compare_block(np.array([side, sub]).T, np.array(node), np.array(comp), np.array(n), *arrays, [np.frombuffer(x, np.uint64) for x in data], whole)
            rows = [(a, b, *[None] * len(fields)) for a, b in edges] + [(node[k], None, *key[:3], node[k], comp[k], side[k], here[k], before[k]) for k in unsure]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else None

        for batch in batches:
            for *where, node, comp, side, here, before, sub, n, data in zip(*[batch.column(c).to_pylist() for c in ("grp", "i", "j", "si", "sj", "node", "comp", "side", "here", "before", "sub", "n", "s")], strict=True):
                if where != key:
                    if (made := flush()) is not None:
                        yield made
                    key, held = where, []
                held.append((node, comp, side, here, before, sub, n, data))
        if (made := flush()) is not None:
            yield made
        held = []
        release()

    keys = ["grp", "i", "j", "si", "sj"]
    return dealt.repartition(_tasks(dealt), *keys).sortWithinPartitions(*keys, "node").mapInArrow(run, f"a long, b long, {_MEMBER}")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp): comp is the smallest node reachable; only nodes with edges. Alternating large and small stars."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(small, label)
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = state


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest linked doc_id), kept, class_id."""
    docs = pick(docs, "doc_id", "text")
    rows = written(sketches(docs), "sketches")
    named = rows.where("doc_id is not null and n > 0")
    low = F.substring("sketch", 1, 8 * LIST_K).alias("low")
    classes = written(named.select("set_key", "doc_id", "n", low).groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("low").alias("low")), "classes")
    lists = written(_postings(classes), "lists")
    known = written(_sketches_of(rows, classes, lists.select("node").distinct()), "known")
    centre = written(lists.groupBy("value").agg(F.max(F.struct("central", "node", "n")).alias("c"), F.count("*").alias("size")), "centres")
    stars = (
        spread_join(lists, centre, "value", "size", "node").where("node <> c.node and 4 * least(n, c.n) >= 3 * greatest(n, c.n)")
        .select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
    )
    edges = written(_verified(stars, known, docs), "edges")
    labels = components(edges)
    more = written(_residual(lists, labels, known), "residual")
    late = more.where("b is not null").select("a", "b").union(_deep(more.where("b is null").select(*[f.split()[0] for f in _MEMBER.split(", ")]).distinct(), docs))
    # a doc_id that repeats with different texts ties the classes it is in
    twice = named.groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("lo"), F.max(F.xxhash64("set_key")).alias("hi")).where("lo <> hi").select("doc_id")
    at = named.join(twice, "doc_id", "left_semi").join(classes.select("set_key", "node"), "set_key").groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("bs"))
    ties = at.select("a", F.explode("bs").alias("b")).where("a <> b")
    late = written(late.union(ties), "late")
    if not late.isEmpty():
        labels = components(edges.select("a", "b").union(late.select("a", "b")))
    home = classes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.col("node").alias("class_id"), F.coalesce("comp", "node").alias("found"))
    out = rows.select("doc_id", "n", "set_key").join(home, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("found"), F.col("doc_id")))
    component = F.when(F.col("n") > 0, component).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns: of each group of near duplicates the document with the smallest doc_id. Rows that repeat a kept doc_id with the same text
    are one: that whose columns, as JSON, come first. Rows without a doc_id stay."""
    inner, (doc_id, text), back = positional(docs, "doc_id", "text")
    found = near_duplicates(docs)
    gone = written(found.where("doc_id is not null and not kept").select("doc_id").distinct(), "gone")
    kept = inner.join(gone, inner[doc_id] == gone["doc_id"], "left_anti")
    often = written(inner.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").select(F.col(doc_id).alias("doc_id")), "repeated")
    if often.isEmpty():
        return back(kept)
    first = Window.partitionBy(doc_id, text).orderBy(F.to_json(F.struct(*inner.columns)))
    some = kept.join(often, kept[doc_id] == often["doc_id"], "left_semi").withColumn("turn", F.row_number().over(first)).where("turn = 1")
    return back(kept.join(often, kept[doc_id] == often["doc_id"], "left_anti").unionByName(some.select(*inner.columns)))
