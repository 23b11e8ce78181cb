"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers floor(scale * x), and are dealt out by ranges of their length (and id, so that many of one length are
no single task's). Queries are broadcast in portions of fixed size; each portion is one pass over
the vectors. A task's vectors, of like lengths, are sorted by length and cut into buckets. For each bucket and query the score
to beat, divided by the two lengths, is a local cosine threshold: above 1 the query skips this and all later
buckets; when high, the query's largest coordinates bound the same coordinates of any vector that can still
win; otherwise length alone prunes. Whatever is left is verified by full integer products. Scores to beat start from
the longest vectors of all, a bounded set, and from a search of a sample, so that few vectors leave each task.

Equal vectors of a task count once with their k + 1 smallest ids: no more of them can be among k winners.

Edge cases: vectors that are null, or hold null or non-finite components, and rows with a null vec_id take no part; a
query and a vector of different dimensions have no product; rows with the query's own vec_id are no candidates of
it; equal rows of one vec_id are one query; ties go to the smaller vec_id; products are clipped to 64 bits; vectors of any dimension
are taken whole; without vectors or queries there are no rows; other columns, also ones whose names differ from vec_id or
embedding in case only, play no part. The number of portions depends on the number of queries and changes no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, pick, written

K, SCALE, EVERY = 5, 256, 50
#: Queries of one portion, vectors a task sorts at once, vectors of a bucket, vectors that set the first scores to beat.
PORTION, GROUP, BUCKET, SEEDS = 16_384, 32_768, 2_048, 2_048
#: One of so many vectors is in the sample that is searched first.
SAMPLE = 64
#: From this local cosine on, coordinates prune better than a dense product.
COORDINATE_COSINE, FOCUS = 0.9, 3
_EXACT = 2.0**53


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, norm, v): integer components as little-endian doubles, which hold them exactly."""

    def start():
        def row(vec_id: int | None, x: list | None) -> Iterator[tuple]:
            if vec_id is None or not x or None in x:
                return
            v = np.array(x, np.float64)
            if np.isfinite(v).all():
                v = np.floor(scale * v)
                yield vec_id, len(v), float(np.sqrt(np.dot(v, v))), v.tobytes()

        return row

    return map_rows(pick(vectors, "vec_id", "embedding"), start, "vec_id long, dim int, norm double, v binary")


def _products(q: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    if largest < _EXACT:
        return q @ x.T
    exact = np.array([[int(np.dot(np.array([int(c) for c in a], object), np.array([int(c) for c in b], object))) for b in x] for a in q], object).reshape(len(q), len(x))
    return np.clip(exact, -(2**63), 2**63 - 1)


def _below(score):
    """A bound under a score that doubles may not hold exactly."""
    return score - np.where(np.abs(score) < _EXACT, 0.0, np.abs(score) * 1e-12)


class Retriever:
    """Running winners of a portion of queries of one dimension."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, beat: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, matrix, k
        self.norm = np.sqrt((matrix**2).sum(axis=1))
        self.beat = np.full(len(ids), -np.inf) if beat is None else beat.astype(float)
        safe = np.maximum(self.norm, 1e-300)[:, None]
        self.unit = matrix / safe
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]

    def _offer(self, i: int, scores, vec_ids) -> None:
        # own rows are no candidates
        mine = int(self.ids[i])
        found = self.best[i] + [(-s, v) for s, v in zip(scores, vec_ids, strict=True) if v != mine]
        found.sort()
        self.best[i] = found = found[: self.k]
        if len(found) == self.k:
            self.beat[i] = max(self.beat[i], _below(float(-found[-1][0])))

    def group(self, vec_ids: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        """Offer many vectors: drop surplus equal ones, sort by length, go through the buckets."""
        order = np.argsort(vec_ids, kind="stable")
        vec_ids, x, norms = vec_ids[order], np.ascontiguousarray(x[order]), norms[order]
        same = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
        by = np.argsort(same, kind="stable")
        run = np.arange(len(by)) - np.searchsorted(same[by], same[by])
        keep = np.sort(by[run <= self.k])
        vec_ids, x, norms = vec_ids[keep], x[keep], norms[keep]
        order = np.argsort(-norms, kind="stable")
        vec_ids, x, norms = vec_ids[order], x[order], norms[order]
        for lo in range(0, len(vec_ids), BUCKET):
            if not self.bucket(vec_ids[lo : lo + BUCKET], x[lo : lo + BUCKET], norms[lo : lo + BUCKET]):
                break

    def bucket(self, vec_ids: np.ndarray, x: np.ndarray, norms: np.ndarray) -> bool:
        """False: no query can gain from this bucket or any later one."""
        top = norms[0]
        reach = self.norm * top * (1 + 1e-9) + 1e-6
        active = np.flatnonzero(reach >= self.beat)
        if not len(active):
            return False
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach[active] > 0, self.beat[active] / reach[active], -np.inf)
        steep = active[cosine >= COORDINATE_COSINE]
        flat = active[cosine < COORDINATE_COSINE]
        largest = float((np.abs(self.q).max(initial=0)) * (np.abs(x).max(initial=0)) * x.shape[1])
        if len(steep):
            unit = x / np.maximum(norms, 1e-300)[:, None]
            for i in steep.tolist():
                t = min(1.0, self.beat[i] / (self.norm[i] * top * (1 + 1e-9) + 1e-6))
                ok = self.norm[i] * norms * (1 + 1e-9) + 1e-6 >= self.beat[i]
                for f in self.focus[i].tolist():
                    # the angle to the axis differs from the query's by the angle of t at most
                    alpha, wide = np.arccos(np.clip(self.unit[i, f], -1, 1)), np.arccos(t)
                    low, high = np.cos(min(np.pi, alpha + wide)) - 1e-6, np.cos(max(0.0, alpha - wide)) + 1e-6
                    ok &= (unit[:, f] >= low) & (unit[:, f] <= high)
                at = np.flatnonzero(ok)
                if len(at):
                    s = _products(self.q[i : i + 1], x[at], largest)[0]
                    won = np.flatnonzero(s >= self.beat[i])
                    self._offer(i, [int(v) for v in s[won]], vec_ids[at[won]].tolist())
        for lo in range(0, len(flat), 256):
            some = flat[lo : lo + 256]
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.min(np.where(self.norm[some] > 0, (self.beat[some] - 1e-6) / (self.norm[some] * (1 + 1e-9)), -np.inf))
            n = int(np.searchsorted(-norms, -least, side="right")) if np.isfinite(least) else len(norms)
            if not n:
                continue
            s = _products(self.q[some], x[:n], largest)
            bound = self.beat[some]
            if n > self.k + 1:
                # one more than k, as one of them may be the query itself
                bound = np.maximum(bound, _below(np.partition(s.astype(float), n - self.k - 1, axis=1)[:, n - self.k - 1]))
            rows, cols = np.nonzero(s >= bound[:, None])
            cut = np.searchsorted(rows, np.arange(len(some) + 1))
            for j, i in enumerate(some.tolist()):
                at = cols[cut[j] : cut[j + 1]]
                if len(at):
                    self._offer(i, [int(v) for v in s[j, at]], vec_ids[at].tolist())
        return True


def _offered(data: DataFrame, sent, k: int) -> DataFrame:
    """(query_id, twin, vec_id, score): for each task and query, up to k vectors that reach the query's score to beat. twin tells equal query ids apart."""
    ddl = "query_id long, twin long, vec_id long, score long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        made: dict[int, Retriever] = {}

        def flush(dim: int) -> None:
            rows = held.pop(dim, [])
            if rows and dim in sent.value:
                if dim not in made:
                    ids, matrix, beat = sent.value[dim]
                    made[dim] = Retriever(ids, matrix, k, beat.copy())
                made[dim].group(np.array([r[0] for r in rows]), np.stack([np.frombuffer(r[3]) for r in rows]), np.array([r[2] for r in rows]))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = held.setdefault(row[1], [])
                rows.append(row)
                if len(rows) >= GROUP:
                    flush(row[1])
        for dim in list(held):
            flush(dim)
        for dim, r in made.items():
            out = [(int(q), (dim << 32) + i, v, -s) for i, q in enumerate(r.ids) for s, v in r.best[i]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return data.select("vec_id", "dim", "norm", "v").mapInArrow(run, ddl)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY, portion: int = PORTION) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, its k best rows of all."""
    spark = vectors.sparkSession
    # dealing by ranges reads its input twice: a stored one
    data = written(written(quantised(vectors, scale), "quantised").repartitionByRange(F.desc("norm"), "vec_id"), "vectors")
    queries = data.where(F.col("vec_id") % every == 0).select("vec_id", "dim", "v").distinct()
    total = queries.count()
    seeds = [(r.vec_id, r.dim, r.norm, bytes(r.v)) for r in data.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect()]
    few = written(data.where(F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(SAMPLE)) == 0), "sample")
    portions, found = max(1, -(-total // portion)), None
    for p in range(portions):
        here = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(portions)) == p) if portions > 1 else queries
        by_dim: dict[int, list[tuple[int, bytes]]] = {}
        for r in here.orderBy("vec_id", "v").collect():
            by_dim.setdefault(r.dim, []).append((r.vec_id, bytes(r.v)))
        packed = {}
        for dim, rows in by_dim.items():
            ids, matrix = np.array([a for a, _ in rows]), np.stack([np.frombuffer(b) for _, b in rows])
            first = Retriever(ids, matrix, k)
            mine = [s for s in seeds if s[1] == dim]
            if mine:
                first.group(np.array([s[0] for s in mine]), np.stack([np.frombuffer(s[3]) for s in mine]), np.array([s[2] for s in mine]))
            packed[dim] = (ids, matrix, first.beat)
        # the k-th best of a sample is a better score to beat: what leaves the tasks does not grow with their number
        for r in _ranked(_offered(few, spark.sparkContext.broadcast(packed), k), k).groupBy("twin").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect():
            beat = packed[r.twin >> 32][2]
            beat[r.twin & 0xFFFFFFFF] = max(beat[r.twin & 0xFFFFFFFF], _below(float(r.least)))
        part = _offered(data, spark.sparkContext.broadcast(packed), k)
        part = written(part, "winners") if portions > 1 else part
        found = part if found is None else found.union(part)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
