"""Candidate pairs of claims across groups: best n by cosine, computed block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Claims of a block, claims of the sample that sets the first score to beat, distinct group sets at most (the groups are a small registry).
BLOCK, SAMPLE, MAX_SETS = 512, 2048, 4096


def group_sets(occurrences: DataFrame, sources: DataFrame) -> DataFrame:
    """(content_id, contours): distinct contours that are not null, sorted; content without any has no row."""
    return occurrences.join(sources.select("source_id", "contour_id"), "source_id").where("contour_id is not null").groupBy("content_id").agg(F.array_sort(F.collect_set("contour_id")).alias("contours"))


def _scores(ia: np.ndarray, ra: list, ma: np.ndarray, ib: np.ndarray, rb: list, mb: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower id, higher id, score) of the best n pairs of two blocks that beat least and come from different runs."""
    s = np.round(ma @ mb.T, 6)
    s[np.asarray(ra, object)[:, None] == np.asarray(rb, object)[None, :]] = -np.inf
    x, y = np.nonzero(s >= least)
    lo, hi, flat = np.minimum(ia[x], ib[y]), np.maximum(ia[x], ib[y]), s[x, y]
    best = np.lexsort((hi, lo, -flat))[:n]
    return lo[best], hi[best], flat[best]


def _least_score(claims: DataFrame, n: int) -> float:
    """The n-th best score among a sample of the claims, which the n-th of all reaches: a bound under all winners."""
    rows = claims.orderBy(F.xxhash64("claim_id", F.lit(7)), "claim_id").limit(SAMPLE).collect()
    if len(rows) < 2:
        return -2.0**62
    m = np.array([r.embedding for r in rows], np.float64)
    s, found = np.round(m @ m.T, 6), []
    sets = [frozenset(r.contours) for r in rows]
    for i, a in enumerate(rows):
        found += [s[i, j] for j in range(i) if a.run_id != rows[j].run_id and not sets[i] & sets[j]]
    return float(np.sort(np.array(found))[-n]) if len(found) >= n else -2.0**62


def ranked_pairs(claims: DataFrame, n: int, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(claim_a, claim_b, score): the best n pairs of claims (claim_id, run_id, contours, embedding) from different runs
    whose contour sets are disjoint. stored writes a table and reads it back.

    Claims with the same set of contours are packed into blocks. The pairs of blocks that may meet are a table of block
    names; it fetches the two matrices, one matrix product gives the pair's best, and only scores that beat the n-th of a
    sample leave a task. Sizes of blocks and of each result are bounded.
    """
    claims = stored(claims.select("claim_id", "run_id", "contours", "embedding"))
    least = _least_score(claims, n)
    keyed = claims.withColumn("key", F.array_join("contours", ",")).withColumn("chunk", F.pmod(F.xxhash64("claim_id"), F.lit(1 << 20)))
    sizes = keyed.groupBy("key").agg(F.first("contours").alias("contours"), F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")).limit(MAX_SETS + 1).collect()
    if len(sizes) > MAX_SETS:
        raise ValueError("too many distinct contour sets")
    meets = [(a.key, b.key, a.chunks, b.chunks) for a in sizes for b in sizes if a.key < b.key and not set(a.contours) & set(b.contours)]
    spark = claims.sparkSession
    if not meets:
        return spark.createDataFrame([], "claim_a long, claim_b long, score double")
    names = spark.createDataFrame([(r.key, r.chunks) for r in sizes], "key string, chunks int")
    packed = keyed.join(F.broadcast(names), "key").withColumn("chunk", F.pmod("chunk", F.col("chunks")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "ids": [pdf["claim_id"].astype("int64").to_numpy().tobytes()], "runs": [pdf["run_id"].astype(str).tolist()], "m": [m.tobytes()]})

    blocks = stored(packed.select("key", "chunk", "claim_id", F.col("run_id").cast("string").alias("run_id"), "embedding").groupBy("key", "chunk").applyInPandas(pack, "key string, chunk long, ids binary, runs array<string>, m binary"))
    chunk = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
    wanted = spark.createDataFrame(meets, "ka string, kb string, na int, nb int").withColumn("ca", chunk("na")).withColumn("cb", chunk("nb")).select("ka", "ca", "kb", "cb")
    side = lambda x: blocks.select(F.col("key").alias(f"k{x}"), F.col("chunk").alias(f"c{x}"), F.col("ids").alias(f"i{x}"), F.col("runs").alias(f"r{x}"), F.col("m").alias(f"m{x}"))
    both = wanted.join(side("a"), ["ka", "ca"]).join(side("b"), ["kb", "cb"]).select("ia", "ra", "ma", "ib", "rb", "mb")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                ia, ib = np.frombuffer(r.ia, np.int64), np.frombuffer(r.ib, np.int64)
                lo, hi, flat = _scores(ia, list(r.ra), np.frombuffer(r.ma).reshape(len(ia), -1), ib, list(r.rb), np.frombuffer(r.mb).reshape(len(ib), -1), n, least)
                yield pd.DataFrame({"claim_a": lo, "claim_b": hi, "score": flat})

    found = both.mapInPandas(score, "claim_a long, claim_b long, score double")
    return found.orderBy(F.desc("score"), "claim_a", "claim_b").limit(n)


def with_delta_hours(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """pairs with the absolute distance of the first sightings (claim_id, first_seen) in hours."""
    a, b = seen.select(F.col("claim_id").alias("claim_a"), F.col("first_seen").alias("ta")), seen.select(F.col("claim_id").alias("claim_b"), F.col("first_seen").alias("tb"))
    hours = F.abs(F.unix_micros("ta") - F.unix_micros("tb")) / 3.6e9
    return pairs.join(a, "claim_a").join(b, "claim_b").select("claim_a", "claim_b", "score", hours.alias("delta_hours"))
