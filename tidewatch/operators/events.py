"""Event seeds from qualifying edges, seed overlap, and the order-dependent merge of seeds."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GATED = ("contradiction", "same_fact", "same_event")
TOP_NEIGHBOURS = 5


def judged(pairs: DataFrame) -> DataFrame:
    """The offline judge: labels by score; the first three labels come with a confirmed referent."""
    label = F.when(F.col("score") >= 0.35, "same_fact").when(F.col("score") >= 0.30, "same_event").when(F.col("score") >= 0.28, "contradiction").otherwise("related")
    return pairs.withColumn("relation_label", label).withColumn("referent_status", F.when(F.col("relation_label").isin(*GATED), "confirmed").otherwise("not_confirmed")).withColumn("status", F.lit("valid"))


def qualifying_edges(judgments: DataFrame) -> DataFrame:
    return judgments.where(F.col("relation_label").isin(*GATED) & (F.col("status") == "valid") & (F.col("referent_status") == "confirmed")).select("claim_a", "claim_b", "score", "relation_label")


def seeds(edges: DataFrame, top: int = TOP_NEIGHBOURS) -> DataFrame:
    """(anchor, neighbor, score, rank): the best neighbours of every claim with an edge."""
    both = edges.select(F.col("claim_a").alias("anchor"), F.col("claim_b").alias("neighbor"), "score").union(edges.select("claim_b", "claim_a", "score"))
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "neighbor")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def seed_members(found: DataFrame) -> DataFrame:
    """(seed_id, claim_id, role, rank): the anchor and its neighbours; a seed is named by its anchor."""
    anchors = found.select(F.col("anchor").alias("seed_id"), F.col("anchor").alias("claim_id"), F.lit("anchor").alias("role"), F.lit(None).cast("int").alias("rank")).distinct()
    return anchors.union(found.select("anchor", "neighbor", F.lit("neighbor"), "rank"))


def overlap_pairs(members: DataFrame) -> DataFrame:
    """(seed_a, seed_b, shared): seeds that share claims."""
    m = members.select("seed_id", "claim_id").distinct()
    both = m.select(F.col("seed_id").alias("seed_a"), "claim_id").join(m.select(F.col("seed_id").alias("seed_b"), "claim_id"), "claim_id").where("seed_a < seed_b")
    return both.groupBy("seed_a", "seed_b").agg(F.array_sort(F.collect_set("claim_id")).alias("shared"))


Judge = Callable[[frozenset, frozenset], tuple[str, str | None]]


def fold(pairs: list[tuple[int, int, int]], claims: dict[int, frozenset], judge: Judge, home: dict[int, int]) -> list[tuple]:
    """Sequential merge by order. pairs: (order, a, b); home: seed to canonical event so far, changed in place.

    Each pair sees the state its predecessors left: two free seeds are compared with each other, a seed and a canonical
    event by the event's whole packet; same event on both sides: skipped; different events: deferred. judge gives
    (decision, summary), or invalid or transport_error as the decision, which change nothing. Returns (order, a, b,
    outcome, event, summary); an event is named by the smaller seed of its founding pair.
    """
    packets: dict[int, set] = {}
    for seed, event in home.items():
        packets.setdefault(event, set()).update(claims.get(seed, ()))
    out = []
    for order, a, b in sorted(pairs):
        ea, eb = home.get(a), home.get(b)
        if ea is not None and ea == eb:
            out.append((order, a, b, "skipped_same", ea, None))
        elif ea is not None and eb is not None:
            out.append((order, a, b, "deferred", None, None))
        else:
            left = frozenset(packets[ea]) if ea is not None else claims[a]
            right = frozenset(packets[eb]) if eb is not None else claims[b]
            said, summary = judge(left, right)
            event = None
            if said == "same_event":
                event = ea if ea is not None else eb if eb is not None else min(a, b)
                for s in (a, b):
                    home[s] = event
                packets.setdefault(event, set()).update(claims[a], claims[b])
                said = "extended" if ea is not None or eb is not None else "created"
            out.append((order, a, b, said, event, summary))
    return out


def overlap_judge(a: frozenset, b: frozenset) -> tuple[str, str | None]:
    """Deterministic stand-in for the merge model: by shared claims. Pairs with an odd number of claims in all and little in common stand for answers that break the contract."""
    share = len(a & b) / min(len(a), len(b))
    if share >= 0.5:
        return "same_event", f"{len(a | b)} claims"
    return ("insufficient" if share >= 0.34 else "invalid" if len(a | b) % 5 == 0 else "different_event"), None


def canonical_events(merged: DataFrame) -> DataFrame:
    """(event_id, created, updated, summary): each extension overwrites the summary and moves updated; both are places in the merge's order."""
    made = merged.where("outcome in ('created', 'extended')")
    return made.groupBy("event_id").agg(F.min("seq").alias("created"), F.max("seq").alias("updated"), F.max_by("summary", "seq").alias("summary"))


def event_members(merged: DataFrame) -> DataFrame:
    """(event_id, seed_id, added): the seeds of each event, with the place in the order that brought them."""
    sides = merged.where("outcome in ('created', 'extended')").select("event_id", "seq", F.explode(F.array("seed_a", "seed_b")).alias("seed_id"))
    return sides.groupBy("event_id", "seed_id").agg(F.min("seq").alias("added"))


def event_packets(event_seeds: DataFrame, members: DataFrame) -> DataFrame:
    """(event_id, claim_id, role): the union of an event's seed members, a claim's role being that in the seed that came first."""
    return event_seeds.join(members.select("seed_id", "claim_id", "role"), "seed_id").groupBy("event_id", "claim_id").agg(F.min_by("role", F.struct("added", "seed_id")).alias("role"))


def merge(pairs: DataFrame, members: DataFrame, components: Callable[[DataFrame], DataFrame], judge: Callable = overlap_judge, limit: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(seq within its component, seed_a, seed_b, outcome, event_id, summary). The backlog order and limit come first; then each component of
    the pairs (and of what is merged already) is folded on its own, which equals the global fold. A fold is sequential by its nature:
    a task holds one component's pairs and claim ids, nothing else."""
    batch = pairs.withColumn("n", F.size("shared")).select("seed_a", "seed_b", "n").orderBy(F.desc("n"), "seed_a", "seed_b")
    batch = (batch.limit(limit) if limit is not None else batch).withColumn("seq", -F.col("n"))
    ties = batch.select(F.col("seed_a").alias("a"), F.col("seed_b").alias("b"))
    if known is not None:
        first = known.groupBy("event_id").agg(F.min("seed_id").alias("b"))
        ties = ties.union(known.join(first, "event_id").select(F.col("seed_id").alias("a"), "b"))
    home = components(ties)
    packets = members.groupBy("seed_id").agg(F.array_sort(F.collect_set("claim_id")).alias("claims"))
    place = home.join(packets, home["node"] == packets["seed_id"], "left").select("node", "comp", "claims")
    if known is not None:
        place = place.join(known.select(F.col("seed_id").alias("node"), "event_id"), "node", "left")
    else:
        place = place.withColumn("event_id", F.lit(None).cast("long"))
    rows = place.select("comp", F.col("node").alias("seed_a"), F.lit(None).cast("long").alias("seed_b"), F.lit(None).cast("int").alias("seq"), "claims", "event_id").union(
        batch.join(home.select(F.col("node").alias("seed_a"), "comp"), "seed_a").select("comp", "seed_a", "seed_b", "seq", F.lit(None).cast("array<long>"), F.lit(None).cast("long"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, todo = pdf[pdf["seq"].isna()], pdf[pdf["seq"].notna()]
        claims = {int(s): frozenset(int(x) for x in (c if c is not None else ())) for s, c in zip(nodes["seed_a"], nodes["claims"], strict=True)}
        before = {int(s): int(e) for s, e in zip(nodes["seed_a"], nodes["event_id"], strict=True) if pd.notna(e)}
        turns = sorted((int(r.seq), int(r.seed_a), int(r.seed_b)) for r in todo.itertuples())
        done = fold([(k, a, b) for k, (_, a, b) in enumerate(turns, 1)], claims, judge, before)
        return pd.DataFrame(done, columns=["seq", "seed_a", "seed_b", "outcome", "event_id", "summary"]).astype({"event_id": "Int64"})

    return rows.groupBy("comp").applyInPandas(run, "seq int, seed_a long, seed_b long, outcome string, event_id long, summary string")


def label_components(edges: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, comp) by iterated smallest label; every node of an edge has a row."""
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node")
    while True:
        labels = checkpoint(labels)
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "c").alias("comp"))
        # pointer jumping: the label's own label
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step = checkpoint(step.join(jump, "comp").select("node", F.col("up").alias("comp")))
        if step.exceptAll(labels).isEmpty():
            return step
        labels = step
