"""Exact semantic search and its enrichment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "content_id") -> DataFrame:
    """(key, similarity): each task keeps k rows, the driver none."""
    if k < 1:
        raise ValueError("limit must be positive")
    return vectors.select(key, F.round(S.dots(F.col("embedding"), [query])[0], 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def encoded_query(text: str, encode: Callable[[list[str]], object]) -> list[float]:
    """The vector of a query text."""
    if not text.strip():
        raise ValueError("the query is blank")
    return [float(x) for x in encode([text])[0]]


def content_sources(content_ids: DataFrame, occurrences: DataFrame, sources: DataFrame) -> DataFrame:
    """(content_id, sources, occurrence_count) of the named content: distinct sources with type and contour, sorted; all occurrences counted."""
    own = occurrences.join(F.broadcast(content_ids), "content_id").join(sources.select("source_id", "source_type", "contour_id"), "source_id")
    return own.groupBy("content_id").agg(F.array_sort(F.collect_set(F.struct("source_id", "source_type", "contour_id"))).alias("sources"), F.count("*").alias("occurrence_count"))


def search_content(vectors: DataFrame, query: list[float], k: int, content: DataFrame, occurrences: DataFrame, sources: DataFrame, snippet: int = 200) -> DataFrame:
    """The k nearest content with snippet, first sighting, sources and occurrence count. k rows are enriched, not the corpus: k bounds what is broadcast."""
    hits = top_k(vectors, query, k)
    own = content.join(F.broadcast(hits), "content_id").select("content_id", "similarity", T.preview(F.col("canonical_text"), snippet).alias("snippet"), F.col("first_seen").alias("first_observed_at"))
    return own.join(content_sources(hits.select("content_id"), occurrences, sources), "content_id", "left").select("content_id", "similarity", "snippet", "first_observed_at", "sources", F.coalesce("occurrence_count", F.lit(0)).alias("occurrence_count"))


def canonical_event_of(claims: DataFrame, included: DataFrame, event_members: DataFrame, events: DataFrame) -> DataFrame:
    """claims with the event_id and summary of the first created event that holds them, null where there is none. included: (seed_id, claim_id) of accepted seeds."""
    linked = included.join(event_members.select("seed_id", "event_id"), "seed_id").join(events.select("event_id", "summary", "created"), "event_id")
    first = linked.groupBy("claim_id").agg(F.min_by(F.struct("event_id", "summary"), F.struct("created", "event_id")).alias("e")).select("claim_id", "e.event_id", "e.summary")
    return claims.join(first, "claim_id", "left")


def search_claims(vectors: DataFrame, query: list[float], k: int, claims: DataFrame, runs: DataFrame, content: DataFrame, occurrences: DataFrame, sources: DataFrame, included: DataFrame, event_members: DataFrame, events: DataFrame, snippet: int = 200) -> DataFrame:
    """The k nearest claims with text, status, span, the content they are from, its sources, and their canonical event."""
    hits = top_k(vectors, query, k, "claim_id")
    own = claims.join(F.broadcast(hits), "claim_id").join(runs.select("run_id", "content_id"), "run_id")
    own = own.join(content.select("content_id", T.preview(F.col("canonical_text"), snippet).alias("snippet"), F.col("first_seen").alias("observed_at")), "content_id", "left")
    own = own.join(content_sources(own.select("content_id").distinct(), occurrences, sources), "content_id", "left")
    linked = canonical_event_of(own, included, event_members, events)
    return linked.select("claim_id", "similarity", "claim_text", "epistemic_status", "evidence_span", "content_id", "snippet", "sources", "observed_at", "event_id", F.col("summary").alias("event_summary"))


def result_document(rows: DataFrame, query: str, scope: str, model: dict[str, str], revision: str, order: list) -> DataFrame:
    """One JSON object (column value): the query, model identity, code revision and the rows, which a search limits."""
    items = rows.select(F.struct(*rows.columns).alias("r"), F.row_number().over(Window.orderBy(*order)).alias("k"))
    listed = items.agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("l")).select(F.transform("l", lambda x: x["r"]).alias("results"))
    head = [F.lit(query).alias("query"), F.lit(scope).alias("scope"), F.struct(*[F.lit(v).alias(k) for k, v in sorted(model.items())]).alias("model"), F.lit(revision).alias("code_revision")]
    return listed.select(F.to_json(F.struct(*head, "results"), {"ignoreNullFields": "false"}).alias("value"))


def enrich(hits: DataFrame, occurrences: DataFrame) -> DataFrame:
    """hits with their sources and occurrence count: k rows are joined, not the corpus."""
    own = occurrences.join(F.broadcast(hits.select("content_id")), "content_id")
    return hits.join(own.groupBy("content_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources"), F.count("*").alias("n_occurrences")), "content_id", "left")


def first_event(claims: DataFrame, members: DataFrame) -> DataFrame:
    """(claim_id, seed_id): the earliest seed that holds a claim."""
    w = Window.partitionBy("claim_id").orderBy("seed_id")
    first = members.select("claim_id", "seed_id").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return claims.join(first, "claim_id", "left")
