"""The model stages, the registry, the collected sources and the search documents as queries; they join the registry of queries."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contours, events, models, pairs, reporting, routing, search, stages, writes
from ..sources import collect, registry
from ..sources import views as V
from . import queries as Q
from .queries import ALIASES, CANDIDATES, CLAIMS, INGEST, JUDGED, ORACLES, QUERIES, ROUTED, SEEDS, SOURCES, checkpointed, query

__all__ = ["ORACLES", "QUERIES"]

CONTRACT = {"model_id": 7, "prompt_id": 3, "attempt_no": 1}
#: A fixed revision: the rows of a query are the same whatever the working tree is.
REVISION = "0000000"
CLAIM_PROMPT, PAYLOAD_PROMPT = "id=<<EVIDENCE_ID>>\n<<EVIDENCE_TEXT>>", "Judge this:\n<<PAYLOAD_JSON>>"


# ---------------------------------------------------------------- offline clients


def claim_client():
    """One claim, the first sentence, with offsets that are never right; some calls time out, some answers are no JSON or fenced."""

    def call(prompt: str) -> str:
        head, text = prompt.split("\n", 1)
        key = int(head.removeprefix("id="))
        if key % 11 == 5:
            raise TimeoutError("late")
        if key % 7 == 3:
            return "oops"
        end = text.find(".")
        span = text if end < 0 else text[: end + 1]
        claim = {"claim_local_id": "c1", "claim_text": "said: " + span, "evidence_span": span, "evidence_start": 0, "evidence_end": 0, "epistemic_status": "reported", "claim_time_text": None, "attribution_text": None}
        raw = json.dumps({"schema_version": "claim-extraction/1", "evidence_id": str(key), "claims": [claim]}, ensure_ascii=False)
        return f"```json\n{raw}\n```" if key % 5 == 2 else raw

    return call


def relation_client():
    """Answers by the sum of the claim ids: right ones, ungrounded ones, ones that break the gate or name another pair."""

    def call(prompt: str) -> str:
        payload = json.loads(prompt.split("\n", 1)[1])
        a, b = (int(x) for x in payload["pair_id"].split("-"))
        quote = f"«{payload['claim_a']['evidence_span'][:5]}»"
        label, status, evidence, pair = {
            0: ("same_fact", "confirmed", quote, payload["pair_id"]), 1: ("same_fact", "not_confirmed", quote, payload["pair_id"]), 2: ("related", "not_confirmed", "none", payload["pair_id"]),
            3: ("contradiction", "confirmed", "«\u0001»", payload["pair_id"]), 4: ("same_event", "confirmed", quote, payload["pair_id"]), 5: ("unrelated", "insufficient", "none", "other"),
        }[(a + b) % 6]
        raw = json.dumps({"schema_version": "relation-judgment/2", "pair_id": pair, "shared_referent_status": status, "shared_referent_evidence": evidence, "relation_label": label, "rationale_text": "why"})
        return f"```\n{raw}\n```" if (a + b) % 6 == 4 else raw

    return call


def event_client():
    """Accepted, rejected, accepted without a neighbour, or no answer, by the seed's id."""

    def call(prompt: str) -> str:
        payload = json.loads(prompt.split("\n", 1)[1])
        seed = int(payload["event_candidate_id"])
        if seed % 4 == 3:
            raise ConnectionError("down")
        taken = {0: lambda c: True, 1: lambda c: False, 2: lambda c: c["role"] == "anchor"}[seed % 4]
        members = [{"claim_id": c["claim_id"], "included": taken(c), "member_rationale": c["role"]} for c in payload["claims"]]
        accepted = seed % 4 != 1
        return json.dumps({"schema_version": "event-verification/1", "event_candidate_id": str(seed), "event_decision": "accepted_seed" if accepted else "rejected_seed", "event_summary": f"{len(members)} claims" if accepted else None, "members": members, "rationale_text": "why"})

    return call


# ---------------------------------------------------------------- stages


def extraction_backlog(spark, sf):
    _, content, occ = Q.ingested(spark, sf)
    return content.select("content_id", "canonical_text").join(occ.select("content_id"), "content_id", "left_semi")


def runs(spark, sf):
    return checkpointed(stages.extract_claims(extraction_backlog(spark, sf), CLAIM_PROMPT, claim_client, CONTRACT, REVISION, checkpointed))


_SPAN = "CASE WHEN strpos(canonical_text, '.') > 0 THEN left(canonical_text, strpos(canonical_text, '.')) ELSE canonical_text END"
RUNS = INGEST + f""",
sp AS (SELECT content_id, canonical_text, {_SPAN} AS span FROM content WHERE content_id IN (SELECT content_id FROM occ)),
ct AS (SELECT *, (length(canonical_text) - length(replace(canonical_text, span, ''))) // length(span) AS k FROM sp),
rn AS (SELECT content_id, canonical_text, span, CASE WHEN content_id % 11 = 5 THEN 'transport_error' WHEN content_id % 7 = 3 OR k <> 1 THEN 'invalid' ELSE 'valid' END AS status,
    CASE WHEN content_id % 11 = 5 THEN NULL WHEN content_id % 7 = 3 THEN 0 ELSE 1 END AS claim_count FROM ct)"""


@query("extraction_runs", RUNS + " SELECT content_id, status, CAST(claim_count AS INTEGER) AS claim_count, sha256(content_id || '|7|3|1') AS run_id FROM rn")
def _(spark, sf):
    return runs(spark, sf).select("content_id", "status", "claim_count", "run_id")


@query("extracted_claims", RUNS + " SELECT content_id, 'c1' AS claim_local_id, 'said: ' || span AS claim_text, strpos(canonical_text, span) - 1 AS evidence_start, strpos(canonical_text, span) - 1 + length(span) AS evidence_end FROM rn WHERE status = 'valid'")
def _(spark, sf):
    found, root = runs(spark, sf), f"{Q.shared_dir(spark)}/extraction-{uuid.uuid4().hex}"
    # the second call finds everything there and adds nothing
    for _ in range(2):
        writes.append_runs(found.drop("claims"), stages.claim_rows(found), root, checkpointed)
    claims = writes.committed_children(spark, root, ["claim_id"])
    return claims.join(spark.read.parquet(f"{root}/runs").select("run_id", "content_id"), "run_id").select("content_id", "claim_local_id", "claim_text", "evidence_start", "evidence_end")


@query("embedding_stage", INGEST + " SELECT content_id, 1 AS embedding_model_id, 64 AS dim, CAST(1 AS DOUBLE) AS length FROM content WHERE content_id IN (SELECT content_id FROM occ) AND content_id NOT IN (SELECT vec_id FROM embeddings) AND regexp_matches(canonical_text, '\\S')")
def _(spark, sf):
    _, content, occ = Q.ingested(spark, sf)
    made = stages.embed_pending(content, occ, V.vectors(spark, sf), V.MODEL_ID, models.hashing_embedder, 64)
    length = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), 4)
    return made.select("content_id", "embedding_model_id", F.size("embedding").alias("dim"), length.alias("length"))


def claim_tables(spark, sf):
    """(claims, runs, content, occurrences, sources): every content with a vector has a run with one claim, its first sentence; the claim's id is the content's."""
    _, content, occ = Q.ingested(spark, sf)
    held = content.join(V.vectors(spark, sf).select("content_id"), "content_id", "left_semi")
    span = F.when(F.instr("canonical_text", ".") > 0, F.substring_index("canonical_text", ".", 1)).otherwise(F.col("canonical_text"))
    claims = held.select(F.col("content_id").alias("claim_id"), F.concat(F.lit("r"), "content_id").alias("run_id"), F.concat(F.lit("said: "), span).alias("claim_text"), span.alias("evidence_span"), F.lit(0).alias("evidence_start"), F.length(span).alias("evidence_end"), F.lit("reported").alias("epistemic_status"))
    title = F.when(F.col("content_id") % 2 == 0, F.substring("canonical_text", 1, 30))
    return claims, held.select(F.concat(F.lit("r"), "content_id").alias("run_id"), "content_id"), content.withColumn("title", title), occ, V.sources(spark, sf)


def meta(spark, sf):
    return checkpointed(stages.claim_meta(*claim_tables(spark, sf), around=20))


META = SOURCES + "," + INGEST + """,
so AS (SELECT o.content_id, list_sort(list(DISTINCT s.contour_id) FILTER (WHERE s.contour_id IS NOT NULL)) AS cs, min(o.collected_at) AS first_seen, arg_min(s.source_id || ' (' || s.source_type || ')', (o.collected_at, s.source_id)) AS source FROM occ o JOIN sources s ON s.source_id = o.source_id GROUP BY o.content_id),
me AS (SELECT c.content_id AS claim_id, split_part(canonical_text, '.', 1) AS span, canonical_text, CASE WHEN c.content_id % 2 = 0 THEN left(canonical_text, 30) END AS title, coalesce(array_to_string(cs, ','), '') AS contour_set, so.first_seen, source FROM content c JOIN embeddings e ON e.vec_id = c.content_id LEFT JOIN so ON so.content_id = c.content_id),
ms AS (SELECT *, left(canonical_text, least(length(canonical_text), length(span) + 20)) AS snippet FROM me)"""


@query("claim_meta", META + " SELECT claim_id, title, snippet AS context_snippet, contour_set, first_seen, source, sha256('said: ' || span || chr(10) || span || chr(10) || coalesce(title, '') || chr(10) || snippet) AS groundable FROM ms")
def _(spark, sf):
    return meta(spark, sf).select("claim_id", "title", "context_snippet", F.array_join("contour_set", ",").alias("contour_set"), "first_seen", "source", F.sha2("groundable", 256).alias("groundable"))


JUDGMENTS = CANDIDATES + """,
jd AS (SELECT claim_a, claim_b, score, (claim_a + claim_b) % 6 AS k, split_part(canonical_text, '.', 1) <> '' AS spoken FROM cand JOIN content ON content_id = claim_a),
rj AS (SELECT claim_a, claim_b, score, CASE WHEN k IN (1, 3, 5) OR (k IN (0, 4) AND NOT spoken) THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN k IN (0, 4) AND spoken THEN 'confirmed' WHEN k = 2 THEN 'not_confirmed' END AS referent_status,
    CASE WHEN k = 2 THEN 'related' WHEN spoken AND k = 0 THEN 'same_fact' WHEN spoken AND k = 4 THEN 'same_event' END AS relation_label FROM jd)"""


def judgments(spark, sf, backlog, about):
    return checkpointed(stages.judge_relations(backlog, about, PAYLOAD_PROMPT, relation_client, CONTRACT, REVISION, checkpointed))


@query("relation_judgments", JUDGMENTS + " SELECT claim_a, claim_b, status, relation_label, referent_status FROM rj")
def _(spark, sf):
    return judgments(spark, sf, Q.candidates(spark, sf), meta(spark, sf)).select("claim_a", "claim_b", "status", "relation_label", "referent_status")


@query("verification_backlog", SEEDS + " SELECT seed_id, count(*) FILTER (WHERE role = 'neighbor') AS neighbours FROM members WHERE seed_id % 3 <> 0 GROUP BY seed_id ORDER BY neighbours DESC, seed_id LIMIT 40")
def _(spark, sf):
    m = events.seed_members(Q.seeded(spark, sf))
    return stages.verification_backlog(m, m.where("seed_id % 3 = 0"), 40)


@query("seed_relations", SEEDS + " SELECT m.seed_id, m.claim_id, m.role, j.score, j.relation_label, j.status AS judged FROM members m LEFT JOIN (SELECT *, 'valid' AS status FROM judged) j ON m.role <> 'anchor' AND j.claim_a = least(m.seed_id, m.claim_id) AND j.claim_b = greatest(m.seed_id, m.claim_id)")
def _(spark, sf):
    found = checkpointed(Q.candidates(spark, sf))
    j = events.judged(found).withColumn("referent_evidence", F.lit("x"))
    m = events.seed_members(events.seeds(events.qualifying_edges(j)))
    return stages.members_with_relations(m, found, j).select("seed_id", "claim_id", "role", "score", "relation_label", F.when(F.col("referent_evidence").isNotNull(), "valid").alias("judged"))


def verifications(spark, sf):
    """(verifications, members): the whole second half of the chain from one set of candidates."""
    found = checkpointed(Q.candidates(spark, sf))
    j = events.judged(found).withColumn("referent_evidence", F.lit("x"))
    m = checkpointed(events.seed_members(events.seeds(events.qualifying_edges(j))))
    backlog = stages.verification_backlog(m, m.limit(0))
    told = stages.verify_seeds(backlog, stages.members_with_relations(m, found, j), meta(spark, sf), PAYLOAD_PROMPT, event_client, CONTRACT, REVISION, checkpointed)
    return checkpointed(told), m


_VERDICTS = SEEDS + ", vs AS (SELECT seed_id, count(*) AS n FROM members GROUP BY seed_id), ver AS (SELECT seed_id, CASE seed_id % 4 WHEN 3 THEN 'transport_error' WHEN 2 THEN 'invalid' ELSE 'valid' END AS status, CASE seed_id % 4 WHEN 0 THEN 'accepted_seed' WHEN 1 THEN 'rejected_seed' END AS decision, CASE seed_id % 4 WHEN 0 THEN n || ' claims' END AS summary FROM vs)"


@query("event_verifications", _VERDICTS + " SELECT * FROM ver")
def _(spark, sf):
    return verifications(spark, sf)[0].select("seed_id", "status", "decision", "summary")


@query("included_claims", _VERDICTS + " SELECT v.seed_id, CAST(m.claim_id AS VARCHAR) AS claim_id FROM ver v JOIN members m ON m.seed_id = v.seed_id WHERE decision = 'accepted_seed'")
def _(spark, sf):
    return stages.included_claims(verifications(spark, sf)[0])


@query("repeated_attempts", _VERDICTS + " SELECT seed_id, 2 AS attempts FROM ver WHERE decision = 'accepted_seed' AND seed_id % 8 = 0")
def _(spark, sf):
    told = verifications(spark, sf)[0]
    again = told.where("seed_id % 8 = 0").withColumn("attempt_no", F.lit(2))
    return stages.repeated_attempts(told.union(again)).select("seed_id", F.col("attempts").cast("int").alias("attempts"))


def merged(spark, sf):
    m = checkpointed(events.seed_members(Q.seeded(spark, sf)))
    return checkpointed(events.merge(events.overlap_pairs(m), m, lambda e: events.label_components(e, checkpointed))), m


@query("canonical_events")
def _(spark, sf):
    return events.canonical_events(merged(spark, sf)[0])


@query("event_packets")
def _(spark, sf):
    folded, m = merged(spark, sf)
    return events.event_packets(events.event_members(folded), m)


@query("claim_canonical_event")
def _(spark, sf):
    folded, m = merged(spark, sf)
    return search.canonical_event_of(m.select("claim_id").distinct(), m.select("seed_id", "claim_id"), events.event_members(folded), events.canonical_events(folded))


# ---------------------------------------------------------------- search


def _encoder(spark, sf):
    """A stand-in for the model: every query has the vector of row 0."""
    v = Q._query_vector(spark, sf)
    return lambda texts: np.array([v for _ in texts])


_HITS10 = f", hits AS (SELECT e.vec_id AS content_id, round({Q.DOT.format('e.embedding', Q._Q0)}, 6) AS similarity FROM embeddings e JOIN content c ON c.content_id = e.vec_id ORDER BY similarity DESC, content_id LIMIT 10)"
_SRC = "so AS (SELECT o.content_id, list_sort(list(DISTINCT s.source_id || ':' || s.source_type || ':' || coalesce(CAST(s.contour_id AS VARCHAR), ''))) AS l, count(*) AS n FROM occ o JOIN sources s ON s.source_id = o.source_id GROUP BY o.content_id)"


def _listed():
    return F.array_join(F.array_sort(F.transform("sources", lambda s: F.concat(s["source_id"], F.lit(":"), s["source_type"], F.lit(":"), F.coalesce(s["contour_id"].cast("string"), F.lit(""))))), ",")


@query("content_search", SOURCES + "," + INGEST + _HITS10 + ", " + _SRC + " SELECT h.content_id, similarity, CASE WHEN length(canonical_text) > 200 THEN left(canonical_text, 200) || '…' ELSE canonical_text END AS snippet, first_seen AS first_observed_at, array_to_string(l, ',') AS sources, n AS occurrence_count FROM hits h JOIN content c ON c.content_id = h.content_id JOIN so ON so.content_id = h.content_id")
def _(spark, sf):
    _, content, occ = Q.ingested(spark, sf)
    v = V.vectors(spark, sf).join(content.select("content_id"), "content_id", "left_semi")
    found = search.search_content(v, search.encoded_query("any words", _encoder(spark, sf)), 10, content, occ, V.sources(spark, sf))
    return found.withColumn("sources", _listed())


def _claim_search(spark, sf):
    claims, found, content, occ, src = claim_tables(spark, sf)
    v = V.vectors(spark, sf).select(F.col("content_id").alias("claim_id"), "embedding").join(claims.select("claim_id"), "claim_id", "left_semi")
    # one event for each ten claims, created in the reverse order, and one more that overlaps them
    held = claims.select("claim_id", F.floor(F.col("claim_id") / 10).alias("seed_id")).union(claims.where("claim_id % 3 = 0").select("claim_id", F.lit(-1).cast("long")))
    seeds = held.select("seed_id").distinct()
    made = seeds.select(F.col("seed_id").alias("event_id"), F.concat(F.lit("event "), "seed_id").alias("summary"), (-F.col("seed_id")).alias("created"))
    return search.search_claims(v, search.encoded_query("any words", _encoder(spark, sf)), 10, claims, found, content, occ, src, held.select("seed_id", "claim_id"), seeds.select("seed_id", F.col("seed_id").alias("event_id")), made)


_CLAIM_SEARCH = SOURCES + "," + INGEST + _HITS10 + ", " + _SRC + ", cs AS (SELECT h.content_id AS claim_id, similarity, 'said: ' || split_part(canonical_text, '.', 1) AS claim_text, h.content_id, first_seen AS observed_at, array_to_string(l, ',') AS sources, h.content_id // 10 AS event_id, 'event ' || (h.content_id // 10) AS event_summary FROM hits h JOIN content c ON c.content_id = h.content_id JOIN so ON so.content_id = h.content_id)"


@query("claim_search", _CLAIM_SEARCH + " SELECT * FROM cs")
def _(spark, sf):
    return _claim_search(spark, sf).withColumn("sources", _listed()).select("claim_id", "similarity", "claim_text", "content_id", "observed_at", "sources", "event_id", "event_summary")


@query("search_document", _CLAIM_SEARCH + ", n AS (SELECT count(*) AS n, sum(claim_id) AS ids, arg_max(claim_id, (similarity, -claim_id)) AS first_id FROM cs) SELECT 'any words' AS query, 'stub' AS model, '0000000' AS revision, n, CAST(ids AS BIGINT) AS ids, first_id FROM n")
def _(spark, sf):
    doc = search.result_document(_claim_search(spark, sf).select("claim_id", "similarity", "claim_text"), "any words", "claims", {"name": "stub", "revision": "1"}, REVISION, [F.desc("similarity"), F.col("claim_id")])
    d = doc.select(F.from_json("value", "query string, model struct<name:string>, code_revision string, results array<struct<claim_id:long>>").alias("d")).select("d.*")
    return d.select("query", F.col("model.name").alias("model"), F.col("code_revision").alias("revision"), F.size("results").cast("long").alias("n"), F.aggregate("results", F.lit(0).cast("long"), lambda s, r: s + r["claim_id"]).alias("ids"), F.col("results")[0]["claim_id"].alias("first_id"))


# ---------------------------------------------------------------- routing, reports, writes


@query("transition_listing", Q._V2 + ", t AS (SELECT r.content_id, r.decision AS old, CASE WHEN r.margin >= 0.05 THEN 'analyze' WHEN r.margin <= -0.1 THEN 'skip' ELSE 'maybe' END AS new, r.margin FROM routed r) SELECT *, CAST(row_number() OVER (PARTITION BY old, new ORDER BY margin DESC, content_id) AS INTEGER) AS place FROM t WHERE (old, new) IN (('skip', 'maybe'), ('skip', 'analyze'), ('maybe', 'analyze'))")
def _(spark, sf):
    r = Q.routed(spark, sf)
    new = r.withColumn("decision", Q.S.decide(F.col("margin"), 0.05, -0.10))
    return routing.listing(r, new, "content_id", [("skip", "maybe"), ("skip", "analyze"), ("maybe", "analyze")])


#: Named cases: content and the decision that any version must give it.
CASES = [(60, "maybe"), (61, "analyze"), (62, "skip"), (100, "maybe"), (7, "maybe")]


@query("routing_cases", ROUTED + f", ca(content_id, expected) AS (VALUES {', '.join(f'{c}' for c in CASES)}) SELECT ca.content_id, expected, coalesce(decision, 'missing') AS actual, coalesce(decision, 'missing') = expected AS ok FROM ca LEFT JOIN routed r ON r.content_id = ca.content_id")
def _(spark, sf):
    return routing.regression_cases(Q.routed(spark, sf), spark.createDataFrame(CASES, "content_id long, expected string"), "content_id")


#: Five facets, each with its own anchors.
FACETS = {"contact": [r"@mail[0-9]", r"\+1 \("], "licence": [r"licen[cs]e"], "number": [r"[0-9]{3}", r"[0-9]{2}-[0-9]{2}"], "list": [r" \| "], "common": ["that", "nicht", "para", "elle"]}


@query("facet_ablation", ROUTED + ", nc AS (SELECT content_id, replace(lower(canonical_text), 'ß', 'ss') AS t FROM content), top AS (SELECT * FROM (SELECT content_id, category, row_number() OVER (PARTITION BY category ORDER BY noise_score DESC, content_id) AS rank FROM noised) WHERE rank <= 20) SELECT category, count(*) AS n, " + ", ".join("count(*) FILTER (WHERE " + " OR ".join(f"regexp_matches(t, '{p}')" for p in ps) + f") AS {f}" for f, ps in FACETS.items()) + " FROM top JOIN nc USING (content_id) GROUP BY category")
def _(spark, sf):
    top = routing.top_per_group(Q.noised(spark, sf), ["category"], [F.desc("noise_score"), F.col("content_id")], 20)
    passed = contours.facet_passes(Q._norm(spark, sf), FACETS)
    return top.join(passed, "content_id").groupBy("category").agg(F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in FACETS])


@query("decision_inserts", ROUTED + " SELECT content_id, decision, 'v1' AS routing_version FROM routed WHERE content_id % 4 <> 0")
def _(spark, sf):
    r = Q.routed(spark, sf).select("content_id", "decision")
    held = r.where("content_id % 4 = 0").withColumn("routing_version", F.lit("v1")).union(r.withColumn("routing_version", F.lit("v0")))
    return writes.insert_decisions(r, held, "v1", REVISION).select("content_id", "decision", "routing_version")


@query("pair_insert_counts", CANDIDATES + " SELECT count(*) AS attempted, count(*) FILTER (WHERE NOT (claim_a % 2 = 0 AND claim_b % 3 = 0)) AS inserted FROM cand")
def _(spark, sf):
    c = checkpointed(Q.candidates(spark, sf))
    order = [F.desc("score"), F.col("claim_a"), F.col("claim_b")]
    return writes.insert_counts(c, writes.top_then_insert(c.where("claim_a % 2 = 0 and claim_b % 3 = 0"), c, ["claim_a", "claim_b"], order, Q.PAIRS_N))


#: 2024-01-01 12:00 UTC
_NOON = 1_704_110_400


def _window(name, sql_where, **options):
    @query(name, SOURCES + "," + INGEST + f" SELECT o.content_id, s.source_group AS grp, array_to_string(list_sort(list(DISTINCT s.source_id)), ',') AS names FROM occ o JOIN sources s ON s.source_id = o.source_id JOIN content c ON c.content_id = o.content_id WHERE s.source_group IN ('group_a', 'group_b') AND {sql_where} GROUP BY ALL")
    def _(spark, sf):
        _, content, occ = Q.ingested(spark, sf)
        at = {k: F.timestamp_seconds(F.lit(v)) if k in ("now", "start", "end") else v for k, v in options.items()}
        return reporting.documents(content, occ, V.sources(spark, sf), ["group_a", "group_b"], **at).select("content_id", "grp", F.array_join("names", ",").alias("names"))


_window("report_since", "c.first_seen >= TIMESTAMP '2024-01-01 06:00:00'", since_hours=6, now=_NOON)
_window("report_between", "s.source_group = 'group_b' AND c.first_seen >= TIMESTAMP '2024-01-01 02:00:00' AND c.first_seen < TIMESTAMP '2024-01-01 10:00:00'", source_group="group_b", start=_NOON - 10 * 3600, end=_NOON - 2 * 3600)


@query("payload_hashes", "p AS (SELECT event_id, sha256('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS payload_hash FROM events) SELECT * FROM p")
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", T.payload_hash("user_id", "event_type", "event_id").alias("payload_hash"))


# ---------------------------------------------------------------- collected sources

_MARKED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _marked():
    t = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(t, F.lit(">"), F.lit("&gt;"))


@query("channel_deliveries", f"d AS (SELECT source AS source_id, 'https://t.me/' || source || '/' || doc_id AS external_ref, {_FLAT} AS t FROM documents) SELECT source_id, external_ref, sha256(t) AS text_hash, left(t, 200) AS title FROM d")
def _(spark, sf):
    post = F.concat(F.lit('<div class="tgme_widget_message" data-post="'), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit('"><div class="tgme_widget_message_text"><b>'), _marked(), F.lit("</b></div></div>"))
    pages = V.table(spark, sf, "documents").groupBy(F.col("source").alias("source_id"), F.floor(F.col("doc_id") / 100)).agg(F.concat(F.lit("<html>"), F.array_join(F.collect_list(post), "\n"), F.lit("</html>")).alias("html"))
    return collect.channel_posts(pages).select("source_id", "external_ref", F.sha2("canonical_text", 256).alias("text_hash"), "title")


@query("feed_deliveries", f"d AS (SELECT source AS source_id, 'http://h/' || doc_id AS external_ref, {_FLAT} AS t, doc_id FROM documents) SELECT source_id, external_ref, 't' || doc_id AS title, sha256(trim('t' || doc_id || chr(10) || t, ' ' || chr(10))) AS text_hash, CAST(1704164645 AS BIGINT) AS published FROM d")
def _(spark, sf):
    """Half of the feeds are RSS, half Atom; the last item of each is followed by a break."""
    key, text = F.col("doc_id").cast("string"), F.replace(F.replace(_marked(), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rss = F.concat(F.lit("<item><title>t"), key, F.lit("</title><link>http://h/"), key, F.lit("/#x</link><description>"), text, F.lit("</description><pubDate>Tue, 02 Jan 2024 05:04:05 +0200</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>t"), key, F.lit('</title><link rel="self" href="x"/><link href="http://h/'), key, F.lit('"/><summary>'), text, F.lit("</summary><published>2024-01-02T03:04:05Z</published></entry>"))
    even = F.regexp_extract("source_id", "([0-9]+)$", 1).cast("int") % 2 == 0
    items = V.table(spark, sf, "documents").select(F.col("source").alias("source_id"), "doc_id", rss.alias("rss"), atom.alias("atom")).groupBy("source_id", F.floor(F.col("doc_id") / 100)).agg(F.array_join(F.collect_list(F.when(even, F.col("rss")).otherwise(F.col("atom"))), "").alias("items"))
    body = F.when(even, F.concat(F.lit("<rss><channel><title>c</title>"), "items", F.lit("<item><title>broken"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "items", F.lit("</feed>")))
    found = V.parse_feed(collect.feed_entries(items.select("source_id", body.alias("body"))))
    return found.select("source_id", "external_ref", "title", F.sha2("canonical_text", 256).alias("text_hash"), F.unix_timestamp("published_at").alias("published"))


# ---------------------------------------------------------------- reference registry

# Fixed values of the synthetic registry: objects named by frequent words, which of them are active, and who stands over whom.
OBJECTS = [(1, "that", True), (2, "nicht", True), (3, "los", False), (4, "pour", True), (5, "with", True)]
NAMED = [("that", "those"), ("nicht", "kein"), ("los", "las"), ("nobody", "none"), ("with", "along")]
UNDER = [("nicht", "that"), ("pour", "that"), ("with", "pour"), ("ghost", "that")]
_OBJ = ", ".join(f"({i}, '{n}', {str(a).lower()})" for i, n, a in OBJECTS)
_REG = f"ob(object_id, canonical_name, active) AS (VALUES {_OBJ}), al(canonical_name, alias) AS (VALUES {', '.join(f'{x}' for x in NAMED)}), un(c, p) AS (VALUES {', '.join(f'{x}' for x in UNDER)})"


def _objects(spark):
    return spark.createDataFrame(OBJECTS, "object_id int, canonical_name string, active boolean")


@query("alias_seeds", _REG + " SELECT object_id, alias, 'exact' AS match_mode FROM al JOIN ob USING (canonical_name) WHERE active UNION ALL SELECT object_id, x, 'both' FROM ob, (VALUES ('one'), ('two')) t(x) WHERE object_id <= 2")
def _(spark, sf):
    own = registry.alias_seeds(spark.createDataFrame(NAMED, "canonical_name string, alias string"), _objects(spark))
    return own.union(registry.shared_aliases(_objects(spark).where("object_id <= 2"), ["one", "two"], "both"))


@query("object_hierarchy", _REG + " SELECT c.object_id AS child, p.object_id AS parent FROM un JOIN ob c ON c.canonical_name = un.c JOIN ob p ON p.canonical_name = un.p")
def _(spark, sf):
    return registry.hierarchy(spark.createDataFrame(UNDER, "child_name string, parent_name string"), _objects(spark))


#: References: one for each prototype vector; every third has no object, every fifth is inactive, modes go round.
_REFS = "re AS (SELECT vec_id AS reference_id, CASE WHEN vec_id % 3 > 0 THEN vec_id % 7 + 1 END AS object_id, 'r' || vec_id AS reference_text, vec_id % 5 > 0 AS active, ['exact', 'semantic', 'both'][vec_id % 3 + 1] AS match_mode, embedding, CASE WHEN vec_id % 2 = 0 THEN 'official' ELSE 'baseline' END AS source_note, 'candidate' AS verification_status FROM embeddings WHERE vec_id < 56)"


def _references(spark, sf):
    i = F.col("content_id")
    mode = F.when(i % 3 == 0, "exact").when(i % 3 == 1, "semantic").otherwise("both")
    return V.vectors(spark, sf).where("content_id < 56").select(
        i.alias("reference_id"), F.when(i % 3 > 0, (i % 7 + 1).cast("int")).alias("object_id"), F.concat(F.lit("r"), i).alias("reference_text"), (i % 5 > 0).alias("active"), mode.alias("match_mode"), "embedding",
        F.when(i % 2 == 0, "official").otherwise("baseline").alias("source_note"), F.lit("candidate").alias("verification_status"), F.lit(None).cast("date").alias("verified_on"),
    )


@query("semantic_references", _REG + "," + _REFS + " SELECT reference_id, re.object_id, reference_text, canonical_name FROM re LEFT JOIN ob ON ob.object_id = re.object_id WHERE re.active AND match_mode IN ('semantic', 'both') AND reference_id % 4 <> 0")
def _(spark, sf):
    r = _references(spark, sf)
    return registry.semantic_references(r.drop("embedding"), _objects(spark), r.where("reference_id % 4 <> 0").select("reference_id", "embedding")).drop("embedding")


@query("verified_references", _REFS + " SELECT reference_id, CASE WHEN source_note = 'official' THEN 'public' WHEN reference_id % 3 = 0 THEN 'internal' ELSE verification_status END AS verification_status, CASE WHEN source_note = 'baseline' AND reference_id % 3 = 0 THEN 'dictionary' ELSE source_note END AS source_note, CASE WHEN source_note = 'official' OR reference_id % 3 = 0 THEN DATE '2026-08-25' END AS verified_on FROM re")
def _(spark, sf):
    rules = [(F.col("source_note") == "official", "public", None), ((F.col("verification_status") == "candidate") & (F.col("reference_id") % 3 == 0), "internal", "dictionary")]
    return registry.verified(_references(spark, sf), rules, "2026-08-25").select("reference_id", "verification_status", "source_note", "verified_on")


@query("unembedded_anchors", Q._HITS + " SELECT DISTINCT content_id FROM hits WHERE content_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, sf):
    return contours.without_embedding(contours.alias_hits(Q._norm(spark, sf), ALIASES), V.vectors(spark, sf))
