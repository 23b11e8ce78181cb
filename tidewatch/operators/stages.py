"""The model stages end to end: embedding, claim extraction, relation judgment, event verification.

Each takes a backlog, makes a prompt or batch, calls an injected client, checks the answer and gives rows to append. A
client's answers are stored before anything reads them twice, so that no call is repeated and later reads agree.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import models, validators, writes

Stored = Callable[[DataFrame], DataFrame]
#: Characters of context on either side of a span.
CONTEXT = 300


def code_revision(root: str, digits: int = 7) -> str:
    """The short commit of a working tree, with +dirty where it has changes, and 'unknown' outside of one."""
    try:
        ask = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout.strip()
        return ask("rev-parse", f"--short={digits}", "HEAD") + ("+dirty" if ask("status", "--porcelain") else "")
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def drain(step: Callable[[], int], most: int | None = None) -> int:
    """Run a stage batch by batch until one is empty (or most batches); an error stops the run, and a later run goes on from there."""
    total = batches = 0
    while most is None or batches < most:
        n = step()
        if not n:
            break
        total, batches = total + n, batches + 1
    return total


# ---------------------------------------------------------------- embedding


def embed_pending(content: DataFrame, occurrences: DataFrame, vectors: DataFrame, model_id: int, factory: Callable, dim: int, limit: int | None = None) -> DataFrame:
    """(content_id, embedding_model_id, embedding) of content that was seen somewhere and has no vector of this model, oldest first."""
    seen = content.join(occurrences.select("content_id"), "content_id", "left_semi")
    todo = writes.backlog(seen, vectors.where(F.col("embedding_model_id") == model_id), ["content_id"], [F.col("first_seen"), F.col("content_id")], limit)
    made = models.embed(todo, "content_id", "canonical_text", factory, dim)
    return made.select("content_id", F.lit(model_id).alias("embedding_model_id"), "embedding")


# ---------------------------------------------------------------- claim extraction


def run_id(key, contract: dict) -> Column:
    """The same run has the same id, so that a repeated batch adds nothing."""
    return F.sha2(F.concat_ws("|", key.cast("string"), *[F.lit(str(contract[k])) for k in ("model_id", "prompt_id", "attempt_no")]), 256)


def with_contract(rows: DataFrame, contract: dict, revision: str) -> DataFrame:
    return rows.select("*", *[F.lit(contract[k]).alias(k) for k in ("model_id", "prompt_id", "attempt_no")], F.lit(revision).alias("code_revision"))


def extract_claims(backlog: DataFrame, prompt: str, client: Callable, contract: dict, revision: str, stored: Stored) -> DataFrame:
    """(run_id, content_id, status, claim_count, errors, raw, claims, contract columns, code_revision): one run for each row of (content_id, canonical_text)."""
    asked = backlog.select("content_id", "canonical_text", T.fill(prompt, evidence_id=F.col("content_id").cast("string"), evidence_text=F.col("canonical_text")).alias("prompt"))
    answers = stored(models.model_stage(asked, "content_id", "prompt", client))
    told = backlog.select("content_id", "canonical_text").join(answers, "content_id").withColumn("v", validators.extracted_udf("raw", F.col("content_id").cast("string"), "canonical_text"))
    answered = F.col("status") == "answered"
    return with_contract(
        told.select(
            run_id(F.col("content_id"), contract).alias("run_id"), "content_id",
            F.when(~answered, F.col("status")).when(F.size("v.errors") == 0, "valid").otherwise("invalid").alias("status"),
            F.when(answered, F.col("v.claim_count")).alias("claim_count"),
            F.when(answered, F.col("v.errors")).otherwise(F.array("error")).alias("errors"), "raw",
            F.when(answered, F.col("v.claims")).alias("claims"),
        ), contract, revision,
    )


def claim_rows(runs: DataFrame) -> DataFrame:
    """(claim_id, run_id, contract fields): the claims of valid runs; the id is made of the run's and the claim's own."""
    one = runs.where("status = 'valid'").select("run_id", F.explode("claims").alias("c")).select("run_id", "c.*")
    return one.select(F.sha2(F.concat_ws("|", "run_id", "claim_local_id"), 256).alias("claim_id"), *one.columns)


# ---------------------------------------------------------------- relation judgment


def claim_meta(claims: DataFrame, runs: DataFrame, content: DataFrame, occurrences: DataFrame, sources: DataFrame, around: int = CONTEXT) -> DataFrame:
    """Each claim with its text's surroundings, the contours it was seen in, and where it was seen first."""
    own = claims.join(runs.select("run_id", "content_id"), "run_id").join(content.select("content_id", "title", "canonical_text"), "content_id")
    seen = occurrences.join(sources.select("source_id", "source_type", "contour_id"), "source_id").groupBy("content_id").agg(
        F.array_sort(F.collect_set("contour_id")).alias("contour_set"), F.min("collected_at").alias("first_seen"),
        F.min_by(F.concat(F.lit(""), "source_id", F.lit(" ("), "source_type", F.lit(")")), F.struct("collected_at", "source_id")).alias("source"),
    )
    snippet = T.context_snippet(F.col("canonical_text"), F.col("evidence_start").cast("int"), F.col("evidence_end").cast("int"), around)
    out = own.join(seen, "content_id", "left").select("claim_id", "run_id", "content_id", "claim_text", "evidence_span", "title", snippet.alias("context_snippet"), "source", F.coalesce("contour_set", F.array().cast("array<int>")).alias("contour_set"), "first_seen")
    return out.withColumn("groundable", T.groundable(F.col("claim_text"), F.col("evidence_span"), F.col("title"), F.col("context_snippet")))


def _payload(x: str = "") -> Column:
    names = ["claim_text", "evidence_span", "title", "context_snippet", "source", "contour_set", "first_seen"]
    return F.struct(*[F.col(f"{x}{n}").alias(n) for n in names])


def judge_relations(backlog: DataFrame, meta: DataFrame, prompt: str, client: Callable, contract: dict, revision: str, stored: Stored) -> DataFrame:
    """(pair_id, claim_a, claim_b, status, relation_label, rationale, referent_status, referent_evidence, errors, raw, ...): one judgment for each pair; fields are null unless it is valid."""
    side = lambda x: meta.select(F.col("claim_id").alias(f"claim_{x}"), _payload().alias(f"payload_{x}"), F.col("groundable").alias(f"groundable_{x}"))
    pairs = backlog.select("claim_a", "claim_b").join(side("a"), "claim_a").join(side("b"), "claim_b").withColumn("pair_id", F.concat_ws("-", "claim_a", "claim_b"))
    payload = F.struct(F.lit("relation-input/1").alias("schema_version"), "pair_id", F.col("payload_a").alias("claim_a"), F.col("payload_b").alias("claim_b"))
    answers = stored(models.model_stage(pairs.select("pair_id", T.payload_prompt(prompt, payload).alias("prompt")), "pair_id", "prompt", client))
    told = pairs.select("pair_id", "claim_a", "claim_b", "groundable_a", "groundable_b").join(answers, "pair_id").withColumn("v", validators.relation_verdict_udf("raw", "pair_id", "groundable_a", "groundable_b"))
    return with_contract(_verdict(told, ["pair_id", "claim_a", "claim_b"], ["relation_label", "rationale", "referent_status", "referent_evidence"]), contract, revision)


def _verdict(told: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    answered = F.col("status") == "answered"
    status = F.when(~answered, F.col("status")).when(F.size("v.errors") == 0, "valid").otherwise("invalid")
    return told.select(*keys, status.alias("status"), *[F.when(answered, F.col(f"v.{f}")).alias(f) for f in fields], F.when(answered, F.col("v.errors")).otherwise(F.array("error")).alias("errors"), "raw")


# ---------------------------------------------------------------- event verification


def members_with_relations(members: DataFrame, pairs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Seed members with the score and judgment of their pair with the anchor, which the anchor itself lacks."""
    lo, hi = F.least("seed_id", "claim_id"), F.greatest("seed_id", "claim_id")
    keyed = members.withColumn("claim_a", F.when(F.col("role") != "anchor", lo)).withColumn("claim_b", F.when(F.col("role") != "anchor", hi))
    return keyed.join(pairs.select("claim_a", "claim_b", "score"), ["claim_a", "claim_b"], "left").join(judgments.select("claim_a", "claim_b", "relation_label", "referent_status", "referent_evidence"), ["claim_a", "claim_b"], "left").drop("claim_a", "claim_b")


def verification_backlog(members: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """(seed_id, neighbours) of seeds not verified yet: those with most neighbours first."""
    counted = members.groupBy("seed_id").agg(F.count_if(F.col("role") == "neighbor").alias("neighbours"))
    return writes.backlog(counted, done, ["seed_id"], [F.desc("neighbours"), F.col("seed_id")], limit)


def verify_seeds(backlog: DataFrame, members: DataFrame, meta: DataFrame, prompt: str, client: Callable, contract: dict, revision: str, stored: Stored) -> DataFrame:
    """(seed_id, status, decision, summary, rationale, members, errors, raw, ...): one verification for each seed. members carries relations; a claim's key is its seed's type."""
    relation = F.when(F.col("role") != "anchor", F.struct("relation_label", "referent_status", "referent_evidence", "score"))
    rows = members.join(backlog.select("seed_id"), "seed_id").join(meta, "claim_id")
    # the anchor first, then neighbours by rank
    place = F.struct((F.col("role") != "anchor").alias("later"), F.coalesce("rank", F.lit(0)).alias("rank"), F.col("claim_id"))
    entry = F.struct(place.alias("place"), F.struct(F.col("claim_id").cast("string").alias("claim_id"), "role", _payload().alias("claim"), relation.alias("relation_to_anchor")).alias("entry"))
    seeds = rows.groupBy("seed_id").agg(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)).alias("l"), F.array_sort(F.collect_set(F.col("claim_id").cast("string"))).alias("expected"))
    key = F.col("seed_id").cast("string")
    payload = F.struct(F.lit("event-input/1").alias("schema_version"), key.alias("event_candidate_id"), key.alias("anchor_claim_id"), F.transform("l", lambda x: x["entry"]).alias("claims"))
    answers = stored(models.model_stage(seeds.select("seed_id", T.payload_prompt(prompt, payload).alias("prompt")), "seed_id", "prompt", client))
    told = seeds.select("seed_id", "expected").join(answers, "seed_id").withColumn("v", validators.event_verdict_udf("raw", key, key, "expected"))
    out = _verdict(told, ["seed_id"], ["decision", "summary", "rationale", "members"])
    # a claim named twice passes the contract, but its rows cannot be stored: the whole attempt is an error
    named = F.transform("members", lambda m: m["claim_id"])
    twice = F.coalesce((F.col("status") == "valid") & (F.size(F.array_distinct(named)) < F.size(named)), F.lit(False))
    blank = {c: F.when(~twice, F.col(c)) for c in ("decision", "summary", "rationale", "members")}
    out = out.withColumns(blank | {"errors": F.when(twice, F.array(F.lit("a claim is named twice"))).otherwise(F.col("errors")), "status": F.when(twice, "error").otherwise(F.col("status"))})
    return with_contract(out, contract, revision)


def included_claims(verifications: DataFrame) -> DataFrame:
    """(seed_id, claim_id) of the members that valid accepted verifications include; the claim id as the contract's string."""
    return verifications.where("status = 'valid' and decision = 'accepted_seed'").select("seed_id", F.explode("members").alias("m")).where("m.included").select("seed_id", F.col("m.claim_id").alias("claim_id"))


def repeated_attempts(verifications: DataFrame) -> DataFrame:
    """(seed_id, attempts) of seeds accepted in more than one attempt."""
    return verifications.where("status = 'valid' and decision = 'accepted_seed'").groupBy("seed_id").agg(F.count_distinct("attempt_no").alias("attempts")).where("attempts > 1")


def single_attempts(verifications: DataFrame) -> DataFrame:
    """verifications, unless a seed was accepted in several attempts: nobody has said which of them counts."""
    found = repeated_attempts(verifications).limit(5).collect()
    if found:
        raise ValueError(f"seeds accepted in several attempts: {[r.seed_id for r in found]}")
    return verifications
