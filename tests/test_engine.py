"""The engine's semantics on small frames, and its queries against DuckDB."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scores as S
from tidewatch.functions import text as T
from tidewatch.operators import contours, events, expectations, ingest, models, pairs, reporting, routing, search, validators, writes
from tidewatch.plans import audits as _audits, stages as _stages  # noqa: F401  register their queries
from tidewatch.plans import queries as Q
from tidewatch.sources import views as V
from tidewatch.streaming import jobs

SF = "/root/testdata/sf0.001"
RAW = "doc_id long, source_id string, canonical_text string, external_ref long, arrival long, collected_at timestamp, content_hash string"


def deliveries(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice("abcdef") * rng.choice((5, 40, 50))
        out.append((i, rng.choice(("s1", "s2")), text, rng.randrange(25), i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), f"h{text}"))
    return out


def sequential(rows):
    seen, content, out = {}, set(), []
    for i, s, text, ref, *_, h in sorted(rows, key=lambda r: r[4]):
        if len(text) < 30:
            out.append((i, "rejected"))
        elif (s, ref) in seen:
            out.append((i, "dup_occurrence" if seen[s, ref] == h else "changed_unprocessed"))
        else:
            seen[s, ref] = h
            out.append((i, "new_occurrence" if h in content else "new_content"))
            content.add(h)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ingest_is_the_sequential_pass(spark, seed):
    rows = deliveries(seed)
    got = ingest.outcomes(spark.createDataFrame(rows, RAW)).select("doc_id", "outcome").collect()
    assert sorted(map(tuple, got)) == sequential(rows)


def test_ingest_in_batches_and_again(spark, tmp_path):
    rows = deliveries(7)
    for lo in range(0, 120, 40):
        jobs.ingest_batch(spark.createDataFrame(rows[lo : lo + 40], RAW), str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/raw").select("doc_id", "outcome").collect()
    assert sorted(map(tuple, got)) == sequential(rows)
    before = spark.read.parquet(f"{tmp_path}/occurrences").count(), spark.read.parquet(f"{tmp_path}/content").count()
    again = jobs.ingest_batch(spark.createDataFrame(rows, RAW), str(tmp_path))
    assert before == (spark.read.parquet(f"{tmp_path}/occurrences").count(), spark.read.parquet(f"{tmp_path}/content").count())
    assert set(again) <= {"rejected", "dup_occurrence", "changed_unprocessed"}


def test_ingest_stream(spark, tmp_path):
    rows = deliveries(4)
    spark.createDataFrame(rows, RAW).repartition(1).write.parquet(f"{tmp_path}/landing")
    stream = spark.readStream.schema(RAW).parquet(f"{tmp_path}/landing")
    q = jobs.ingest_stream(stream, f"{tmp_path}/root", f"{tmp_path}/checkpoint")
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/root/raw").select("doc_id", "outcome").collect())) == sequential(rows)


def test_windows_stream_like_batches(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(ev.schema).parquet(f"{SF}/events.parquet*")
    q = jobs.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, jobs.tumbling(ev).collect()))


def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "m")], "k int, v string")
    assert [tuple(r) for r in writes.insert_if_absent(t, b, ["k"], [F.col("v")]).collect()] == [(2, "y")]
    u = writes.upsert(t.where("k = 1"), b.where("k is not null").dropDuplicates(["k"]), ["k"], ["v"]).collect()
    assert {r.k for r in u} == {1, 2} and {r.k: r.v for r in u}[1] == "x"
    ranked = spark.createDataFrame([(i, i) for i in range(10)], "k int, s int")
    done = ranked.where("k >= 8")
    # best three, then what is new; against: what is new, then the best three
    assert {r.k for r in writes.top_then_insert(done, ranked, ["k"], [F.desc("s")], 3).collect()} == {7}
    assert {r.k for r in writes.insert_then_top(done, ranked, ["k"], [F.desc("s")], 3).collect()} == {7, 6, 5}
    p, c = writes.parents_with_children(done.select("k"), ranked.select("k"), ranked, ["k"])
    assert p.count() == 8 and c.where("k >= 8").count() == 0


def one(spark, col, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(col).first()[0]


def test_text(spark):
    f = lambda c, **k: one(spark, c, **k)
    assert f(T.strip_html(F.col("x")), x="<p>a&amp;b  &lt;i&gt;</p>") == "a&b <i>"
    assert f(T.canonical_url(F.col("x")), x="http://h/a?b=1//#t#u") == "http://h/a?b=1"
    assert f(T.canonical_text(F.col("x"), F.col("y")), x=" T", y="b \n") == "T\nb"
    assert f(T.norm_text(F.col("x"), F.col("y")), x="Straße", y=" A  B") == "strasse a b"
    assert f(T.normalize_text(F.col("x")), x="ﬁ’sʼ`") == "fi's''"
    assert f(T.strip_fence(F.col("x")), x="```json\n{}\n```") == "{}" and f(T.strip_fence(F.col("x")), x="a ```b```") == "a ```b```"
    assert tuple(f(T.resolve_span(F.col("x"), F.col("y")), x="a\U0001f600b c", y="b")) == ("resolved", 2, 3)
    assert f(T.resolve_span(F.col("x"), F.col("y")), x="b b", y="b")[0] == "ambiguous" and f(T.resolve_span(F.col("x"), F.col("y")), x="a", y="b")[0] == "not_found"
    assert f(T.quotes(F.col("x")), x='"b" «a» ""') == ["b", "a"] and f(T.quotes(F.col("x")), x='""b"') == ["b"]
    toks = T.tokens(F.col("x"))
    assert f(toks, x="Don't stop м'яч café") == ["don't", "stop", "м'яч", "caf"]
    assert f(T.ngrams(toks, 3, ["of"]), x="house of cards of") == ["house of cards"] and f(T.ngrams(toks, 2, ["of"]), x="house") == []
    rules = [{"pattern": "read more"}, {"pattern": "cards", "source_names": ["Other"]}]
    assert f(T.clean_text(F.col("x"), F.array(F.lit("Herald (north)"))  , rules), x="Herald cards READ\nMORE x") == "cards READ MORE x"
    assert f(T.clean_text(F.col("x"), F.array(F.lit("Other")), rules), x="cards Read More x") == "x"
    assert f(T.lemma_override(F.lit("uk"), F.col("x"), F.col("y"), [{"lang": "uk", "lemma": "b", "surface_prefix": "ab", "replace": "z"}]), x="abc", y="b") == "z"
    assert f(T.fill("<<A>>-<<B>>", a=F.col("x"), b=F.col("y")), x="1", y="2") == "1-2"
    assert f(T.needs_proxy(F.col("x")), x="https://a.ru/b") and not f(T.needs_proxy(F.col("x")), x="https://ru.com/.ru")
    assert f(T.context_snippet(F.col("x"), F.lit(1), F.lit(2), 1), x="abcdef") == "abc"
    assert f(T.preview(F.col("x"), 3), x="a\nbcd") == "a b…"


def test_page_text_of_odd_pages_is_its_sql(spark, tmp_path):
    """Entities cut off or unknown stay; spaces of all kinds inside and at the ends; each page by itself, so a difference names it."""
    import duckdb

    spaces = "\t\n\v\f\r \x1c\x1f\x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000\ufeff"
    pages = ["", None, "<>", "<a", "a<b\nc>d", "x &amp", "x &amp y &am", "&ampamp; &amp;amp &amp;amp; &amp;lt; &am&quot;p;", "&lt;b&gt;&#39;&quot;", "&lt &gt &copy &middot &quot &#39", "&nbsp;a&nbsp;", "&eacute;&#233;&#xe9;&apos;&#0;&#x80;", "&AMP; &LT;", "&am<i>p;", "\\n $1 \U0001f600&copy;"]
    pages += [f"{w}a{w}{w}b{w}" for w in spaces] + [f"{w} {w}a" for w in spaces] + [f"a{w} {w}" for w in spaces] + list(spaces) + [f"x<b>{w}</b>y" for w in spaces]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = {i: (sha, n) for i, sha, n in c.execute(Q.ORACLES["page_text"]).fetchall()}
    got = {r.page_id: (r.text_sha, r.n_chars) for r in Q.QUERIES["page_text"](spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and {pages[i]: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_aliases_are_word_bounded_in_any_script(spark):
    c = spark.createDataFrame([(1, "про кит тут"), (2, "китами"), (3, "kit, kat")], "content_id long, norm string")
    got = contours.alias_hits(c, [(9, 1, "кит"), (4, 2, "kit"), (3, 2, "kat")]).collect()
    assert sorted((r.content_id, r.object_id, r.reference_id) for r in got) == [(1, 1, 9), (3, 2, 3)]
    assert contours.structural_hits(c.withColumn("norm", F.lit("the 7th. 7 big units")), ["7 u", "units"], ["unit"]).count() == 3
    assert contours.structural_hits(c.withColumn("norm", F.lit("7" + " x" * 41 + " unit")), ["7 u"], ["unit"]).count() == 0 and contours.structural_hits(c, ["units"], ["unit"]).count() == 0
    assert one(spark, contours.leading_number(F.col("x")), x=" 12 group") == "12"
    reg = spark.createDataFrame([(1, "a", True), (1, "b", False)], "contour_id int, facet string, active boolean")
    assert [tuple(r) for r in contours.missing_facets(reg, reg).collect()] == [(1, "b")]


def test_routing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5])], "content_id long, embedding array<float>")
    got = {r.content_id: (r.margin, r.decision) for r in routing.route(v, [("a", [1.0, 0.0])], [("b", [0.0, 1.0])]).collect()}
    assert got == {1: (1.0, "analyze"), 2: (-1.0, "skip"), 3: (0.0, "maybe")}
    b = v.select(S.best(F.col("embedding"), [("x", [1.0, 0.0]), ("y", [1.0, 0.0])])["label"]).first()[0]
    assert b == "x"
    some = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [-1.0, 0.5])], "content_id long, embedding array<float>")
    for rows in (some, some.where("content_id = 2"), some.limit(0)):
        got = {r.content_id: (r.d, r.b) for r in rows.select("content_id", S.dots(F.col("embedding"), [[1.0, 1.0], [0.0, -1.0]]).alias("d"), S.best(F.col("embedding"), [("p", [1.0, 1.0]), ("q", [0.0, -1.0])]).alias("b")).collect()}
        want = {1: ([3.0, -2.0], (3.0, "p")), 2: (None, None), 3: ([-0.5, -0.5], (-0.5, "p"))}
        assert {k: (d, None if b is None or b.label is None else tuple(b)) for k, (d, b) in got.items()} == {k: want[k] for k in got}
    assert [one(spark, S.decide(F.col("m")), m=m) for m in (0.10, -0.07, 0.0)] == ["analyze", "skip", "maybe"]
    a = routing.seeded_sample(spark.range(1000).repartition(7), "id", 20).collect()
    assert a == routing.seeded_sample(spark.range(1000), "id", 20).collect()
    with pytest.raises(ValueError):
        search.top_k(v, [1.0, 0.0], 0)


@pytest.mark.parametrize("values", [[], [0.25], [None, None], [0.1, 0.1, None, -0.1], "many"])
def test_floor_ranks(spark, values):
    if values == "many":
        rng = random.Random(3)
        values = [round(rng.uniform(-2, 2), 3) for _ in range(3000)] + [0.5] * 1500 + [None]
    got = S.floor_ranks(spark.createDataFrame([(v,) for v in values], "x double"), "x", a=0.0, b=1 / 3, c=0.75, d=1.0).collect()
    kept = sorted(v for v in values if v is not None)
    assert [tuple(r) for r in got] == [tuple(kept[int(p * (len(kept) - 1))] if kept else None for p in (0.0, 1 / 3, 0.75, 1.0))]


def test_pairs_are_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, f"r{i // 4}", sorted(set(rng.integers(1, 5, rng.integers(1, 3)).tolist())), [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(80)]
    frame = spark.createDataFrame(rows, "claim_id long, run_id string, contours array<int>, embedding array<float>")
    want = sorted(((round(float(np.dot(a[3], b[3])), 6), a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and not set(a[2]) & set(b[2])), key=lambda x: (-x[0], x[1], x[2]))
    # the sample sets the score to beat: all claims, few of them, and too few to set any
    for sample, block, n in ((2048, 512, 60), (20, 7, 60), (2, 512, 5000)):
        monkeypatch.setattr(pairs, "SAMPLE", sample)
        monkeypatch.setattr(pairs, "BLOCK", block)
        got = [tuple(r) for r in pairs.ranked_pairs(frame, n, Q.checkpointed).collect()]
        assert [(x[0], x[1]) for x in got] == [(x[1], x[2]) for x in want[:n]]
    assert pairs.ranked_pairs(frame.limit(0), 5, Q.checkpointed).count() == 0


def test_merge_fold_by_component_is_the_global_fold(spark):
    rng = random.Random(5)
    members = [(s, c) for s in range(60) for c in {rng.randrange(90) for _ in range(rng.randrange(2, 6))}]
    m = Q.checkpointed(spark.createDataFrame(members, "seed_id long, claim_id long"))
    p = Q.checkpointed(events.overlap_pairs(m))
    known = [(3, 3), (4, 3), (10, 10)]
    for before, limit in (([], None), (known, None), (known, 40)):
        k = spark.createDataFrame(before, "seed_id long, event_id long") if before else None
        got = {(r.seed_a, r.seed_b): (r.outcome, r.event_id) for r in events.merge(p, m, lambda e: events.label_components(e, Q.checkpointed), limit=limit, known=k).collect()}
        claims = {}
        for s, c in members:
            claims.setdefault(s, set()).add(c)
        turns = sorted((-len(r.shared), r.seed_a, r.seed_b) for r in p.collect())[:limit]
        want = events.fold([(i, a, b) for i, (_, a, b) in enumerate(turns)], {s: frozenset(c) for s, c in claims.items()}, events.overlap_judge, dict(before))
        assert got == {(a, b): (o, e) for _, a, b, o, e, _ in want}
        assert {o for o, _ in got.values()} >= {"created", "different_event"} and (limit or "insufficient" in {o for o, _ in got.values()})
        # canonical events by hand: each extension overwrites the summary
        made, seeds = {}, {}
        for k, a, b, o, e, summary in want:
            if o in ("created", "extended"):
                made.setdefault(e, []).append(summary)
                seeds.setdefault(e, set()).update((a, b))
        if not before:
            folded = Q.checkpointed(events.merge(p, m, lambda e: events.label_components(e, Q.checkpointed), limit=limit))
            assert {r.event_id: r.summary for r in events.canonical_events(folded).collect()} == {e: x[-1] for e, x in made.items()}
            held = events.event_members(folded)
            assert {(r.event_id, r.seed_id) for r in held.collect()} == {(e, x) for e, xs in seeds.items() for x in xs}
            roles = m.withColumn("role", F.when(F.col("claim_id") % 2 == 0, "anchor").otherwise("neighbor"))
            packets = {(r.event_id, r.claim_id) for r in events.event_packets(held, roles).collect()}
            assert packets == {(e, c) for e, xs in seeds.items() for x in xs for c in claims[x]}


CLAIM = {"claim_local_id": "c1", "claim_text": "t", "evidence_span": "ab", "evidence_start": 1, "evidence_end": 3, "epistemic_status": "asserted", "claim_time_text": None, "attribution_text": None}


@pytest.mark.parametrize(
    ("change", "top", "ok"),
    [
        ({}, {}, True), ({"claim_time_text": "null"}, {}, False), ({"attribution_text": " "}, {}, False), ({"extra": 1}, {}, False), ({}, {"summary": 1}, False), ({"evidence_span": ""}, {}, False),
        ({"evidence_span": "zz"}, {}, False), ({"attribution_text": " NULL "}, {}, False), ({"claim_time_text": 5}, {}, False), ({"evidence_end": 99}, {}, False), ({"evidence_end": -1}, {}, False), ({"evidence_start": 3, "evidence_end": 1}, {}, False),
        ({"claim_local_id": " "}, {}, True), ({"claim_local_id": ""}, {}, False), ({"claim_local_id": ["c1"]}, {}, False), ({"epistemic_status": ["asserted"]}, {}, False), ({"claim_text": None}, {}, False), ({}, {"claims": {}}, False), ({}, {"claims": [1]}, False), ({}, {"event": {"type": "x"}}, False), ({}, {"relations": []}, False),
        ({"claim_time_text": "May", "attribution_text": "he"}, {}, True), ({}, {"schema_version": "claim-extraction/2"}, False), ({}, {"claims": []}, True),
        ({"evidence_start": True}, {}, False), ({"evidence_start": 0}, {}, False), ({"epistemic_status": "sure"}, {}, False), ({"claim_text": " "}, {}, False), ({}, {"evidence_id": "e2"}, False),
    ],
)
def test_claim_validator(change, top, ok):
    raw = json.dumps({"schema_version": "claim-extraction/1", "evidence_id": "e1", "claims": [CLAIM | change]} | top)
    assert (validators.claim_errors(raw, "e1", "xabx") == []) is ok


def test_other_validators():
    assert validators.claim_errors("```json\n{}\n```", "e", "") and validators.claim_errors("", "e", "") and validators.claim_errors(None, "e", "")
    twice = json.dumps({"schema_version": "claim-extraction/1", "evidence_id": "e1", "claims": [CLAIM, CLAIM]})
    assert validators.claim_errors(twice, "e1", "xabx") == ["claim 1: repeated claim_local_id"]
    assert validators.claim_errors(twice, "e1", None) and validators.claim_errors("[" * 100_000, "e1", "x") and validators.claim_errors("[1]", "e1", "x")
    no_span = json.dumps({"schema_version": "claim-extraction/1", "evidence_id": "e1", "claims": [{k: v for k, v in CLAIM.items() if k != "evidence_span"}]})
    assert validators.claim_errors(no_span, "e1", "xabx") == ["claim 0: missing key: evidence_span", "claim 0: empty evidence_span"]
    rel = {"schema_version": "relation-judgment/2", "pair_id": "p", "shared_referent_status": "confirmed", "shared_referent_evidence": "«ab» \"no\"", "relation_label": "same_fact", "rationale_text": "r"}
    said = lambda **k: validators.relation_errors(json.dumps(rel | k), "p", "xabx", "y")
    assert said() == [] and said(shared_referent_status="insufficient") and said(shared_referent_evidence="none") and said(shared_referent_evidence='"zz"')
    assert said(shared_referent_status="insufficient", relation_label="related") == []
    assert validators.relation_errors("```json\n" + json.dumps(rel) + "\n```", "p", "xabx", None) == [] and said(relation_label=["same_fact"]) and said(shared_referent_status={}) and said(extra=1)
    assert validators.relation_errors(json.dumps(rel), "p", None, None) == ["no quote is verbatim"] and said(shared_referent_evidence='""ab"') == []
    ev = {"schema_version": "event-verification/1", "event_candidate_id": "e", "event_decision": "accepted_seed", "event_summary": "s", "members": [{"claim_id": c, "included": True, "member_rationale": "r"} for c in "ab"], "rationale_text": "r"}
    said = lambda **k: validators.event_errors(json.dumps(ev | k), "e", "a", ["a", "b"])
    assert said() == [] and said(event_summary=None) and said(members=ev["members"][:1]) and said(event_decision="rejected_seed", event_summary=None) == []
    assert said(members=[ev["members"][0], ev["members"][1] | {"included": False}])
    assert said(members=[ev["members"][0], ev["members"][1] | {"claim_id": ["b"]}]) and said(members=[1]) and said(members=None) and said(event_decision=[]) and said(members=[ev["members"][0], ev["members"][1] | {"included": 1}])
    assert said(event_decision="rejected_seed", event_summary=None, members=[m | {"included": False} for m in ev["members"]]) == []
    assert validators.event_errors("```\n" + json.dumps(ev) + "\n```", "e", "a", ["a", "b"]) == []
    assert validators.merge_errors("```json\n{\"decision\": \"insufficient\", \"merged_event_summary\": null, \"rationale_text\": \"r\"}\n```") == [] and validators.merge_errors('{"decision": [], "merged_event_summary": null, "rationale_text": "r"}')
    ok = {"decision": "same_event", "merged_event_summary": "s", "rationale_text": "r"}
    assert validators.merge_errors(json.dumps(ok)) == [] and validators.merge_errors(json.dumps(ok | {"decision": "insufficient"})) and validators.merge_errors(json.dumps(ok | {"decision": "insufficient", "merged_event_summary": None})) == []


def test_expectations(spark):
    t = spark.createDataFrame([("x", None), ("x", "s"), (None, None), ("y", None)], "decision string, summary string")
    assert expectations.check(t, "n", "(decision = 'x') = (summary IS NOT NULL)").first().violations == 1
    assert expectations.unique(t, "u", ["summary"]).first().violations == 1
    assert expectations.foreign_key(t, t.where("decision = 'x'"), "f", ["decision"]).first().violations == 1
    for p in expectations.PREDICATES.values():
        F.expr(p)


def test_models(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "k long, t string")
    e = {r.k: list(r.embedding) for r in models.embed(rows, "k", "t", models.hashing_embedder, 64).collect()}
    assert e[1] == e[3] and abs(sum(x * x for x in e[1]) - 1) < 1e-6
    with pytest.raises(Exception, match="dimensions"):
        models.embed(rows, "k", "t", models.hashing_embedder, 3).collect()

    def client():
        def call(p):
            if p is None:
                raise TimeoutError("late")
            return p.upper()

        return call

    got = {r.k: (r.raw, r.status) for r in models.model_stage(rows, "k", "t", client).collect()}
    assert got == {1: ("A B", "answered"), 2: (None, "transport_error"), 3: ("A B", "answered")}
    reg = spark.createDataFrame([(1, "m")], "model_id int, name string")
    models.verify_registered(reg, {"model_id": 1, "name": "m"})
    for bad in ({"model_id": 1, "name": "x"}, {"model_id": 2, "name": "m"}):
        with pytest.raises(ValueError):
            models.verify_registered(reg, bad)
    with pytest.raises(ValueError):
        models.single_contract(rows, ["k"])
    (tmp_path / "p.json").write_text('{"a": ["x", "y"], "b": ["z"]}')
    assert V.read_prototype_sets(spark, f"{tmp_path}/p.json").count() == 3
    (tmp_path / "l.txt").write_text("# no\n Word \n\n")
    assert [r.term for r in V.read_lexicon(spark, f"{tmp_path}/l.txt").collect()] == ["word"]
    for body, n in (('[{"evidence_id": "a"}]', 1), ('{"evidence": [{"evidence_id": "a"}, {"evidence_id": "b"}]}', 2)):
        (tmp_path / "e.json").write_text(body)
        assert V.read_evidence(spark, f"{tmp_path}/e.json").count() == n
    (tmp_path / "e.json").write_text('{"other": 1}')
    with pytest.raises(Exception, match="unknown fixture"):
        V.read_evidence(spark, f"{tmp_path}/e.json").collect()
    feed = spark.createDataFrame([("s", "http://h/a/#x", "T", "<b>x</b>", "Mon, 01 Jan 2024 10:00:00 +0200"), ("s", None, None, None, None)], "source_id string, link string, title string, summary string, published string")
    a, b = sorted(V.parse_feed(feed).collect(), key=lambda r: r.external_ref, reverse=True)
    assert a.external_ref == "http://h/a" and a.canonical_text == "T\nx" and a.published_at is not None and b.external_ref == "" and b.published_at is None


def test_reports(spark):
    d = spark.createDataFrame([(1, "a", "red red fox"), (1, "b", "red red fox"), (2, "a", ""), (3, "b", "blue 7 sky")], "content_id long, grp string, canonical_text string")
    c = {(r.grp, r.term): (r.tf, r.df) for r in reporting.term_counts(d, 1, []).collect()}
    assert c["a", "red"] == (2, 1) and c["b", "red"] == (2, 1)
    assert {r.grp: r.n for r in reporting.totals(d).collect()} == {"a": 2, "b": 2}
    al = reporting.aligned(reporting.term_counts(d, 1, []), reporting.totals(d).where("grp = 'a'"), "a", "zz", 1)
    assert al.where("df_b = 0 and n_b = 0").count() == al.count() > 0
    assert reporting.noise_filtered(reporting.term_counts(d, 2, []), ["blue"]).where("term like '%blue%'").count() == 0
    assert one(spark, S.percentage(F.lit(1), F.col("n")), n=0) is None


def test_ngrams_of_long_texts_are_linear(spark):
    """A text of 20,000 tokens in seconds; the terms are those of plain slicing."""
    import time

    words = [f"w{i % 701}" if i % 3 else "of" for i in range(20_000)]
    d = spark.createDataFrame([(1, "a", " ".join(words))], "content_id long, grp string, canonical_text string")
    began = time.time()
    for n in (2, 3):
        got = {r.term: r.tf for r in reporting.term_counts(d, n, ["of"]).collect()}
        grams = [words[i : i + n] for i in range(len(words) - n + 1)]
        want = {}
        for g in grams:
            if g[0] != "of" and g[-1] != "of":
                want[" ".join(g)] = want.get(" ".join(g), 0) + 1
        assert got == want
    assert time.time() - began < 30


def test_ingest_of_hot_texts_and_references(spark):
    """One text held by most deliveries, rejected ones among them, has one content; the window of references holds no rejected delivery."""
    rows = [(i, "s", "x" * 40 if i % 3 else "short", i % 50, i, dt.datetime(2024, 1, 1), "hx" if i % 3 else "hs") for i in range(600)]
    got = ingest.outcomes(spark.createDataFrame(rows, RAW)).select("doc_id", "outcome").collect()
    assert sorted(map(tuple, got)) == sequential(rows)


SAMPLE = ["bigrams", "quotes", "temporal_shift", "recall_gap", "claim_validation", "relation_validation", "event_validation", "merge_validation", "seed_order", "keyword_audit",
    "routing_decisions", "seeded_sample", "stratified_sample", "score_quadrants", "prototype_ablation", "routing_floor_rank", "routing_leakage", "noise_terciles", "routing_transition", "noise_argmax", "ingest_outcomes", "page_text", "candidate_pairs", "event_seeds", "overlap_pairs", "alias_hits", "contour_assignments", "trigrams", "contrastive_terms", "events_session", "hierarchy_closure"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_is_its_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.sql(Q.ORACLES[name])
    assert sorted(r.columns) == cols
    said = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    assert sorted([said(row[c]) for c in cols] for row in df.collect()) == sorted([said(v) for v in row] for row in r.select(*[f'"{c}"' for c in cols]).fetchall())
