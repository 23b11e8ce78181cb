"""Readers, text expressions, checks, writes and streams as queries; they join the registry of queries. Small input files are written to the shared folder first."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audits, contours, events, models, writes
from ..sources import collect, registry
from ..sources import views as V
from ..streaming import jobs
from . import queries as Q
from .queries import INGEST, ORACLES, QUERIES, SEEDS, SOURCES, query

__all__ = ["ORACLES", "QUERIES"]


def _folder(spark) -> str:
    return f"{Q.shared_dir(spark)}/engine-files-{uuid.uuid4().hex}"


def _file(spark, text: str) -> str:
    path = _folder(spark)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return path


# ---------------------------------------------------------------- readers


@query("lexicon_terms", "l(term) AS (VALUES " + ", ".join(f"('{w}')" for w in Q.STOPWORDS) + ") SELECT term, count(d.doc_id) AS n FROM l LEFT JOIN documents d ON list_contains(string_split(lower(d.text), ' '), term) GROUP BY term")
def _(spark, sf):
    path = _file(spark, "# stopwords\n\n" + "\n".join(f"  {w.upper()} " for w in Q.STOPWORDS) + "\n#end\n")
    words = V.table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("term"))
    return V.read_lexicon(spark, path).join(words, "term", "left").groupBy("term").agg(F.count("doc_id").alias("n"))


_SETS = {"relevant": ["one", "two"], "irrelevant": ["three"], "none": []}


@query("prototype_sets", "s(set_name, ordinal, text) AS (VALUES " + ", ".join(f"('{s}', {i}, '{t}')" for s, ts in _SETS.items() for i, t in enumerate(ts)) + ") SELECT * FROM s")
def _(spark, sf):
    return V.read_prototype_sets(spark, _file(spark, json.dumps(_SETS)))


@query("jsonl_filter", "j AS (SELECT event_id, event_type FROM events WHERE event_type = 'click') SELECT * FROM j")
def _(spark, sf):
    path = _folder(spark)
    V.table(spark, sf, "events").select("event_id", "event_type").write.json(path)
    return V.read_jsonl(spark, path, "event_id long, event_type string", "event_type = 'click'")


#: Bytes of one evidence file, and of the items that Spark hands to Python at once.
EVIDENCE_BYTES = 4 << 20


def write_evidence(items: DataFrame, path: str, size: int = EVIDENCE_BYTES) -> None:
    """Items (listed boolean, item binary, one JSON object each) as files of at most size bytes: a list of those listed, an object with one of the others.

    Only a longer item makes a longer file. Each task packs its own rows, so no file and no row grows with the table.
    """

    def pack(batches):
        held, total = {True: [], False: []}, {True: 0, False: 0}

        def file(listed):
            value = (b"[%b]" if listed else b'{"evidence":[%b]}') % b",".join(held[listed])
            held[listed], total[listed] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])

        for batch in batches:
            for listed, item in zip(batch.column(0), batch.column(1), strict=True):
                listed, item = listed.as_py(), item.as_py()
                more = len(item) + 1  # with its comma
                if held[listed] and total[listed] + more + len(b'{"evidence":[]}') > size:
                    yield file(listed)
                held[listed].append(item)
                total[listed] += more
        for listed in held:
            if held[listed]:
                yield file(listed)

    conf = items.sparkSession.conf
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(EVIDENCE_BYTES)}
    before = {k: conf.get(k, None) for k in bounds}
    try:
        for k, v in bounds.items():
            conf.set(k, v)
        items.select("listed", "item").mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


@query("evidence_items", "e AS (SELECT CAST(doc_id AS VARCHAR) AS evidence_id, source, sha256(text) AS text_hash FROM documents) SELECT * FROM e")
def _(spark, sf):
    """Half of the items come in lists, half in objects with one."""
    item = F.struct(F.col("doc_id").cast("string").alias("evidence_id"), "source", "text")
    listed = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    path = _folder(spark)
    write_evidence(V.table(spark, sf, "documents").select(listed.alias("listed"), F.to_json(item).cast("binary").alias("item")), path)
    return V.read_evidence(spark, path).select("evidence_id", "source", F.sha2("text", 256).alias("text_hash"))


@query("boilerplate_rules", "r(name, n_sources) AS (VALUES " + ", ".join(f"('{r['name']}', {len(r.get('source_names', []))})" for r in Q.BOILERPLATE) + ") SELECT * FROM r")
def _(spark, sf):
    found = registry.read_rules(spark, _file(spark, json.dumps(Q.BOILERPLATE)))
    return spark.createDataFrame([(r["name"], len(r.get("source_names", []))) for r in found], "name string, n_sources int")


@query("prompt_registry", "p AS (SELECT 'judge' AS prompt_name, 2 AS prompt_version, sha256('it''s' || chr(10) || '<<PAYLOAD_JSON>>' || chr(10)) AS text_hash) SELECT * FROM p")
def _(spark, sf):
    """A prompt file, under its own name as files have in a prompt folder."""
    text = "it's\n<<PAYLOAD_JSON>>"
    path = _file(spark, text)
    raw = spark.read.text(path, wholetext=True)
    models.verify_prompt(raw.first().value, text + "\n")
    return raw.select(F.lit("judge").alias("prompt_name"), F.lit(2).alias("prompt_version"), F.sha2("value", 256).alias("text_hash"))


_URL = "CASE WHEN n % 2 = 1 AND n % 3 <> 0 THEN 'https://t.me/s/' || source_id WHEN n % 2 = 1 THEN 'https://t.me/' || source_id ELSE 'http://h' || n || CASE WHEN n % 4 = 0 THEN '.ru' ELSE '.org' END || '/f' END"


def _with_urls(spark, sf):
    n = F.col("n")
    site = F.concat(F.lit("http://h"), n.cast("string"), F.when(n % 4 == 0, ".ru").otherwise(".org"), F.lit("/f"))
    url = F.when((n % 2 == 1) & (n % 3 != 0), F.concat(F.lit("https://t.me/s/"), "source_id")).when(n % 2 == 1, F.concat(F.lit("https://t.me/"), "source_id")).otherwise(site)
    return V.sources(spark, sf).withColumn("url", url)


@query("channel_sources", SOURCES + f", u AS (SELECT *, {_URL} AS url FROM sources) SELECT source_id, url FROM u WHERE source_type = 'telegram' AND is_active AND starts_with(url, 'https://t.me/s/')")
def _(spark, sf):
    return collect.channel_sources(_with_urls(spark, sf)).select("source_id", "url")


@query("source_by_url", SOURCES + f", u AS (SELECT *, {_URL} AS url FROM sources) SELECT source_id FROM u WHERE url = 'http://h2.org/f'")
def _(spark, sf):
    return spark.createDataFrame([(collect.source_by_url(_with_urls(spark, sf), "http://h2.org/f"),)], "source_id string")


@query("fetch_outcomes", SOURCES + f", u AS (SELECT *, {_URL} AS url FROM sources) SELECT source_id, CASE WHEN n % 5 = 0 THEN 'failed' WHEN n % 5 = 1 THEN 'http_404' ELSE 'ok' END AS status, CASE WHEN n % 5 > 1 THEN CASE WHEN n % 4 = 0 THEN 'proxy' ELSE 'direct' END END AS body FROM u")
def _(spark, sf):
    def client():
        def get(url: str, proxy: bool) -> tuple[int, str]:
            n = int("".join(c for c in url.split("?")[0].rsplit("src", 1)[-1].removeprefix("http://h").split(".")[0] if c.isdigit()))
            if n % 5 == 0:
                raise ConnectionError("no route")
            return (404, "") if n % 5 == 1 else (200, "proxy" if proxy else "direct")

        return get

    return collect.fetched(_with_urls(spark, sf), client, delay=0.0).select("source_id", "status", "body")


# ---------------------------------------------------------------- text


_LEAD = "CASE WHEN doc_id % 3 = 0 THEN '  ' || (doc_id % 20000) || ' words' WHEN doc_id % 3 = 1 THEN doc_id || 'th' ELSE 'no ' || doc_id END"


@query("text_expressions", "d AS (SELECT doc_id, text, " + _LEAD + " AS name FROM documents) SELECT doc_id, sha256(text || ' fi''''''') AS normalized, sha256(regexp_replace(regexp_replace('T' || doc_id || chr(10) || text, '^\\s+', ''), '\\s+$', '')) AS canonical, 'id ' || doc_id || ': <<B>>' AS prompt, CASE WHEN doc_id % 3 = 0 AND doc_id % 20000 < 10000 THEN CAST(doc_id % 20000 AS VARCHAR) ELSE '' END AS leading, regexp_replace(regexp_replace(lower(text), 'ß', 'ss', 'g') , '\\s+', ' ', 'g') <> '' AS folded FROM d")
def _(spark, sf):
    key = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), (F.col("doc_id") % 20000).cast("string"), F.lit(" words"))).when(F.col("doc_id") % 3 == 1, F.concat(key, F.lit("th"))).otherwise(F.concat(F.lit("no "), key))
    return V.table(spark, sf, "documents").select(
        "doc_id", F.sha2(T.normalize_text(F.concat("text", F.lit(" ﬁ’ʼ`"))), 256).alias("normalized"), F.sha2(T.canonical_text(F.concat(F.lit("T"), key), F.col("text")), 256).alias("canonical"),
        # what a value holds is not filled again
        T.fill("id <<A>>: <<B>>", b=F.lit("<<B>>"), a=key).alias("prompt"), contours.leading_number(name).alias("leading"), (T.casefold("text") != "").alias("folded"),
    )


@query("report_lines", "e AS (SELECT event_id, round(value, 4) AS value, event_type FROM events) SELECT event_id, value, event_type FROM e")
def _(spark, sf):
    lines = audits.report_lines(V.table(spark, sf, "events").select("event_id", "value", "event_type"), "value")
    return lines.select(F.from_json("value", "event_id long, value double, event_type string").alias("j")).select("j.*")


# ---------------------------------------------------------------- checks


@query("missing_facets", "r(contour_id, facet) AS (VALUES " + ", ".join(f"({c}, '{f}')" for f, c in Q.RULE_CONTOUR.items()) + ") SELECT contour_id, facet FROM r WHERE facet <> 'money'")
def _(spark, sf):
    rules = spark.createDataFrame([(c, f) for f, c in Q.RULE_CONTOUR.items()], "contour_id int, facet string")
    return contours.missing_facets(rules, rules.select("contour_id", "facet", (F.col("facet") == "money").alias("active")))


@query("registry_checks", "k(name, failed) AS (VALUES ('model', false), ('other model', true), ('prompt', false), ('other prompt', true), ('one contract', false), ('two contracts', true)) SELECT * FROM k")
def _(spark, sf):
    reg = spark.createDataFrame([(1, "m", 64)], "model_id int, name string, dimension int")
    one = V.vectors(spark, sf).select(F.lit(1).alias("model_id"), F.lit(2).alias("prompt_id"))
    tried = {
        "model": lambda: models.verify_registered(reg, {"model_id": 1, "name": "m", "dimension": 64}), "other model": lambda: models.verify_registered(reg, {"model_id": 1, "name": "m", "dimension": 32}),
        "prompt": lambda: models.verify_prompt("a\n", "a\n"), "other prompt": lambda: models.verify_prompt("a\n", "a"),
        "one contract": lambda: models.single_contract(one, ["model_id", "prompt_id"]), "two contracts": lambda: models.single_contract(one.union(one.limit(1).select("model_id", F.lit(3))), ["model_id", "prompt_id"]),
    }
    out = []
    for name, check in tried.items():
        try:
            check()
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, failed boolean")


@query("model_answers", "a AS (SELECT conv_id * 1000 + turn AS key, CASE WHEN turn % 3 = 1 THEN 'transport_error' ELSE 'answered' END AS status, CASE WHEN turn % 3 <> 1 THEN sha256(upper(role)) END AS answer FROM conversations) SELECT * FROM a")
def _(spark, sf):
    def client():
        def call(prompt: str) -> str:
            if prompt.startswith("1"):
                raise TimeoutError("late")
            return prompt[1:].upper()

        return call

    asked = V.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.concat((F.col("turn") % 3).cast("string"), "role").alias("prompt"))
    return models.model_stage(asked, "key", "prompt", client).select("key", "status", F.sha2("raw", 256).alias("answer"))


# ---------------------------------------------------------------- writes and streams


@query("seed_inserts", SEEDS + " SELECT seed_id, claim_id FROM members WHERE seed_id % 3 <> 0")
def _(spark, sf):
    m = events.seed_members(Q.seeded(spark, sf)).select("seed_id", "claim_id")
    seeds = m.select("seed_id").distinct()
    return writes.parents_with_children(seeds.where("seed_id % 3 = 0"), seeds, m, ["seed_id"])[1]


def _ingested(spark, sf, batches):
    """Outcomes of a landing folder that a stream reads: one batch of all files, or one for each file in the order of arrival."""
    root, raw = _folder(spark), V.raw_items(spark, sf)
    landing = f"{root}/landing"
    top = raw.agg(F.max("doc_id")).first()[0] + 1
    # deliveries arrive in the order of their numbers; the second ones come last
    lots = [raw] if batches == 1 else [raw.where(f"delivery = 0 and doc_id >= {top * k // (batches - 1)} and doc_id < {top * (k + 1) // (batches - 1)}") for k in range(batches - 1)] + [raw.where("delivery = 1")]
    for lot in lots:
        lot.coalesce(1).write.mode("append").parquet(landing)
        jobs.ingest_stream(spark.readStream.schema(raw.schema).parquet(landing), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out/raw").select("doc_id", "arrival", "source_id", "external_ref", "outcome")


_OUTCOMES = INGEST + " SELECT doc_id, arrival, source_id, external_ref, outcome FROM done"


@query("streamed_ingestion", _OUTCOMES)
def _(spark, sf):
    return _ingested(spark, sf, 1)


@query("batched_ingestion", _OUTCOMES)
def _(spark, sf):
    return _ingested(spark, sf, 4)


@query("events_tumbling_stream", ORACLES["events_tumbling"].removeprefix("WITH "))
def _(spark, sf):
    ev, name = V.table(spark, sf, "events"), f"tumbling_{uuid.uuid4().hex}"
    root = _folder(spark)
    ev.write.parquet(f"{root}/landing")
    stream = jobs.tumbling(spark.readStream.schema(ev.schema).parquet(f"{root}/landing"))
    stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
