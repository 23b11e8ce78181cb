"""Collected sources and audits on small frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators import audits, routing
from tidewatch.sources import collect
from tidewatch.sources import views as V

PAGE = """<html><body><div class="wrap"><div class="x tgme_widget_message" data-post="chan/1"><div class="tgme_widget_message_text js">One <b>bold</b><br/>&lt;tag&gt; <div>inner</div> end</div>
<a class="tgme_widget_message_date" href="#"><time datetime="2024-01-02T03:04:05+02:00"></time></a></div>
<div class="tgme_widget_message" data-post="chan/2"><div>photo <time datetime="2020-01-01T00:00:00+00:00"></time></div></div><div class="tgme_widget_message">no id</div></div>
<div class="tgme_widget_message" data-post="chan/3"><div class="tgme_widget_message_text">cut off"""


def test_channel_posts(spark):
    found = collect.posts(PAGE)
    assert [f[0] for f in found] == ["chan/1", "chan/2", "chan/3"] and found[1][1:] == ("", None)
    pages = spark.createDataFrame([("s", PAGE), ("s", None), ("s", "")], "source_id string, html string")
    got = {r.external_ref: r for r in collect.channel_posts(pages).collect()}
    first = got["https://t.me/chan/1"]
    assert len(got) == 3 and first.canonical_text == first.title == "One bold <tag> inner end"
    assert first.published_at == dt.datetime(2024, 1, 2, 1, 4, 5) or first.published_at.timestamp() == 1704157445
    assert got["https://t.me/chan/2"].canonical_text == "" and got["https://t.me/chan/3"].canonical_text == "cut off"


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><title>c</title><item><title>A</title><link>http://h/a/#x</link><description><![CDATA[<p>x &amp; y</p>]]></description><pubDate>Mon, 01 Jan 2024 10:00:00 +0200</pubDate></item><item><title>B</title></item></channel></rss>")
    got = {r.title: r for r in V.parse_feed(collect.read_feed(spark, f"{tmp_path}/f.xml", "s")).collect()}
    assert got["A"].external_ref == "http://h/a" and got["A"].canonical_text == "A\nx & y" and got["A"].published_at is not None
    assert got["B"].external_ref == "" and got["B"].canonical_text == "B" and got["B"].published_at is None


def test_registered_sources(spark):
    s = spark.createDataFrame([("a", "telegram", "https://t.me/s/a", True), ("b", "telegram", "https://t.me/b", True), ("c", "telegram", "https://t.me/s/c", False), ("d", "rss", "http://h", True)], "source_id string, source_type string, url string, is_active boolean")
    assert [r.source_id for r in collect.channel_sources(s).collect()] == ["a"]
    assert collect.source_by_url(s, "http://h") == "d"
    with pytest.raises(ValueError):
        collect.source_by_url(s, "http://none")


def test_keywords_flags_pools(spark):
    t = spark.createDataFrame([(1, "A Mail unit"), (2, None), (3, "none"), (4, "UNITS")], "k long, title string")
    assert {r.k: r.matched for r in audits.keyword_hits(t, F.col("title"), ["unit", "mail"]).collect()} == {1: ["unit", "mail"], 4: ["unit"]}
    held = spark.createDataFrame([(1,), (1,), (9,)], "k long")
    assert {r.k: r.f for r in audits.with_flag(t, "k", held, "f").collect()} == {1: True, 2: False, 3: False, 4: False}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "content_id long")
    assert sorted(r.content_id for r in audits.pool(ids(2, 7), ids(1, 2), ids(2, 3, 3)).collect()) == [1, 3]


def test_quadrants_and_strata(spark):
    rows = [(i, i / 10, i % 2 == 0) for i in range(10)]
    d = spark.createDataFrame(rows, "k long, s double, f boolean")
    v = sorted(x for _, x, _ in rows)
    hi, mid = v[int(0.75 * 9)], v[int(0.5 * 9)]
    want = {"high_in": sum(x >= hi and f for _, x, f in rows), "high_out": sum(x >= hi and not f for _, x, f in rows), "low_in": sum(x < mid and f for _, x, f in rows)}
    assert {r.quadrant: r.n for r in audits.quadrants(d, "s", "f").collect()} == {k: n for k, n in want.items() if n}
    sample = audits.stratified_sample(d, "k", "s", "f", 1)
    got = sample.collect()
    assert {r.stratum for r in got} == {"in_q10", "in_mid", "in_q90", "out_q90"} and len(got) == 4
    assert sorted(got) == sorted(audits.stratified_sample(d.repartition(5), "k", "s", "f", 1).collect())
    assert audits.stratified_sample(d.where("k < 0"), "k", "s", "f", 1).count() == audits.quadrants(d.where("k < 0"), "s", "f").count() == 0
    assert routing.seeded_sample(d, "k", 3).collect() == routing.seeded_sample(d.repartition(4), "k", 3).collect()


def test_prototype_ablation(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "content_id long, embedding array<float>")
    got = {r.dropped: (r.n_changed, r.n_left_analyze) for r in audits.prototype_ablation(d, [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.9])], [("z", [0.0, 0.0])]).collect()}
    # only the first vector loses its one relevant prototype
    assert got == {"a": (1, 1), "b": (0, 0), "c": (0, 0)}


def test_reports_and_registry(spark):
    d = spark.createDataFrame([(1, 0.123456, None), (2, None, "x")], "k long, s double, t string")
    assert sorted(json.loads(r.value)["k"] for r in audits.report_lines(d, "s").collect()) == [1, 2]
    assert {json.loads(r.value)["s"] for r in audits.report_lines(d, "s").collect()} == {0.1235, None}
    one = audits.run_report(d, F.col("t").isNotNull()).first()
    assert (one.n, one.n_valid, one.pass_rate) == (2, 1, 0.5)
    assert audits.run_report(d.where("k > 9"), F.lit(True)).first().pass_rate is None
    a = spark.createDataFrame([(1, "x", "exact"), (1, "y", "exact"), (2, "x", "semantic")], "object_id int, alias string, match_mode string")
    o = spark.createDataFrame([(1, "x"), (1, "x")], "object_id int, canonical_name string")
    assert sorted(tuple(r) for r in audits.matching_modes(a, o).collect()) == [(1, "x", "both"), (1, "y", "exact"), (2, "x", "semantic")]
    assert sorted(r.alias for r in audits.renamed(a, "alias", {"x": "X"}).collect()) == ["X", "X", "y"]


def test_normalized_tokens(spark):
    rules = [{"lang": "uk", "lemma": "мати", "surface_prefix": "ма", "replace": "мата"}]
    d = spark.createDataFrame([("uk", "Має, мати!"), ("xx", "a b"), ("uk", None), (None, "a")], "lang string, t string")
    got = [r.w for r in d.select(T.normalized_tokens(F.col("t"), F.col("lang"), ["uk"], ["має"], rules).alias("w")).collect()]
    assert got == [["має", "мата"], ["a", "b"], [], ["a"]]
