"""The audits as queries; they join the registry, which this module hands on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audits, contours, routing, validators
from ..sources import views as V
from . import queries as Q
from .queries import ALIASES, ORACLES, QUERIES, ROUTED, RULES, SOURCES, query

__all__ = ["ORACLES", "QUERIES"]

# Fixed values of the synthetic registries.
KEYWORDS = ["mail", "licen", "copyright", "unit", "einheit", "that"]
CANONICAL = [(1, "that"), (2, "nicht"), (3, "los"), (4, "pour"), (5, "with"), (6, "mail3")]
RENAMED = {"that": "that (conjunction)", "los": "los (article)"}
LEMMA_RULES = [{"lang": "de", "lemma": "und", "surface_prefix": "un", "replace": "sowie"}, {"lang": "en", "lemma": "with", "surface_prefix": "wi", "replace": "by"}]
LANGUAGES = ["en", "de", "fr"]
KEPT = ["the", "die"]

PROVENANCE = SOURCES + "," + ROUTED + ", prov AS (SELECT DISTINCT o.content_id FROM occ o JOIN sources s ON s.source_id = o.source_id WHERE s.contour_id = 2), flagged AS (SELECT n.*, content_id IN (SELECT content_id FROM prov) AS inside FROM noised n)"


def flagged(spark, sf):
    """noised with inside: was the content seen in a source of contour 2?"""
    occ = Q.ingested(spark, sf)[2]
    seen = occ.join(V.sources(spark, sf).where("contour_id = 2").select("source_id"), "source_id")
    return audits.with_flag(Q.noised(spark, sf), "content_id", seen, "inside")


@query("keyword_audit", ROUTED + f", k AS (SELECT r.content_id, list_filter([{', '.join(repr(k) for k in KEYWORDS)}], lambda x: contains(lower(c.canonical_text), x)) AS m FROM routed r JOIN content c ON c.content_id = r.content_id WHERE r.decision = 'skip') SELECT content_id, array_to_string(m, ',') AS matched FROM k WHERE len(m) > 0")
def _(spark, sf):
    content = Q.contents(spark, sf).select("content_id", "canonical_text")
    rows = Q.routed(spark, sf).where("decision = 'skip'").select("content_id").join(content, "content_id")
    return audits.keyword_hits(rows, F.col("canonical_text"), KEYWORDS).select("content_id", F.array_join("matched", ",").alias("matched"))


@query("score_quadrants", PROVENANCE + ", cut AS (SELECT list_sort(list(noise_score))[1 + CAST(floor(0.75 * (count(*) - 1)) AS INTEGER)] AS hi, list_sort(list(noise_score))[1 + CAST(floor(0.5 * (count(*) - 1)) AS INTEGER)] AS mid FROM noised), q AS (SELECT CASE WHEN noise_score >= hi AND inside THEN 'high_in' WHEN noise_score >= hi THEN 'high_out' WHEN noise_score < mid AND inside THEN 'low_in' END AS quadrant FROM flagged, cut) SELECT quadrant, count(*) AS n FROM q WHERE quadrant IS NOT NULL GROUP BY quadrant")
def _(spark, sf):
    return audits.quadrants(flagged(spark, sf), "noise_score", "inside")


@query("provenance_distribution", PROVENANCE + " SELECT inside, count(*) AS n, round(quantile_cont(noise_score, 0.1), 6) AS p10, round(quantile_cont(noise_score, 0.5), 6) AS p50, round(quantile_cont(noise_score, 0.9), 6) AS p90 FROM flagged GROUP BY inside")
def _(spark, sf):
    return audits.distribution(flagged(spark, sf), "noise_score", "inside")


@query("stratified_sample", PROVENANCE + ", cut AS (SELECT quantile_cont(noise_score, 0.1) FILTER (WHERE inside) AS a, quantile_cont(noise_score, 0.45) FILTER (WHERE inside) AS b, quantile_cont(noise_score, 0.55) FILTER (WHERE inside) AS c, quantile_cont(noise_score, 0.9) FILTER (WHERE inside) AS d, quantile_cont(noise_score, 0.9) FILTER (WHERE NOT inside) AS e FROM flagged), st AS (SELECT content_id, CASE WHEN NOT inside THEN CASE WHEN noise_score >= e THEN 'out_q90' END WHEN noise_score <= a THEN 'in_q10' WHEN noise_score BETWEEN b AND c THEN 'in_mid' WHEN noise_score >= d THEN 'in_q90' END AS stratum FROM flagged, cut), r AS (SELECT content_id, stratum, CAST(row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(content_id AS VARCHAR) || ':42'), content_id) AS INTEGER) AS rank FROM st WHERE stratum IS NOT NULL) SELECT * FROM r WHERE rank <= 15")
def _(spark, sf):
    return audits.stratified_sample(flagged(spark, sf), "content_id", "noise_score", "inside", 15)


@query("prototype_ablation", ROUTED + f", one AS (SELECT d.vec_id AS dropped, v.content_id, max({Q.DOT.format('v.embedding', 'p.embedding')}) AS rel FROM vec v, proto p, proto d WHERE p.kind = 'rel' AND d.kind = 'rel' AND p.vec_id <> d.vec_id GROUP BY ALL), ch AS (SELECT dropped, r.decision AS old, CASE WHEN round(o.rel - m.irr, 6) >= 0.10 THEN 'analyze' WHEN round(o.rel - m.irr, 6) <= -0.07 THEN 'skip' ELSE 'maybe' END AS new FROM one o JOIN maxes m ON m.content_id = o.content_id JOIN routed r ON r.content_id = o.content_id) SELECT CAST(dropped AS VARCHAR) AS dropped, count(*) FILTER (WHERE old <> new) AS n_changed, count(*) FILTER (WHERE old = 'analyze' AND new <> 'analyze') AS n_left_analyze FROM ch GROUP BY 1")
def _(spark, sf):
    p = V.prototypes(spark, sf)
    return audits.prototype_ablation(Q.eligible(spark, sf), p["relevant"], p["irrelevant"])


@query("category_top", ROUTED + ", r AS (SELECT category, content_id, noise_score, CAST(row_number() OVER (PARTITION BY category ORDER BY noise_score DESC, content_id) AS INTEGER) AS rank FROM noised) SELECT * FROM r WHERE rank <= 5")
def _(spark, sf):
    return routing.top_per_group(Q.noised(spark, sf), ["category"], [F.desc("noise_score"), F.col("content_id")], 5).select("category", "content_id", "noise_score", "rank")


@query("candidate_pool", Q._HITS + f", ru AS ({Q._RULES_SQL}) SELECT DISTINCT content_id FROM (SELECT content_id FROM hits WHERE object_id <> 6 UNION ALL SELECT content_id FROM ru WHERE facet IN ('contact', 'licence')) WHERE content_id NOT IN (SELECT content_id FROM hits WHERE object_id = 6)")
def _(spark, sf):
    norm = Q._norm(spark, sf)
    hits = contours.alias_hits(norm, ALIASES)
    return audits.pool(hits.where("object_id = 6"), hits.where("object_id <> 6"), contours.rule_hits(norm, RULES).where("facet in ('contact', 'licence')"))


@query("extraction_report", Q.CLAIM_ERRORS + ", v AS (SELECT len(errors) = 0 AS ok FROM ce) SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS n_valid, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE ok) / count(*), 3) END AS pass_rate FROM v")
def _(spark, sf):
    told = Q.claim_responses(spark, sf).select(validators.claim_errors_udf("raw", F.col("doc_id").cast("string"), "text").alias("errors"))
    return audits.run_report(told, F.size("errors") == 0)


@query("alias_modes", f"al(reference_id, object_id, alias) AS (VALUES {Q._ALIAS_ROWS}), ob(object_id, canonical_name) AS (VALUES {', '.join(f'({o}, {c!r})' for o, c in CANONICAL)}) SELECT CAST(reference_id AS INTEGER) AS reference_id, CASE alias " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RENAMED.items()) + " ELSE alias END AS alias, CASE WHEN ob.object_id IS NULL THEN 'exact' ELSE 'both' END AS match_mode FROM al LEFT JOIN ob ON ob.object_id = al.object_id AND ob.canonical_name = al.alias")
def _(spark, sf):
    aliases = spark.createDataFrame(ALIASES, "reference_id int, object_id int, alias string").withColumn("match_mode", F.lit("exact"))
    out = audits.matching_modes(aliases, spark.createDataFrame(CANONICAL, "object_id int, canonical_name string"))
    return audits.renamed(out, "alias", RENAMED).select("reference_id", "alias", "match_mode")


@query("normalized_terms", "t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-zа-яёіїєґ0-9]+(?:''[a-zа-яёіїєґ0-9]+)*')) AS w FROM documents), m AS (SELECT lang, CASE WHEN lang NOT IN ('en', 'de', 'fr') OR w IN ('the', 'die') THEN w WHEN lang = 'de' AND w = 'und' THEN 'sowie' WHEN lang = 'en' AND w = 'with' THEN 'by' ELSE w END AS term FROM t) SELECT lang, term, count(*) AS n FROM m GROUP BY lang, term")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    terms = d.select("lang", F.explode(T.normalized_tokens(F.col("text"), F.col("lang"), LANGUAGES, KEPT, LEMMA_RULES)).alias("term"))
    return terms.groupBy("lang", "term").agg(F.count("*").alias("n"))
