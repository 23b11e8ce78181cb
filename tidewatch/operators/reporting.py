"""Term reports: TF and DF by group, contrastive log-odds, temporal shift, cloud weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T


def documents(content: DataFrame, occurrences: DataFrame, sources: DataFrame, groups: list[str], source_group: str | None = None, since_hours: int | None = None, start=None, end=None, now=None) -> DataFrame:
    """(content_id, grp, canonical_text, names): content seen in two groups is a document of each. Options on its first sighting: the last hours before now, from start, before end."""
    if since_hours is not None and (start is not None or end is not None):
        raise ValueError("either hours or a start and end")
    if since_hours is not None and since_hours <= 0:
        raise ValueError("hours must be positive")
    for kept in (
        None if since_hours is None else F.col("first_seen") >= (F.current_timestamp() if now is None else F.lit(now)) - F.make_interval(hours=F.lit(since_hours)),
        None if start is None else F.col("first_seen") >= start,
        None if end is None else F.col("first_seen") < end,
    ):
        content = content if kept is None else content.where(kept)
    occ = occurrences.join(sources.select("source_id", "source_group"), "source_id").where(F.col("source_group").isin(groups))
    if source_group is not None:
        occ = occ.where(F.col("source_group") == source_group)
    seen = occ.groupBy("content_id", F.col("source_group").alias("grp")).agg(F.array_sort(F.collect_set("source_id")).alias("names"))
    return seen.join(content.select("content_id", "canonical_text"), "content_id")


def cleaned(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """docs with their texts normalized and without boilerplate and their sources' own names."""
    return docs.withColumn("canonical_text", T.clean_text(F.col("canonical_text"), F.col("names"), rules))


def term_counts(docs: DataFrame, n: int, stopwords: list[str]) -> DataFrame:
    """(grp, term, tf, df): exploded terms are summed for each document first, then for each group."""
    toks = docs.select("content_id", "grp", T.tokens(F.col("canonical_text")).alias("toks"))
    terms = toks.select("content_id", "grp", F.explode(T.ngrams(F.col("toks"), n, stopwords)).alias("term"))
    per_doc = terms.groupBy("grp", "term", "content_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("grp", "term").agg(F.sum("c").alias("tf"), F.count("*").alias("df"))


def totals(docs: DataFrame) -> DataFrame:
    """Documents of each group, those without any term included."""
    return docs.groupBy("grp").agg(F.count("*").alias("n"))


def top_terms(counts: DataFrame, n_docs: DataFrame, min_df: int, n: int) -> DataFrame:
    w = Window.partitionBy("grp").orderBy(F.desc("df"), F.desc("tf"), "term")
    best = counts.where(F.col("df") >= min_df).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return best.join(F.broadcast(n_docs), "grp").select("grp", "term", "tf", "df", "rank", F.round(S.percentage(F.col("df"), F.col("n")), 6).alias("pct"))


def aligned(counts: DataFrame, n_docs: DataFrame, a: str, b: str, min_df: int) -> DataFrame:
    """(term, df_a, df_b, n_a, n_b, score): both groups' terms in one aggregation, zero where one lacks it."""
    side = lambda g: F.sum(F.when(F.col("grp") == g, F.col("df")).otherwise(0))
    total = lambda g, name: n_docs.agg(F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("n"))), F.lit(0)).alias(name))
    both = counts.where(F.col("grp").isin(a, b)).groupBy("term").agg(side(a).alias("df_a"), side(b).alias("df_b")).where(F.col("df_a") + F.col("df_b") >= min_df)
    sized = both.crossJoin(F.broadcast(total(a, "n_a"))).crossJoin(F.broadcast(total(b, "n_b")))
    return sized.withColumn("score", F.round(S.log_odds(F.col("df_a"), F.col("n_a"), F.col("df_b"), F.col("n_b")), 6))


def both_ends(scored: DataFrame, n: int) -> DataFrame:
    """(side, rank, term, score): most distinctive terms of either side; the second with its sign turned."""
    a, b = [F.desc("score"), F.desc("df_a"), F.col("term")], [F.asc("score"), F.desc("df_b"), F.col("term")]
    return _ends(scored, n, a, b)


def shift_ends(scored: DataFrame, n: int) -> DataFrame:
    """The same for new (a) against old (b) texts: equal scores go by the change of the share of documents first."""
    share = lambda x: F.coalesce(S.percentage(F.col(f"df_{x}"), F.col(f"n_{x}")), F.lit(0.0))
    moved = scored.withColumn("delta", F.round(share("a") - share("b"), 6))
    a, b = [F.desc("score"), F.desc("delta"), F.desc("df_a"), F.col("term")], [F.asc("score"), F.asc("delta"), F.desc("df_b"), F.col("term")]
    return _ends(moved, n, a, b)


def _ends(scored: DataFrame, n: int, first: list, second: list) -> DataFrame:
    ends = []
    for side, order, score in (("a", first, F.col("score")), ("b", second, -F.col("score"))):
        best = scored.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        ends.append(best.select(F.lit(side).alias("side"), "rank", "term", score.alias("score")))
    return ends[0].union(ends[1])


def noise_filtered(counts: DataFrame, noise: list[str]) -> DataFrame:
    """Without terms that hold a number or a noise word."""
    return counts.where(~F.exists(F.split("term", " "), lambda t: t.rlike(r"^[0-9]+$") | t.isin(noise)))
