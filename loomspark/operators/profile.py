"""Profiles, histograms and statistics of a corpus, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.config import Curation
from loomspark.functions import keywords as K
from loomspark.functions import text as X
from loomspark.operators import scenes

#: Edges of the token histogram of profiles.
TOKEN_EDGES = (0, 400, 800, 1200, 1600, 2000, 3000, 10**9)


def profiles(df: DataFrame, keywords: list[str] | None, min_hits: int = 2, scene: str = "scene_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """(scene_id, n_segments, tokens, passed) of scenes that aren't empty once cleaned."""
    s = scenes.ordered(df, scene, pos, text).select("scene_id", F.size("segments").alias("n_segments"), X.once(X.clean(F.array_join("segments", "\n\n"))).alias("_t")).where("_t <> ''")
    passed = K.hits("_t", K.pattern(keywords)) >= min_hits if keywords else F.lit(True)
    return s.select("scene_id", "n_segments", X.token_estimate("_t", 4.0, 1).alias("tokens"), passed.alias("passed"))


def segment_bucket(n: Column, cap: int = 6) -> Column:
    return F.least(n, F.lit(cap)).cast("int")


def crosstab(p: DataFrame) -> DataFrame:
    """(bucket, n_pass, n_fail, n_all) by number of segments."""
    return p.groupBy(segment_bucket(F.col("n_segments")).alias("bucket")).agg(F.count_if("passed").alias("n_pass"), F.count_if(~F.col("passed")).alias("n_fail"), F.count("*").alias("n_all"))


def pass_counts(p: DataFrame) -> DataFrame:
    """One row: scenes that pass and fail the keywords, and their percentages as text."""
    s = p.agg(F.count_if("passed").alias("n_pass"), F.count_if(~F.col("passed")).alias("n_fail"))
    n = F.col("n_pass") + F.col("n_fail")
    return s.select("n_pass", "n_fail", X.percent("n_pass", n).alias("pass_share"), X.percent("n_fail", n).alias("fail_share"))


def ranked_values(df: DataFrame, value: str, picks: dict[str, Column], by: list[str] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """Per group, values at given places (from 0; a Column of ``n``) of the sorted values; ``more``: aggregates of each value ``_v`` and its count ``_c``.

    Works on counts of distinct values, so a group of any size is a few rows: no group is sorted or collected.
    """
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = counts.withColumns({"_to": F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_c").over(w)})
    at = {k: F.min(F.when(F.col("_to") > place, F.col("_v"))).alias(k) for k, place in picks.items()}
    return upto.groupBy(*by).agg(*at.values(), *more)


def _percentile(p: float) -> Column:
    return F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))


def coverage(p: DataFrame) -> DataFrame:
    """Per segment bucket of passing scenes: counts, median and p90 tokens, and running shares of scenes and tokens."""
    q = p.where("passed").withColumn("bucket", segment_bucket(F.col("n_segments")))
    sums = (F.sum("_c").alias("scenes"), F.sum(F.col("_v") * F.col("_c")).alias("tokens"))
    both = ranked_values(q, "tokens", {"_lo": F.floor((F.col("n") - 1) / F.lit(2.0)), "_hi": F.floor(F.col("n") / F.lit(2.0)), "p90_tokens": _percentile(0.9)}, ["bucket"], sums)
    w = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # six rows at most
    whole = Window.partitionBy(F.lit(0))
    return both.select(
        "bucket", "scenes", "tokens", F.floor((F.col("_lo") + F.col("_hi")) / F.lit(2.0)).alias("median_tokens"), "p90_tokens",
        (F.sum("scenes").over(w) / F.sum("scenes").over(whole)).alias("cum_scenes"), (F.sum("tokens").over(w) / F.sum("tokens").over(whole)).alias("cum_tokens"),
    )


def token_histogram(p: DataFrame, edges: tuple[int, ...] = TOKEN_EDGES) -> DataFrame:
    """(bin, single, multi): passing scenes of one and of more segments, by half-open token bins."""
    q = p.where("passed").withColumn("bin", bin_of(F.col("tokens"), edges))
    return q.groupBy("bin").agg(F.count_if(F.col("n_segments") == 1).alias("single"), F.count_if(F.col("n_segments") > 1).alias("multi"))


def bin_of(v: Column, edges: tuple[int, ...]) -> Column:
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        cond = (v >= lo) & (v < hi)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def projected_cost(p: DataFrame, seconds: DataFrame) -> DataFrame:
    """(bucket, scenes, cum_scenes, cum_seconds): counts times mean seconds of each bucket, running."""
    n = p.where("passed").groupBy(segment_bucket(F.col("n_segments")).alias("bucket")).agg(F.count("*").alias("scenes")).join(seconds, "bucket")
    w = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # six rows at most
    return n.select("bucket", "scenes", F.sum("scenes").over(w).alias("cum_scenes"), F.sum(F.col("scenes") * F.col("seconds")).over(w).alias("cum_seconds"))


def medians(df: DataFrame, value: str, name: str, whole: bool = False) -> DataFrame:
    """One row: the exact median of a column, as ``name``; ``whole``: without its fraction."""
    both = ranked_values(df, value, {"_lo": F.floor((F.col("n") - 1) / F.lit(2.0)), "_hi": F.floor(F.col("n") / F.lit(2.0))})
    m = (F.col("_lo") + F.col("_hi")) / F.lit(2.0)
    return both.select((F.floor(m) if whole else m).alias(name))


def analysis_medians(scored: DataFrame) -> DataFrame:
    """One row that belongs to analysis_summary(): the medians of tokens and score (of five digits, so few values)."""
    return medians(scored, "token_est", "token_median", whole=True).crossJoin(medians(scored, "score", "score_median"))


def corpus_medians(df: DataFrame, cfg: Curation = Curation(), text: str = "text") -> DataFrame:
    """One row that belongs to corpus_stats(): the median of tokens."""
    return medians(df.select(X.token_estimate(text, cfg.chars_per_token).alias("tok")), "tok", "token_median", whole=True)


def analysis_summary(scored: DataFrame, cfg: Curation = Curation()) -> DataFrame:
    """One row of an analysis: counts, averages and medians of tokens and score, and keyword hits."""
    sums = scored.agg(F.count("*").alias("n"), F.avg("token_est").alias("token_mean"), F.max("token_est").alias("token_max"), F.avg("score").alias("score_mean"), F.max("score").alias("score_max"), F.avg("keyword_hits").alias("keyword_mean"), F.max("keyword_hits").alias("keyword_max"), F.count_if(F.col("token_est") > cfg.max_tokens).alias("over_max"))
    return sums.crossJoin(F.broadcast(analysis_medians(scored)))  # one row each


def corpus_stats(df: DataFrame, keywords: list[str], cfg: Curation = Curation(), text: str = "text") -> DataFrame:
    """One row over chunks with ``split``: sizes, tokens, duplicate, zero-keyword and over-length counts, and flags."""
    q = df.select("split", X.token_estimate(text, cfg.chars_per_token).alias("tok"), K.hits(text, K.pattern(keywords)).alias("hits"), F.md5(F.col(text).cast("binary")).alias("h"))
    # copies first: a distinct count of hashes then counts one row a group
    groups = q.groupBy("h").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "val").alias("val"), F.sum("tok").alias("tok"), F.min("tok").alias("lo"), F.max("tok").alias("hi"), F.count_if(F.col("tok") > cfg.max_tokens).alias("over"), F.count_if(F.col("hits") == 0).alias("zero"), F.sum("hits").alias("hits"))
    s = groups.agg(F.sum("n").alias("n"), F.sum("val").alias("n_val"), F.floor(F.sum("tok") / F.sum("n")).alias("token_mean"), F.min("lo").alias("token_min"), F.max("hi").alias("token_max"), F.sum("over").alias("n_over"), (F.sum("n") - F.count("*")).alias("n_duplicate"), F.sum("zero").alias("n_zero_keyword"), (F.sum("hits") / F.sum("n")).alias("mean_hits"))
    n = F.col("n")
    flags = [(n < 50, "few"), (F.col("n_over") / n > 0.05, "over_max"), (F.col("n_duplicate") / n > 0.02, "duplicates"), (F.col("n_zero_keyword") / n > 0.20, "zero_keyword"), (F.col("n_val") == 0, "no_val")]
    s = s.crossJoin(F.broadcast(medians(q, "tok", "token_median", whole=True)))  # one row each
    return s.where("n > 0").withColumn("flags", F.concat_ws(",", *(F.when(c, F.lit(v)) for c, v in flags)))


def type_token_ratio(df: DataFrame, text: str = "text") -> DataFrame:
    """(distinct_words, total_words, ttr): words are counted before they are told apart, so common ones cost one row a task."""
    counts = df.select(F.explode(X.words(text)).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    s = counts.agg(F.count("*").alias("distinct_words"), F.coalesce(F.sum("c"), F.lit(0)).alias("total_words"))
    return s.withColumn("ttr", F.when(F.col("total_words") == 0, F.lit(0.0)).otherwise(F.col("distinct_words") / F.col("total_words")))


def length_histogram(df: DataFrame, cfg: Curation = Curation(), text: str = "text") -> DataFrame:
    """(bin, n): chunks by half-open bins at the configured token marks."""
    edges = (0, cfg.min_tokens, cfg.target_tokens // 2, cfg.target_tokens, cfg.max_tokens, 2 * cfg.max_tokens, 10**9)
    return df.groupBy(bin_of(X.token_estimate(text, cfg.chars_per_token), edges).alias("bin")).agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, length: str = "length") -> DataFrame:
    """One row: examples, total, min, max, mean, median, p95 and p99 of a length column; none of an empty table."""
    v, c = F.col("_v"), F.col("_c")
    sums = (F.sum(c).alias("examples"), F.sum(v * c).alias("tokens_total"), F.min(v).alias("tokens_min"), F.max(v).alias("tokens_max"))
    places = {"_lo": F.floor((F.col("n") - 1) / F.lit(2.0)), "_hi": F.floor(F.col("n") / F.lit(2.0)), "tokens_p95": _percentile(0.95), "tokens_p99": _percentile(0.99)}
    both = ranked_values(df, length, places, more=sums).where("examples > 0")
    return both.select("examples", "tokens_total", "tokens_min", "tokens_max", X.rounded(F.col("tokens_total") / F.col("examples"), 1).alias("tokens_mean"), F.floor((F.col("_lo") + F.col("_hi")) / F.lit(2.0)).alias("tokens_median"), "tokens_p95", "tokens_p99")
