"""Retrieval quality and latency figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text as tx
from ..operators.ordering import running

DEPTH = 5


def any_fragment(path: Column, fragments: Column) -> Column:
    low = F.lower(path)
    return F.exists(fragments, lambda f: F.contains(low, F.lower(f)))


def first_hit(hits: DataFrame, golden: DataFrame, depth: int = DEPTH, ks: Sequence[int] | None = None) -> DataFrame:
    """Per golden query (qid, fragments) the rank of its first hit within ``depth``, null for a miss.

    Queries without fragments are not scored. With ``ks``, hits carry the setting ``k`` they were
    found with, and every query has a row for each setting, whether it was answered or not.
    """
    scored = golden.filter(F.size("fragments") > 0)
    by = ["qid"] if ks is None else ["k", "qid"]
    asked = scored.select("qid") if ks is None else scored.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "qid")
    near = hits.filter(F.col("rank") <= depth).join(scored.select("qid", "fragments"), "qid")
    ranks = near.filter(any_fragment(F.col("path"), F.col("fragments"))).groupBy(*by).agg(F.min("rank").alias("hit_rank"))
    return asked.join(ranks, by, "left")


def hit_rates(first: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative hit@1, hit@3, hit@5 and the number of scored queries."""
    def share(k: int) -> Column:
        return F.round(F.avg(F.coalesce(F.col("hit_rank") <= k, F.lit(False)).cast("double")), 3)

    return first.groupBy(*by).agg(
        F.count("*").alias("scored"), share(1).alias("hit_1"), share(3).alias("hit_3"), share(5).alias("hit_5"))


def best_k(first: DataFrame) -> DataFrame:
    """The setting with most queries hit at all, then most hit first, then the smallest; one row."""
    counts = first.groupBy("k").agg(
        F.count_if(F.col("hit_rank") <= DEPTH).alias("hit5"), F.count_if(F.col("hit_rank") <= 1).alias("hit1"), F.count("*").alias("n"))
    best = F.max_by(F.struct("k", "hit5", "hit1", "n"), F.struct("hit5", "hit1", -F.col("k")))
    return counts.agg(best.alias("b")).select(F.col("b.k").alias("best_k"), "b.hit5", "b.hit1", "b.n")


def resolve_hit(top_id: Column, name: Column) -> Column:
    """The candidate's id holds the asked name, both reduced to letters and digits."""
    return F.coalesce((top_id != "") & F.contains(paths.letters_only(top_id), paths.letters_only(name)), F.lit(False))


def keyword_hit(text: Column, query: Column) -> Column:
    """Some longer word of the query stands in the text."""
    low = F.lower(text)
    return F.exists(tx.keyword_terms(query), lambda t: F.contains(low, t))


def join_golden(activity: DataFrame, golden: DataFrame) -> DataFrame:
    """Activity rows with the first golden entry (smallest ``qid``) of the same library whose query
    starts the same. Both keys are normalised; golden entries are reduced to one per key first."""
    def keys(lib: Column, query: Column) -> list[Column]:
        return [paths.letters_only(lib).alias("__lib"), paths.letters_only(F.left(query, F.lit(24))).alias("__start")]

    one = golden.select(*keys(F.col("library_name"), F.col("query")), "qid", "fragments").groupBy("__lib", "__start").agg(
        F.min_by(F.struct("qid", "fragments"), "qid").alias("g"))
    asked = activity.select("*", *keys(F.col("lib"), F.col("q")))
    return asked.join(one, ["__lib", "__start"]).select(*activity.columns, "g.qid", "g.fragments")


def score_activity(activity: DataFrame, golden: DataFrame) -> DataFrame:
    """One row of totals from logged answers (lib, q, top): scored, hit at 1, hit at all, percentages."""
    scored = join_golden(activity, golden).filter(F.size("fragments") > 0)
    hit = F.transform("top", lambda p: F.exists("fragments", lambda f: F.contains(paths.letters_only(p), paths.letters_only(f))))
    at = F.array_position(hit, True)
    return scored.agg(
        F.count("*").alias("docs"), F.count_if(at == 1).alias("hit1"), F.count_if(at > 0).alias("hit5"),
    ).withColumn("pct_hit1", F.round(100 * F.col("hit1") / F.greatest("docs", F.lit(1)), 1)).withColumn(
        "pct_hit5", F.round(100 * F.col("hit5") / F.greatest("docs", F.lit(1)), 1))


def latency_summary(calls: DataFrame, by: str = "tool", ms: str = "ms") -> DataFrame:
    """Count, mean, exact median and total per tool.

    Equal latencies are counted first. The two middle values are then found from running counts
    over buckets of the value range, and only the middle buckets are looked at row by row; no
    tool's calls meet in one task, however many there are.
    """
    counts = calls.filter(F.col(ms).isNotNull()).groupBy(by, F.col(ms).cast("double").alias("v")).agg(F.count("*").alias("c"))
    totals = counts.groupBy(by).agg(
        F.sum("c").alias("n_calls"), F.sum(F.col("v") * F.col("c")).alias("total_ms"),
        F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 4096
    bucketed = counts.join(totals, by).withColumn(
        "b", F.when(width > 0, F.floor((F.col("v") - F.col("lo")) / width)).otherwise(0))
    sizes = bucketed.groupBy(by, "b", "n_calls").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(W.partitionBy(by).orderBy("b"))
    first, last = F.floor((F.col("n_calls") + 1) / 2), F.floor((F.col("n_calls") + 2) / 2)
    ends = sizes.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
    middle = ends.filter((F.col("before") < last) & (F.col("upto") >= first)).select(by, "b", "before")
    inner = running(bucketed.join(middle, [by, "b"]), [by, "b"], [F.col("v").asc()], F.col("c"), out="inner")
    placed = inner.withColumn("top", F.col("before") + F.col("inner")).withColumn("low", F.col("top") - F.col("c"))
    pair = placed.groupBy(by).agg(
        F.max(F.when((F.col("low") < first) & (F.col("top") >= first), F.col("v"))).alias("m1"),
        F.max(F.when((F.col("low") < last) & (F.col("top") >= last), F.col("v"))).alias("m2"))
    return totals.join(pair, by).select(
        by, "n_calls", (F.col("total_ms") / F.col("n_calls")).alias("mean_ms"),
        ((F.col("m1") + F.col("m2")) / 2).alias("median_ms"), "total_ms")


def gate(report: DataFrame, threshold: float = 40.0) -> DataFrame:
    """hits, total, pct, passed from report outcomes; ``n/a`` rows do not count."""
    scored = report.filter("outcome <> 'n/a'")
    return scored.agg(
        F.count_if(F.startswith("outcome", F.lit("@"))).alias("hits"), F.count("*").alias("total")
    ).withColumn("pct", 100.0 * F.try_divide("hits", "total")).withColumn(
        "passed", F.coalesce(F.col("pct") >= threshold, F.lit(False)))
