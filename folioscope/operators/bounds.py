"""Best BM25 matches without scoring every posting.

The index keeps, for each word and library, blocks of neighbouring chunk ids with the highest term frequency
and the shortest length in them: together they bound what the word can add to the score of any chunk of the
block. A batch is then answered in two steps:

1. The words of a query that can add most (a share ``LEAD`` of all it can reach) are scored everywhere. The
   best ``top`` of these chunks are scored in full: the least of their scores is a threshold.
2. The other, mostly frequent words are looked up only for chunks that can still reach the threshold by the
   bounds of their block, for chunks that may hold all words, and in blocks where these words alone may reach it.

What is left out cannot be among the best ``top`` of either list, so the ranks equal those of a full pass.
Bounds stay valid when chunks go; blocks of several deltas are merged by their extremes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side, stored
from . import lexical

#: Chunk ids of one block.
BLOCK = 128
#: Share of the reachable score that is left to the first step.
LEAD = 0.92
#: Scores are compared with so much room, as ranks round them.
ROOM = 1e-8


def block_of(chunk_id: Column) -> Column:
    return F.floor(chunk_id / BLOCK)


def merged(blocks: DataFrame, *by: str) -> DataFrame:
    return blocks.groupBy(*by, "term", "lib_id", "block").agg(
        F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))


def rows_of(postings: DataFrame) -> DataFrame:
    """The rows that :func:`merged` combines to blocks, one for each posting."""
    rows = postings.filter(F.col("term") != lexical.DOC_MARK)
    return rows.select(
        "term", "lib_id", block_of(F.col("chunk_id")).alias("block"), F.lit(1).alias("n"), F.col("tf").alias("max_tf"), F.col("dl").alias("min_dl"))


def of_postings(postings: DataFrame) -> DataFrame:
    """term, lib_id, block, n, max_tf, min_dl. Postings lie sorted, so blocks are combined before they move."""
    return merged(rows_of(postings))


@dataclass(frozen=True)
class Steps:
    """What each step reads, for the scores and for whoever counts.

    ``first`` and ``second``: weights of the words of each step. ``open``: qid, block, chunk_id that the second
    step looks up; a null chunk means the whole block. ``begun``: scores of the first step that may go on.
    """

    first: DataFrame
    second: DataFrame
    open: DataFrame
    begun: DataFrame
    n_units: int
    n_open: int

    def looked_up(self, postings: DataFrame) -> DataFrame:
        """Postings of the second step, with their weights."""
        return _looked_up(postings, small_side(self.second, self.n_units), small_side(self.open, self.n_open))


def _looked_up(postings: DataFrame, weights: DataFrame, wanted: DataFrame) -> DataFrame:
    found = postings.withColumnRenamed("term", "unit").join(weights, ["unit", "lib_id"]).withColumn("block", block_of(F.col("chunk_id")))
    p, o = found.alias("p"), wanted.alias("o")
    same = (F.col("p.qid") == F.col("o.qid")) & (F.col("p.block") == F.col("o.block"))
    return p.join(o, same & (F.col("o.chunk_id").isNull() | (F.col("o.chunk_id") == F.col("p.chunk_id"))), "left_semi")


def steps(postings: DataFrame, blocks: DataFrame, weights: DataFrame, top: int, n_units: int) -> Steps:
    """``weights``: qid, lib_id, unit, weight, n_units, idf, avg_dl of words (no phrases), ``n_units`` rows at most."""
    weights = stored(weights)
    most = lexical.added_score(F.col("max_tf"), F.col("min_dl"))
    reach = stored(blocks.withColumnRenamed("term", "unit").join(small_side(weights, n_units), ["unit", "lib_id"]).select(
        "qid", "lib_id", "unit", "block", most.alias("most")))
    by_unit = reach.groupBy("qid", "lib_id", "unit").agg(F.max("most").alias("most"))
    query = Window.partitionBy("qid", "lib_id")
    before = F.sum("most").over(query.orderBy(F.col("most").desc(), "unit").rowsBetween(Window.unboundedPreceding, -1))
    leads = F.coalesce(before, F.lit(0.0)) < LEAD * F.sum("most").over(query)
    units = stored(weights.join(by_unit.select("qid", "lib_id", "unit", leads.alias("leads")), ["qid", "lib_id", "unit"]))
    split = {flag: units.filter(F.col("leads") == flag).drop("leads") for flag in (True, False)}
    n_leads = split[True].groupBy("qid", "lib_id").agg(F.count("*").alias("n_leads"))

    words = postings.withColumnRenamed("term", "unit")
    begun = lexical.summed(words, small_side(split[True], n_units)).withColumn("block", block_of(F.col("chunk_id")))
    begun = stored(begun)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "chunk_id"))
    best = stored(begun.withColumn("place", place).filter(F.col("place") <= top).select("qid", "block", "chunk_id", "score"))
    added = _looked_up(postings, small_side(split[False], n_units), small_side(best, n_units * top)).select(
        "qid", "chunk_id", lexical.added_score(F.col("tf"), F.col("dl")).alias("score"))
    whole = best.select("qid", "chunk_id", "score").unionByName(added).groupBy("qid", "chunk_id").agg(F.sum("score").alias("score"))
    bar = whole.groupBy("qid").agg(F.min("score").alias("bar"), F.count("*").alias("n")).filter(F.col("n") >= top).select("qid", "bar")
    rest = reach.join(small_side(split[False].select("qid", "lib_id", "unit"), n_units), ["qid", "lib_id", "unit"]).groupBy(
        "qid", "lib_id", "block").agg(F.sum("most").alias("rest"), F.count("*").alias("n_rest"))
    bar = stored(bar)
    rest = stored(rest.join(small_side(bar, n_units), "qid", "left"))
    # a query without a bar has fewer than ``top`` matches of its leading words: all may go on
    blocks_open = rest.filter(F.col("bar").isNull() | (F.col("rest") >= F.col("bar") - ROOM)).select("qid", "block", F.lit(None).cast("long").alias("chunk_id"))
    able = begun.join(small_side(bar, n_units), "qid", "left").join(small_side(n_leads, n_units), ["qid", "lib_id"]).join(
        rest.select("qid", "lib_id", "block", "rest", "n_rest"), ["qid", "lib_id", "block"], "left")
    reached = F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("bar") - ROOM
    may_hold_all = (F.col("hit_units") == F.col("n_leads")) & (F.col("n_leads") + F.coalesce("n_rest", F.lit(0)) == F.col("n_units"))
    able = stored(able.filter(F.col("bar").isNull() | reached | may_hold_all))
    wanted = stored(blocks_open.unionByName(able.filter("rest IS NOT NULL").select("qid", "block", "chunk_id")))
    return Steps(split[True], split[False], wanted, able.select(*begun.columns), n_units, wanted.count())


def best_scores(postings: DataFrame, blocks: DataFrame, weights: DataFrame, top: int, n_units: int) -> DataFrame:
    """qid, lib_id, chunk_id, score, all_terms: right and complete for all that may rank among the best ``top``."""
    plan = steps(postings, blocks, weights, top, n_units)
    more = plan.looked_up(postings).groupBy("qid", "lib_id", "chunk_id").agg(*lexical.sums())
    columns = ["qid", "lib_id", "chunk_id", "score", "hit_units", "n_units"]
    both = plan.begun.select(*columns).unionByName(more.select(*columns))
    return both.groupBy("qid", "lib_id", "chunk_id").agg(
        F.sum("score").alias("score"), F.sum("hit_units").alias("hit_units"), F.first("n_units").alias("n_units")
    ).select("qid", "lib_id", "chunk_id", "score", lexical.holds_all().alias("all_terms"))
