"""From ranked ids to result rows: version preference, one hit per page, budget, rerank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text as tx
from ..session import small_side

MAX_TOKENS = 3000


def attach_chunks(ranked: DataFrame, chunks: DataFrame, n_ranked: int | None = None) -> DataFrame:
    """Join the winning ids with their chunk rows; text is read only here."""
    columns = ["chunk_id", "path", "title", "text", "ver"]
    return chunks.select(*columns).join(small_side(ranked, n_ranked), "chunk_id")


def prefer_version(hits: DataFrame, version: str | Column | None) -> DataFrame:
    """Keep chunks of the asked or of no version, the asked ones first (``order_rank``)."""
    wanted = version if isinstance(version, Column) else F.lit(version or "")
    allowed = (wanted == "") | (F.col("ver") == wanted) | (F.col("ver") == "")
    other = F.when(wanted == "", F.lit(0)).otherwise((F.col("ver") != wanted).cast("int"))
    order = W.partitionBy("qid").orderBy(other, "fused_rank")
    return hits.filter(allowed).withColumn("order_rank", F.row_number().over(order))


def one_per_page(hits: DataFrame, k: int, order: str = "order_rank") -> DataFrame:
    """Best hit of each canonical page, then the first ``k``, numbered ``rank``."""
    page = W.partitionBy("qid", paths.norm_path(F.col("path"))).orderBy(order)
    first = hits.withColumn("__nth", F.row_number().over(page)).filter("__nth = 1").drop("__nth")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(order))).filter(F.col("rank") <= k)


def present(hits: DataFrame) -> DataFrame:
    """The public columns of a result row."""
    return hits.select(
        "qid", "rank", F.col("chunk_id").alias("id"), "path", "title", "text",
        tx.section_title(F.col("text")).alias("section_title"),
        tx.tokens_est(F.col("text")).alias("tokens"),
        F.round("score", 4).alias("score"),
    )


def trim_to_budget(hits: DataFrame, by: str = "qid", order: str = "rank", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Keep rows while the character budget lasts; the row that crosses it is cut."""
    budget = max_tokens * tx.CHARS_PER_TOKEN
    used = F.coalesce(
        F.sum(F.length("text")).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        hits.withColumn("__used", used)
        .filter(F.col("__used") < budget)
        .withColumn("text", F.substring(F.col("text"), F.lit(1), (F.lit(budget) - F.col("__used")).cast("int")))
        .drop("__used")
    )


def lexical_overlap(query: Column, text: Column) -> Column:
    """Default relevance score: share of the query's distinct tokens found in the text."""
    asked = F.array_distinct(tx.doc_tokens(query))
    found = F.size(F.array_intersect(asked, tx.doc_tokens(text)))
    return F.coalesce(F.try_divide(found.cast("double"), F.size(asked).cast("double")), F.lit(0.0))


Scorer = Callable[[Column, Column], Column]


def rerank(hits: DataFrame, scorer: Scorer = lexical_overlap, top_n: int = 20, chars: int | None = None) -> DataFrame:
    """Reorder the first ``top_n`` hits of each query by ``scorer(query, text)``.

    ``hits`` carry ``query``. Later hits keep their order and score; a lone hit is left as it is.
    Whole texts are scored; ``chars`` is the input window of a scorer that has one.
    """
    read = F.col("text") if chars is None else F.left(F.col("text"), F.lit(chars))
    lone = F.count("*").over(W.partitionBy("qid")) < 2
    head = (F.col("rank") <= top_n) & ~F.col("__lone")
    scored = hits.withColumn("__lone", lone).withColumn(
        "__new", F.when(head, scorer(F.col("query"), read))
    )
    order = W.partitionBy("qid").orderBy(
        F.col("__new").isNull(), F.round("__new", 9).desc(), "rank"
    )
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .withColumn("score", F.when(F.col("__new").isNull(), F.col("score")).otherwise(F.round("__new", 4)))
        .drop("__lone", "__new")
    )
