"""Rank fusion of the lexical and the vector list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FUSION_K = 60


def ranked_list(lexical: DataFrame | None, vector: DataFrame | None) -> DataFrame:
    """qid, chunk_id, branch, rank, weak: full matches, other lexical matches, vector hits.

    A chunk stands once in the lexical part; a vector hit repeats it.
    """
    parts = []
    if lexical is not None:
        full = F.col("and_rank").isNotNull()
        parts.append(lexical.select(
            "qid", "chunk_id", F.when(full, 0).otherwise(1).alias("branch"),
            F.when(full, F.col("and_rank")).otherwise(F.col("or_rank")).alias("rank"),
            F.lit(False).alias("weak")))
    if vector is not None:
        parts.append(vector.select("qid", "chunk_id", F.lit(2).alias("branch"), F.col("vec_rank").alias("rank"), "weak"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def list_positions(ranked: DataFrame) -> DataFrame:
    """Add ``pos`` in the joined list and ``before``: distinct chunks ahead of that position."""
    order = W.partitionBy("qid").orderBy("branch", "rank", "chunk_id")
    placed = ranked.withColumn("pos", F.row_number().over(order))
    fresh = F.row_number().over(W.partitionBy("qid", "chunk_id").orderBy("pos")) == 1
    return placed.withColumn("fresh", fresh.cast("int")).withColumn(
        "before",
        F.coalesce(
            F.sum("fresh").over(W.partitionBy("qid").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ),
    ).drop("fresh")


def fuse(placed: DataFrame, k: int | Column = FUSION_K, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Sum of 1 / (k + distinct chunks ahead) per chunk, without the weak ones."""
    denominator = (k if isinstance(k, Column) else F.lit(k)) + F.col("before")
    return (
        placed.groupBy(*by, "chunk_id")
        .agg(F.sum(1.0 / denominator).alias("score"), F.min("pos").alias("first_pos"), F.max("weak").alias("weak"))
        .filter("NOT weak")
        .drop("weak")
    )


def best(fused: DataFrame, limit: int | Column, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Add ``fused_rank``: score, then first position; keep those within ``limit``."""
    order = W.partitionBy(*by).orderBy(F.round("score", 12).desc(), "first_pos")
    return fused.withColumn("fused_rank", F.row_number().over(order)).filter(F.col("fused_rank") <= limit)
