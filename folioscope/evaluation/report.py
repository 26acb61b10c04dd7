"""Evaluation results as files: a Markdown table the gate can read, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def docs_table(scored: DataFrame) -> DataFrame:
    """``value``: one table line per query (n, library, fragments, hit_rank, n_chunks, ms, tokens)."""
    outcome = F.when(F.size("fragments") == 0, "n/a").when(F.col("hit_rank").isNull(), "miss").otherwise(
        F.concat(F.lit("@"), F.col("hit_rank").cast("string")))
    cells = [F.col("n"), F.col("library"), outcome, F.col("n_chunks"), F.round("ms").cast("long"), F.col("tokens")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))
    return scored.orderBy("n").select(line.alias("value"))


def write_report(scored: DataFrame, path: str) -> None:
    docs_table(scored).write.mode("overwrite").text(path)


def write_metrics(rates: DataFrame, path: str) -> None:
    rates.write.mode("overwrite").json(path)
