"""Row numbers and running sums in groups of any size.

A plain window puts a whole group into one task. Where the largest group is measured to be too
big for that, by its rows or their bytes, rows are range-partitioned by group and order, numbered inside their piece, and
moved on by the sums of the pieces before: the same numbers, spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Largest group a single task may order.
GROUP_ROWS = 1_000_000
#: The same in bytes of its texts.
GROUP_BYTES = 64 << 20


def running(
    df: DataFrame, by: list[str], order: list[Column], value: Column | None = None,
    out: str = "running", group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` (default 1, so a row number) up to and with each row.

    ``order`` must place the rows of a group without ties.
    """
    amount = F.lit(1) if value is None else value
    df = cut(df.withColumn("__v", amount.cast("long")))
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    sizes = df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(sum(texts, F.lit(0)).cast("long")).alias("bytes"))
    rows, size = sizes.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    if rows <= group_rows and size <= group_bytes:
        total = F.sum("__v").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        return df.withColumn(out, total).drop("__v")
    pieces = cut(df.repartitionByRange(*by, *order).withColumn("__piece", F.spark_partition_id()))
    within = W.partitionBy("__piece", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = pieces.groupBy("__piece", *by).agg(F.sum("__v").alias("__s"))
    ahead = W.partitionBy(*by).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("__ahead", F.coalesce(F.sum("__s").over(ahead), F.lit(0))).drop("__s")
    placed = pieces.withColumn(out, F.sum("__v").over(within)).join(offsets, ["__piece", *by])
    return placed.withColumn(out, F.col(out) + F.col("__ahead")).drop("__v", "__piece", "__ahead")
