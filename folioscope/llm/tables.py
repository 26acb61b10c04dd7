"""Steps that several operators share: written tables that go again, and global positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_IN_PART = (1 << 33) - 1


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    return stored(df)


def forget(df: DataFrame) -> None:
    """Remove a table that ``kept`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def positions(df: DataFrame, *order: Column, out: str = "pos") -> DataFrame:
    """Number all rows from 0 in the given order, which must leave no ties that matter.

    Rows are range-partitioned and sorted inside their partition; each partition then starts where
    the one before ends. No group or order is gathered in one task, however large.
    """
    placed = kept(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id())
    )
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row per partition of the sort: as many as there are tasks
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (
        placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
        .withColumn(out, F.col("__start") + F.col("__id").bitwiseAND(F.lit(_IN_PART)))
        .drop("__id", "__part", "__start")
    )


def groups(batches, names: list[str]):
    """Runs of rows equal in ``names``, as tables, from batches sorted by them."""
    waiting, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(keys[start])
            if waiting and key != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(start, end - start))
            last = key
    if waiting:
        yield pa.Table.from_batches(waiting)


class Forest:
    """Which rows of one group are already held together."""

    def __init__(self):
        self.above: dict = {}

    def root(self, x):
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def join(self, x, y) -> bool:
        """Whether the two were apart until now."""
        x, y = self.root(x), self.root(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column is called so, in upper or lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
