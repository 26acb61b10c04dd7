"""Session settings and the two things every multi-step job needs: a safe place to cut
lineage, and a size check before a side is broadcast."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Largest number of narrow rows (ids, scores, query terms) we hint as broadcast.
BROADCAST_ROWS = 200_000
#: The same for rows that carry a vector.
BROADCAST_VECTORS = 10_000

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session it gives you."""
    builder = SparkSession.builder.master(master).appName("folioscope")
    settings = {
        **RECOMMENDED_CONF,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none (a laptop, the tests) do we pick one ourselves.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="folioscope-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast-hint ``df`` if it is measured to be small, else leave it to AQE.

    ``rows`` is a bound the caller has already proven; without it the rows are counted.
    """
    if rows is None:
        rows = df.limit(most + 1).count()
    return F.broadcast(df) if rows <= most else df


#: Ids of one word of :func:`among`.
_WORD = 64


def among(df: DataFrame, ids: DataFrame, rows: int, stays: bool = True, key: str = "chunk_id") -> DataFrame:
    """Rows of ``df`` whose ``key`` (a long) is among the at most ``rows`` ``ids``, or those whose key is not.

    Many ids go to the tasks as bits: ids given one after another take a word for 64 of them, so ``df`` is not
    shuffled. Only where the words are too many as well (ids far apart) it is left to a join.
    """
    how = "left_semi" if stays else "left_anti"
    ids = ids.select(F.col(key).cast("long").alias(key))
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(ids), key, how)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(_WORD - 1).cast("int"))
    words = stored(ids.filter(F.col(key).isNotNull()).groupBy(F.shiftright(key, 6).alias("__word")).agg(F.bit_or(bit).alias("__bits")))
    if words.count() > BROADCAST_ROWS:
        return df.join(ids, key, how)
    held = F.coalesce(F.getbit("__bits", F.col(key).bitwiseAND(_WORD - 1).cast("int")) == 1, F.lit(False))
    met = df.join(F.broadcast(words), F.shiftright(df[key], 6) == F.col("__word"), "left")
    return met.filter(held if stays else ~held).select(*df.columns)


def settled(df: DataFrame) -> DataFrame:
    """``df`` for several readers that must see the same rows: itself if each row comes straight from a row of a file, else :func:`stored`."""
    def plain(plan) -> bool:
        if plan.nodeName() not in ("Project", "Filter", "Union", "LocalRelation") and not plan.nodeName().startswith(("LogicalRelation", "Relation")):
            return False
        children = plan.children()
        return all(plain(children.apply(i)) for i in range(children.size()))

    plan = df._jdf.queryExecution().optimizedPlan()
    return df if plan.deterministic() and plain(plan) else stored(df)


#: Inputs below this size are spread over the cores even if they lie in one row group.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a small input so that one row group does not keep one core busy.

    Large inputs have many row groups and stay where they are; nothing is shuffled then.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def local(spark: SparkSession, schema: StructType, rows: list[tuple]) -> DataFrame:
    """A few rows from the driver as a relation that takes no job to read."""
    columns = list(zip(*rows)) or [()] * len(schema)
    arrow = to_arrow_schema(schema)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder, for several readers.

    The table survives lost executors, and its readers prune columns and rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioscope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
