import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators.ordering import running


@pytest.mark.parametrize("group_rows", [10**6, 5])
def test_running_sums_in_large_groups(spark, group_rows):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), i, rng.randint(0, 9)) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r["g"], r["o"]): r["running"] for r in running(df, ["g"], [F.col("o").desc()], F.col("v"), group_rows=group_rows).collect()}
    want, sums = {}, {}
    for g, o, v in sorted(rows, key=lambda r: -r[1]):
        sums[g] = sums.get(g, 0) + v
        want[g, o] = sums[g]
    assert got == want


def test_a_group_of_few_wide_rows_is_numbered_in_pieces(spark):
    rows = [("g", i, "x" * 2000) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, t string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running(df, ["g"], [F.col("o").asc()], out="n", group_bytes=50_000)
        assert sorted((r["o"], r["n"]) for r in out.select("o", "n").collect()) == [(i, i + 1) for i in range(400)]
        # several tasks hold the rows of the one group
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
