import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # tiny fixtures: compiling code for every stage would cost more than running it
    session = build_session("local[8]", 2, **{"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a function from columns to one column to rows of Python values."""
    def run(fn, rows, schema):
        names = [part.strip().split(" ")[0] for part in schema.split(",")]
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "__i int, " + schema)
        out = df.select("__i", fn(*[F.col(n) for n in names]).alias("out")).orderBy("__i").collect()
        return [r["out"] for r in out]
    return run
