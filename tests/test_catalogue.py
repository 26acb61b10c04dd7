"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = entry.SMOKE_DIR
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["hybrid_search", "store_upsert_search", "knn_cosine", "chunk_pack", "simhash64", "near_dup_greedy", "norm_url", "link_extract", "candidate_merge", "versions_argmax", "latency_summary", "upsert_merge", "refresh_due"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FOLIOSCOPE_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((plain(r) for r in df.select(*columns).collect()), key=repr)
    listed = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted((plain(r) for r in duck.execute(f"SELECT {listed} FROM ({entry.oracle_sql()[name]})").fetchall()), key=repr)
    assert mine == theirs and mine


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
