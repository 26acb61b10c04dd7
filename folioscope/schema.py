"""Relations of the store and the version of their layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, D, I, B, TS = (
    T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LIBS = _struct(
    id=S, name=S, repo=S, docs_url=S, trust=D, latest_ver=S, versions=T.ArrayType(S),
    full=B, etag=S, last_check=TS, recrawl_at=TS, cap=I, stable=I,
)
CHUNKS = _struct(
    chunk_id=L, lib_id=S, ver=S, path=S, title=S, text=S, fetched_at=TS, simhash=L,
)
CHUNK_VEC = _struct(chunk_id=L, lib_id=S, embedding=T.ArrayType(T.FloatType()))
CRAWL_STATE = _struct(lib_id=S, docs_url=S, url=S, status=S, seq=L, updated_at=TS)
POSTINGS = _struct(term=S, lib_id=S, chunk_id=L, tf=L, positions=T.ArrayType(I), dl=L)
TERMS = _struct(term=S, df=L)
BLOCKS = _struct(term=S, lib_id=S, block=L, n=L, max_tf=L, min_dl=L)
CORPUS_STATS = _struct(n_docs=D, avg_dl=D)
ACTIVITY = _struct(
    t=D, tool=S, name=S, lib=S, q=S, ver=S, ms=L, n_chunks=L, top=S, reason=S, event=S, kind=S, detail=S,
)
GOLDEN = _struct(
    library_name=S, query=S, expected_path_fragments=T.ArrayType(S), source=S, verified=B,
)
QUERIES = _struct(qid=L, lib_id=S, query=S, query_vec=T.ArrayType(T.FloatType()), version=S)

TABLES: dict[str, T.StructType] = {
    "libs": LIBS, "chunks": CHUNKS, "chunk_vec": CHUNK_VEC, "crawl_state": CRAWL_STATE,
    "postings": POSTINGS, "terms": TERMS, "blocks": BLOCKS, "corpus_stats": CORPUS_STATS,
}
#: Large tables are laid out in directories by a hash of this column, so that a query opens few of them.
BUCKET_KEY = {"chunks": "lib_id", "chunk_vec": "lib_id", "postings": "term", "terms": "term", "blocks": "term"}

#: Columns added after the first layout, with the value older rows get.
LATER_COLUMNS: dict[str, dict[str, Column | object]] = {
    "libs": {"full": True, "etag": "", "last_check": None, "recrawl_at": None, "cap": 0, "stable": 0},
    "chunks": {"simhash": None},
}
SCHEMA_VERSION = 2


def conform(df: DataFrame, table: str) -> DataFrame:
    """Bring rows of an older layout to the current one: add missing columns, order, cast."""
    defaults = LATER_COLUMNS.get(table, {})
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
        for f in TABLES[table].fields
    ])
