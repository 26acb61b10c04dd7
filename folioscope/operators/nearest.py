"""Vector neighbours within a library, and the relative similarity threshold."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_VECTORS

TOP = 20
KEEP_RATIO = 0.5
#: Queries whose distances to a batch of vectors are held at once.
AT_ONCE = 256


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a row without direction becomes not-a-number and is nobody's neighbour."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_library(rows: pa.Table | pa.RecordBatch, vectors: str):
    """``(library, dimension)`` with the numbers of its rows."""
    libs, code = np.unique(np.array(rows.column("lib_id").to_pylist()), return_inverse=True)
    dims = np.array(pc.list_value_length(rows.column(vectors)).to_pylist())
    for lib, own in zip(libs, np.split(np.argsort(code, kind="stable"), np.cumsum(np.bincount(code))[:-1])):
        for dim in np.unique(dims[own]):
            if dim:
                yield (str(lib), int(dim)), own[dims[own] == dim]


def _distances(asked: np.ndarray, given: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return 1.0 - asked @ given.T
    return np.stack([np.sqrt(((given - q) ** 2).sum(axis=1)) for q in asked])


def _search(block, metric: str, top: int):
    def run(batches):
        table = block.value
        shape = _unit if metric == "cosine" else (lambda rows: rows)
        asked = {key: (own, shape(_matrix(table.column("query_vec").combine_chunks().take(pa.array(own)), key[1])))
                 for key, own in _by_library(table, "query_vec")}
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("chunk_id").type
            ids = np.array(batch.column("chunk_id").to_pylist())
            for key, own in _by_library(batch, "embedding"):
                if key not in asked:
                    continue
                numbers, matrix = asked[key]
                given, names = shape(_matrix(batch.column("embedding").take(pa.array(own)), key[1])), ids[own]
                for start in range(0, len(numbers), AT_ONCE):
                    found = _distances(matrix[start : start + AT_ONCE], given, metric)
                    # nothing beyond the last place so far is sorted
                    for number, row in zip(numbers[start : start + AT_ONCE], found):
                        old, old_names = best.get(number, (row[:0], names[:0]))
                        near = np.flatnonzero(np.round(row, 9) <= (np.round(old[-1], 9) if len(old) == top else np.inf))
                        near = near[np.isfinite(row[near])]
                        if not len(near):
                            continue
                        if len(near) > top:
                            rounded = np.round(row[near], 9)
                            near = near[rounded <= np.partition(rounded, top - 1)[top - 1]]
                        d, n = np.concatenate([old, row[near]]), np.concatenate([old_names, names[near]])
                        order = np.lexsort((n, np.round(d, 9)))[:top]
                        best[number] = d[order], n[order]
        if best:
            counts = [len(d) for d, _ in best.values()]
            qids = table.column("qid").combine_chunks().take(pa.array(np.repeat(list(best), counts)))
            yield pa.record_batch({
                "qid": qids, "chunk_id": pa.array(np.concatenate([n for _, n in best.values()]).tolist(), id_type),
                "distance": pa.array(np.concatenate([d for d, _ in best.values()]))})

    return run


def nearest(
    queries: DataFrame, vectors: DataFrame, metric: str = "cosine", top: int = TOP, n_queries: int | None = None
) -> DataFrame:
    """qid, chunk_id, distance, vec_rank: the ``top`` closest chunks of each query's library.

    Queries are a stated set: blocks of about ``BROADCAST_VECTORS`` of them go to the tasks that stream
    over the vectors, each task keeps ``top`` rows per query, and only those are shuffled, by query.
    Vectors are not moved, however large their library. Vectors that are null, of another length,
    without direction (cosine) or not finite are nobody's neighbours. Ties go to the smaller chunk.
    """
    closest = W.partitionBy("qid").orderBy(F.round("distance", 9), "chunk_id")
    ranked = candidates(queries, vectors, metric, top, n_queries).withColumn("vec_rank", F.row_number().over(closest))
    return ranked.where(F.col("vec_rank") <= top)


def candidates(queries: DataFrame, vectors: DataFrame, metric: str, top: int, n_queries: int | None = None) -> DataFrame:
    """qid, chunk_id, distance: the best ``top`` of each query in each task, which hold the best of all."""
    asked = queries.where("query_vec IS NOT NULL AND lib_id IS NOT NULL").select("qid", "lib_id", "query_vec")
    n = asked.count() if n_queries is None else n_queries
    blocks = max(1, -(-n // BROADCAST_VECTORS))
    schema = T.StructType([
        T.StructField("qid", queries.schema["qid"].dataType), T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
        T.StructField("distance", T.DoubleType())])
    spark, found = queries.sparkSession, []
    given = vectors.where("embedding IS NOT NULL AND lib_id IS NOT NULL AND chunk_id IS NOT NULL").select("lib_id", "chunk_id", "embedding")
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        found.append(given.mapInArrow(_search(spark.sparkContext.broadcast(part.toArrow()), metric, top), schema))
    return reduce(DataFrame.unionByName, found)


def flag_weak(hits: DataFrame, metric: str = "cosine", ratio: float = KEEP_RATIO) -> DataFrame:
    """Add ``weak``: similarity below half of the query's best one.

    With ``l2`` a best similarity below zero marks every hit, as the plain rule has it; with
    ``cosine`` the rule applies only to a positive best.
    """
    sim = 1.0 - F.col("distance")
    top = F.max(sim).over(W.partitionBy("qid"))
    weak = sim < ratio * top
    return hits.withColumn("weak", weak if metric == "l2" else weak & (top > 0))
