"""The driver's parquet tables in the roles of the store's relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import among, stored

N_LIBS = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lib_of(id_column: Column) -> Column:
    """Library a query or vector belongs to; the same rule as the documents' ``source``."""
    return F.concat(F.lit("src"), (id_column % N_LIBS).cast("string"))


def page_path(doc_id: Column) -> Column:
    """Two chunks per page, in the spellings the canonical path unites."""
    block = F.floor(doc_id / (2 * N_LIBS))
    number = (block * N_LIBS + doc_id % N_LIBS).cast("string")
    first = F.floor(doc_id / N_LIBS) % 2 == 0
    return F.when(first, F.concat(F.lit("/en/guide/p"), number, F.lit(".html"))).otherwise(
        F.concat(F.lit("/guide/p"), number, F.lit("/"))
    )


def chunks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``more``: further columns of the documents."""
    doc = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        doc.alias("chunk_id"),
        F.col("source").alias("lib_id"),
        F.when(doc % 3 == 0, "").when(doc % 3 == 1, "3.1.0").otherwise("2.3.0").alias("ver"),
        page_path(doc).alias("path"),
        tx.page_title(F.col("text")).alias("title"),
        "text",
        *more,
    )


def chunks_of_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with ``lang``, a row for each language of their id; those whose id has no other row take their own."""
    numbers = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    again = stored(numbers.groupBy("chunk_id").count().filter("count > 1").select("chunk_id"))
    n = again.count()
    own = chunks(spark, sf_dir, "lang").filter("chunk_id IS NOT NULL")
    if not n:
        return own
    met = among(chunks(spark, sf_dir), again, n).join(among(numbers, again, n), "chunk_id")
    return among(own, again, n, stays=False).unionByName(met)


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of existing chunks only; most chunks have none."""
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("lib_id"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vectors.join(ids, "chunk_id")


def queries(spark: SparkSession, sf_dir: str, version: str = "") -> DataFrame:
    """One query per benchmark passage, whole text, with the vector of the same number."""
    asked = read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), lib_of(F.col("item_id")).alias("lib_id"), F.col("text").alias("query")
    )
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vec"))
    return asked.join(vectors, "qid", "left").withColumn("version", F.lit(version))
