"""Writes of the store as set operations that yield the next table version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import cut
from . import neardup

METADATA = ("name", "repo", "docs_url", "trust", "latest_ver", "versions")


def _filled(value: Column) -> Column:
    """Null for what says nothing: empty text or an empty list."""
    kind = F.typeof(value)
    return F.when((kind == "string") & (value.cast("string") == ""), F.lit(None)).when(
        F.startswith(kind, F.lit("array")) & (value.cast("string") == "[]"), F.lit(None)
    ).otherwise(value)


def merge_libs(libs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert libraries or update their six metadata columns; state columns stay.

    An empty incoming value never overwrites a filled one. Both sides hold one row per id.
    """
    new = incoming.select("id", *[_filled(F.col(c)).alias(f"__{c}") for c in METADATA], F.lit(True).alias("__new"))
    joined = libs.join(new, "id", "full_outer")
    columns = []
    for name in libs.columns:
        if name in METADATA:
            columns.append(F.coalesce(F.col(f"__{name}"), F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns)


def drop_libs(table: DataFrame, ids: DataFrame, key: str = "lib_id") -> DataFrame:
    """One of the store's relations without the rows of the given libraries (``id``)."""
    return table.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def replace_pages(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored chunks minus every spelling of an incoming page, plus the incoming chunks."""
    gone = incoming.select("lib_id", F.explode_outer(paths.path_variants(F.col("path"))).alias("path")).distinct()
    columns = [c for c in existing.columns if c in incoming.columns]
    return existing.join(gone, ["lib_id", "path"], "left_anti").select(*columns).unionByName(incoming.select(*columns))


def add_chunks(existing: DataFrame, incoming: DataFrame, last_id: int | None = None) -> DataFrame:
    """The next ``chunks`` table: near-duplicates dropped, pages replaced, fresh ids given.

    ``incoming``: lib_id, ver, path, title, text, fetched_at and ``ord`` (unique arrival order).
    Rows about to be replaced do not count as stored copies of their own page. ``existing`` may be
    the incoming libraries' part of the store; ``last_id`` is then the highest id of the whole.
    """
    batch = cut(incoming.withColumn("chunk_id", F.col("ord").cast("long")))
    gone = batch.select("lib_id", F.explode_outer(paths.path_variants(F.col("path"))).alias("path")).distinct()
    standing = existing.join(gone, ["lib_id", "path"], "left_anti")
    fresh = neardup.survivors(batch, standing.select("lib_id", "simhash"))
    # ids are given to rows already on disk, so a recomputed task gives the same ones
    fresh = cut(fresh.repartitionByRange("lib_id", "ord").sortWithinPartitions("lib_id", "ord"))
    last = existing.agg(F.coalesce(F.max("chunk_id"), F.lit(-1))).scalar() if last_id is None else F.lit(last_id)
    numbered = fresh.withColumn("chunk_id", last + F.lit(1) + F.monotonically_increasing_id())
    return replace_pages(existing, numbered.select(*[c for c in existing.columns if c in numbered.columns]))


def prune_chunks(chunks: DataFrame, keep: DataFrame, libs: DataFrame) -> DataFrame:
    """Drop chunks of the finished ``libs`` (lib_id) whose page is not in ``keep`` (lib_id, path)."""
    page = paths.norm_path(F.col("path"))
    wanted = keep.select("lib_id", page.alias("__page")).distinct()
    done = libs.select("lib_id").distinct().withColumn("__done", F.lit(True))
    tagged = chunks.withColumn("__page", page).join(done, "lib_id", "left")
    stays = tagged.filter("__done").join(wanted, ["lib_id", "__page"], "left_semi")
    return tagged.filter("__done IS NULL").unionByName(stays.select(tagged.columns)).drop("__page", "__done")


def set_flags(libs: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite state columns of single libraries; null in ``changes`` means unchanged."""
    fields = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in fields])
    joined = libs.join(new, "id", "left")
    return joined.select(*[
        (F.coalesce(F.col(f"__{c}"), F.col(c)) if c in fields else F.col(c)).alias(c) for c in libs.columns
    ])
