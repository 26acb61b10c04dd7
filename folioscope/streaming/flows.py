"""Structured Streaming: incremental ingest into the store, and the activity log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators import upsert
from ..plans import ingest
from ..plans.store import Store

RAW_PAGES = "lib_id string, ver string, url string, html string"


def raw_pages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Crawled pages as they arrive; the file limit bounds the work of one batch."""
    return spark.readStream.schema(RAW_PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_batch(store: Store, batch: DataFrame, batch_id: int, stream: str = "") -> None:
    """Extract, chunk, drop near-duplicates of stored text, replace pages, publish.

    Stream and batch number are the version's tag; a batch published at any time is skipped, so a
    restart that replays it changes nothing but an index that was left behind.
    """
    tag = f"batch-{stream}-{batch_id}"
    done = store.versions().filter((F.col("table_name") == "chunks") & (F.col("tag") == tag))
    if not done.isEmpty():
        if store.newest("corpus_stats") is not None and not store.index_is_current():
            store.build_index()
        return
    if batch.isEmpty():
        return
    pages = ingest.one_per_path(ingest.extracted(batch, "url", "ver"))
    rows = ingest.page_chunks(pages).join(pages.select("lib_id", "path", "ver"), ["lib_id", "path"])
    # page order follows from the rows, so a repeated batch gives the same numbers again
    incoming = ingest.numbered(rows, "ord").select(
        "lib_id", "ver", "path", "title", "text", F.current_timestamp().alias("fetched_at"), "ord")
    touched = store.buckets_of(batch)
    after = upsert.add_chunks(store.read("chunks", touched), incoming, store.last_id())
    store.write_chunks(after, touched, tag)


def start_ingest(store: Store, pages: DataFrame, checkpoint: str) -> StreamingQuery:
    """Work through all pages available now, then stop; a later start goes on from there."""
    return (
        pages.writeStream.foreachBatch(lambda df, n: ingest_batch(store, df, n, checkpoint))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def activity_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schema.ACTIVITY).json(path)


def append_activity(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Copy activity events into the log, each once."""
    return (
        events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def log_activity(events: DataFrame, path: str) -> None:
    """Append a batch of events (columns of the activity schema) to the log."""
    names = [f.name for f in schema.ACTIVITY.fields]
    events.select(*[F.col(c) if c in events.columns else F.lit(None).alias(c) for c in names]).write.mode("append").json(path)
