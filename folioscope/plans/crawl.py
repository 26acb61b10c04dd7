"""Breadth-first crawl as rounds of DataFrame steps, for all libraries at once and resumable.

The frontier is a table: lib_id, docs_url, url, status (queued or seen), seq, updated_at. While a crawl runs it is a
log in the shared folder: a round appends the addresses it took and those it found, and rewrites nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text as tx
from ..session import cut, shared_dir
from . import ingest

BATCH = 4
Fetch = Callable[[DataFrame], DataFrame]
_LOG = ["lib_id", "docs_url", "url", "status", "seq", "page"]


def start(libs: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Frontier of libraries (lib_id, docs_url): the stored one if its address is unchanged."""
    base = F.concat(paths.strip_slashes(F.col("docs_url")), F.lit("/"))
    fresh = libs.select("lib_id", "docs_url", base.alias("url"), F.lit("queued").alias("status"), F.lit(0).cast("long").alias("seq"))
    if state is None:
        return fresh
    kept = state.select(fresh.columns).join(libs.select("lib_id", "docs_url"), ["lib_id", "docs_url"], "left_semi")
    known = kept.select("lib_id").distinct()
    return kept.select(fresh.columns).unionByName(fresh.join(known, "lib_id", "left_anti").select(fresh.columns))


def links(fetched: DataFrame) -> DataFrame:
    """lib_id, docs_url, url, pos: canonical links of fetched pages that the crawl may follow."""
    found = fetched.select("lib_id", "docs_url", F.col("url").alias("__page"), F.posexplode_outer(paths.hrefs(F.col("html"))).alias("pos", "href"))
    # behind a generator an address is a column of its own: what reads it does not repeat how it was made
    own = lambda address: F.explode_outer(F.array(address))
    joined = found.filter("href IS NOT NULL").select("lib_id", "docs_url", own(paths.url_join(F.col("__page"), F.col("href"))).alias("__to"), "pos", "__page")
    return joined.select("lib_id", "docs_url", own(paths.norm_url(F.col("__to"))).alias("url"), "pos", "__page").filter(
        paths.url_allowed(F.col("url"), F.col("docs_url")) & ~paths.link_denied(F.col("url"))
    )


def take(frontier: DataFrame, query: Column, width: int = BATCH) -> DataFrame:
    """The next ``width`` queued addresses of each library: priority, then arrival."""
    order = W.partitionBy("lib_id").orderBy(paths.crawl_priority(F.col("url"), tx.crawl_terms(query)), "seq", "url")
    queued = frontier.filter("status = 'queued'")
    return queued.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= width).drop("__n")


def _batch(frontier: DataFrame, query: Column, width: int, caps: DataFrame | None, max_rounds: int | None) -> DataFrame:
    """What a round takes: ``width`` addresses of a library that may end before its queue, the whole queue of the others.

    Without a cap and a budget every address is taken in the end, so its turn decides nothing.
    """
    if max_rounds is not None:
        return take(frontier, query, width)
    if caps is None:
        return frontier.filter("status = 'queued'")
    limited = caps.filter("cap IS NOT NULL").select("lib_id").distinct()
    free = frontier.filter("status = 'queued'").join(limited, "lib_id", "left_anti")
    return take(frontier.join(limited, "lib_id", "left_semi"), query, width).unionByName(free)


def crawl(
    frontier: DataFrame, fetch: Fetch, query: Column, existing: DataFrame | None = None,
    caps: DataFrame | None = None, width: int = BATCH, max_rounds: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(chunks, frontier). ``fetch`` maps (lib_id, docs_url, url) to those plus text and html.

    A library stops when nothing is queued, or with as many chunks as ``caps`` (lib_id, cap) allows it. ``max_rounds`` is the budget;
    what is still queued then is the state a later call resumes from. Where neither may end a library, a round takes all
    that is queued, so the rounds follow the depth of the links; elsewhere it takes ``width`` addresses.
    """
    spark = frontier.sparkSession
    folder = f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}"
    one = frontier.select(*_LOG[:-1], paths.norm_url(F.col("url")).alias("page")).groupBy("lib_id", "page").agg(
        F.min_by(F.struct(*_LOG[:-1]), F.struct("seq", "url")).alias("r")).select("r.*", "page")
    one.write.parquet(f"{folder}/log")
    kinds = one.schema

    def now() -> DataFrame:
        """One row per page from the log: seen once any of its rows says so."""
        rows = spark.read.schema(kinds).parquet(f"{folder}/log").groupBy("lib_id", "page").agg(
            F.min_by(F.struct("docs_url", "url", "seq"), F.struct("seq", "url")).alias("r"), F.bool_or(F.col("status") == "seen").alias("s"))
        return rows.select("lib_id", "r.docs_url", "r.url", F.when(F.col("s"), "seen").otherwise("queued").alias("status"), "r.seq", "page")

    known = None if existing is None else cut(existing.select("lib_id", paths.norm_url(F.col("path")).alias("path")).distinct())
    top = one.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    chunks, rounds = None, 0
    while max_rounds is None or rounds < max_rounds:
        waiting = now()
        if caps is not None and chunks is not None:
            full = chunks.groupBy("lib_id").count().join(caps, "lib_id").filter(F.col("count") >= F.col("cap")).select("lib_id")
            waiting = waiting.join(full, "lib_id", "left_anti")
        batch = cut(_batch(waiting, query, width, caps, max_rounds))
        if batch.isEmpty():
            break
        rounds += 1
        got = cut(batch.select("lib_id", "docs_url", "page", "seq", "url").join(
            fetch(batch.select("lib_id", "docs_url", "url")).select("lib_id", "url", "text", "html"), ["lib_id", "url"], "left"))
        body = got.select("lib_id", F.col("page").alias("path"), "text")
        if known is not None:
            body = body.join(known, ["lib_id", "path"], "left_anti")
        fresh = ingest.page_chunks(body)
        fresh.write.mode("append").parquet(f"{folder}/chunks")
        chunks = spark.read.schema(fresh.schema).parquet(f"{folder}/chunks")
        # a later round comes after all earlier ones, and inside a round the place on the page decides
        seq = (F.lit(top) + F.lit(rounds << 32) + F.min("pos")).cast("long")
        found = links(got).groupBy("lib_id", "docs_url", F.col("url").alias("page")).agg(F.min("url").alias("url"), seq.alias("seq"))
        logged = spark.read.schema(kinds).parquet(f"{folder}/log").select("lib_id", "page")
        new = found.join(logged, ["lib_id", "page"], "left_anti").withColumn("status", F.lit("queued"))
        taken = batch.withColumn("status", F.lit("seen"))
        new.select(_LOG).unionByName(taken.select(_LOG)).write.mode("append").parquet(f"{folder}/log")
    return chunks, now()


def completed(frontier: DataFrame) -> DataFrame:
    """lib_id, complete: nothing is left in the queue."""
    return frontier.groupBy("lib_id").agg((F.count_if(F.col("status") == "queued") == 0).alias("complete"))


def saved_state(frontier: DataFrame, now: Column) -> DataFrame:
    """What is stored for the next call: only libraries that still have a queue."""
    waiting = frontier.filter("status = 'queued'").select("lib_id").distinct()
    return frontier.join(waiting, "lib_id", "left_semi").select(
        "lib_id", "docs_url", "url", "status", "seq", now.alias("updated_at"))


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, level: breadth-first distance over ``edges`` (src, dst) from ``roots`` (node).

    One join, one distinct and one anti join per level; lineage is cut at every level.
    """
    reached = cut(roots.select("node", F.lit(0).alias("level")).distinct())
    border, depth = reached, 0
    while True:
        depth += 1
        step = edges.join(border.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        border = cut(step.join(reached.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("level")))
        if border.isEmpty():
            return reached
        reached = reached.unionByName(border)  # both lie in the checkpoint folder already
