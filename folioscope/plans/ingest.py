"""From pages to chunks, and the choice between a library's page sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards, html as hx, paths, text as tx
from ..operators.ordering import running

#: A library without a cap of its own is read whole.
NO_CAP = 1 << 62


def page_chunks(pages: DataFrame, text: str = "text") -> DataFrame:
    """lib_id, path, title, text, chunk_no for pages (lib_id, path, text). No shuffle."""
    ready = pages.filter(F.coalesce(F.col(text), F.lit("")) != "").select(
        "lib_id", "path", tx.page_title(F.col(text), F.col("path")).alias("title"), tx.chunk_text(F.col(text)).alias("__chunks")
    )
    return ready.select("lib_id", "path", "title", F.posexplode_outer("__chunks").alias("chunk_no", "text"))


def page_order(pages: DataFrame, query: Column) -> DataFrame:
    """Add ``page_rank`` per library: query matches first, more matches, shorter address, address."""
    terms = tx.crawl_terms(query)
    n = paths.matched_terms(F.col("url"), terms)
    order = [(n == 0).asc(), (-n).asc(), F.length("url").asc(), F.col("url").asc()]
    return running(pages, ["lib_id"], order, out="page_rank")


def select_pages(pages: DataFrame, existing: DataFrame, query: Column) -> DataFrame:
    """Listed pages (lib_id, url) not stored yet, one per canonical address, in processing order."""
    ranked = pages.dropDuplicates(["lib_id", "url"]).withColumn("page", paths.norm_url(F.col("url")))
    known = existing.select("lib_id", paths.norm_url(F.col("path")).alias("page")).distinct()
    fresh = ranked.join(known, ["lib_id", "page"], "left_anti")
    terms = tx.crawl_terms(query)
    n = paths.matched_terms(F.col("url"), terms)
    key = F.struct((n == 0).alias("a"), (-n).alias("b"), F.length("url").alias("c"), F.col("url").alias("d"))
    return page_order(fresh.groupBy("lib_id", "page").agg(F.min_by("url", key).alias("url")), query)


def within_cap(page_sizes: DataFrame, cap: Column | int = NO_CAP) -> DataFrame:
    """Pages (lib_id, page_rank, n_chunks) taken before the cap is reached, with ``complete``.

    A page is taken while the chunks before it are fewer than the cap; reaching it means that
    the library is not complete. Rows here are pages, narrow ones, not chunks.
    """
    limit = cap if isinstance(cap, Column) else F.lit(cap)
    upto = running(page_sizes, ["lib_id"], [F.col("page_rank").asc()], F.col("n_chunks"), out="__upto")
    totals = upto.groupBy("lib_id").agg(F.max("__upto").alias("__total"))
    taken = upto.withColumn("before", F.col("__upto") - F.col("n_chunks")).filter(F.col("before") < limit)
    return taken.join(totals, "lib_id").withColumn("complete", F.col("__total") < limit).drop("__upto", "__total")


def choose_source(probes: DataFrame) -> DataFrame:
    """lib_id, branch: where the pages of a library come from.

    ``probes``: lib_id, docs_url, n_links, has_list, n_locs, has_readme, n_crawled, crawl_done.
    """
    hosted = F.rlike("docs_url", F.lit(r"^https?://github\.com/"))
    return probes.withColumn(
        "branch",
        F.when(F.col("has_list") & (F.col("n_links") == 0), "list-as-page")
        .when(F.col("has_list"), "list+sitemap")
        .when(F.col("n_locs") > 0, "sitemap")
        .when(F.col("has_readme"), "readme")
        .when(~hosted & ((F.col("n_crawled") > 0) | ~F.col("crawl_done")), "crawl")
        .otherwise("single-page"),
    )


def extracted(raw: DataFrame, *more: str) -> DataFrame:
    """lib_id, path, text and ``more`` columns of raw pages (lib_id, url, html) that pass the admission rules."""
    # behind a generator the text is a column of its own: the filters read it, they do not repeat it
    text = F.explode_outer(F.array(hx.extract(F.col("html"))))
    return raw.select("lib_id", paths.norm_url(F.col("url")).alias("path"), text.alias("text"), *more).filter(
        (F.col("text") != "") & ~guards.has_injection(F.col("text"))
    )


def numbered(chunks: DataFrame, out: str) -> DataFrame:
    """Number chunks over all libraries in page order: unique, and rising inside a library."""
    order = [F.col("lib_id").asc(), F.col("path").asc(), F.col("chunk_no").asc()]
    return running(chunks.withColumn("__all", F.lit(0)), ["__all"], order, out=out).drop("__all")


def one_per_path(pages: DataFrame) -> DataFrame:
    """Of pages (lib_id, path, url and more) whose addresses share a canonical path, the one of least address."""
    best = pages.groupBy("lib_id", "path").agg(F.min_by(F.struct(*pages.columns), F.struct("url", "text")).alias("p"))
    return best.select("p.*")
