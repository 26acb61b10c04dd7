"""Whole libraries: from a documentation address to chunks, and the calls a client makes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards, paths
from ..operators import freshness, upsert
from ..session import cut, stored
from ..sources import http, listings
from . import crawl, ingest, retrieval
from .store import Store

#: url -> url, status, content_type, etag, body; :func:`sources.http.fetch` or a table of saved pages.
Fetch = Callable[[DataFrame], DataFrame]

_LIST, _INDEX, _MAP = ("llms-full", "llms"), ("sitemap-index", "root-sitemap-index"), ("sitemap", "root-sitemap")


def _first_text(probed: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """lib_id, docs_url, url, text of the first kind that answered."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    usable = probed.filter(F.col("kind").isin(*kinds) & F.col("text").isNotNull())
    best = usable.groupBy("lib_id", "docs_url").agg(F.min_by(F.struct("url", "text"), place).alias("b"))
    return best.select("lib_id", "docs_url", "b.url", "b.text")


def _texts(pages: DataFrame, fetch: Fetch, rule: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``pages`` (with url) and ``text`` of what came back; null where it is refused."""
    safe = pages.select("url").distinct().filter(guards.ssrf_safe(F.col("url")))
    text = F.explode_outer(F.array(rule(F.col("status"), F.col("content_type"), F.col("body"))))
    return pages.join(fetch(safe).select("url", text.alias("text")), "url", "left")


def discover(libs: DataFrame, fetch: Fetch) -> tuple[DataFrame, DataFrame]:
    """(listed pages, probe results): what list files and sitemaps of ``libs`` (lib_id, docs_url) name.

    Results: lib_id, docs_url, list_url, has_list, n_links, n_locs.
    """
    probed = stored(_texts(http.probe_urls(libs).join(libs.select("lib_id", "docs_url"), "lib_id"), fetch, http.probe_text))
    lists = _first_text(probed, _LIST)
    base = paths.strip_slashes(F.col("docs_url"))
    links = cut(lists.select("lib_id", F.explode_outer(listings.markdown_links(F.col("text"), base)).alias("l")).filter(
        "l IS NOT NULL").select("lib_id", "l.url"))
    maps = _first_text(probed, _INDEX).withColumn("kind_ord", F.lit(0)).unionByName(
        _first_text(probed, _MAP).withColumn("kind_ord", F.lit(1)))
    maps = maps.select("lib_id", base.alias("base"), "kind_ord", "text")
    nested = maps.select(F.explode_outer(listings.sitemap_locs(F.col("text"))).alias("url")).filter(listings.is_nested(F.col("url"))).distinct()
    locs = cut(listings.collect_locs(maps, _texts(nested, fetch, http.probe_text)))
    counts = libs.select("lib_id", "docs_url").join(lists.select("lib_id", F.col("url").alias("list_url")), "lib_id", "left")
    for found, name in ((links, "n_links"), (locs, "n_locs")):
        counts = counts.join(found.groupBy("lib_id").agg(F.count("*").alias(name)), "lib_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    results = cut(counts.withColumn("has_list", F.col("list_url").isNotNull()))
    with_list = results.filter("n_links > 0").select("lib_id")
    without = results.filter("NOT has_list").select("lib_id")
    pages = listings.union_pages(links, locs.join(with_list, "lib_id", "left_semi")).unionByName(
        locs.join(without, "lib_id", "left_semi").select("lib_id", "url"))
    return pages, results


def ingest_list(pages: DataFrame, caps: DataFrame, existing: DataFrame, fetch: Fetch, query: Column) -> tuple[DataFrame, DataFrame]:
    """(chunks, status) of listed pages (lib_id, url), new ones only, until each library's cap.

    A library's next ``cap`` pages are fetched per round; pages that give nothing cost one more round.
    """
    ordered = cut(ingest.select_pages(pages, existing, query).join(caps, "lib_id"))
    chunks, sizes, step = None, None, 0
    open_libs = caps.select("lib_id")
    while True:
        batch = ordered.join(open_libs, "lib_id", "left_semi").filter(F.ceil(F.col("page_rank") / F.col("cap")) == step + 1)
        batch = cut(batch.select("lib_id", "url", F.col("page").alias("path"), "page_rank"))
        if batch.isEmpty():
            break
        got = cut(ingest.page_chunks(_texts(batch, fetch, http.page_text)))
        here = batch.join(got.groupBy("lib_id", "path").agg(F.count("*").alias("n_chunks")), ["lib_id", "path"], "left").select(
            "lib_id", "path", "page_rank", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
        chunks = got if chunks is None else chunks.unionByName(got)
        sizes = cut(here if sizes is None else sizes.unionByName(here))
        full = sizes.groupBy("lib_id").agg(F.sum("n_chunks").alias("n")).join(caps, "lib_id").filter("n >= cap").select("lib_id")
        open_libs, step = open_libs.join(full, "lib_id", "left_anti"), step + 1
    if chunks is None:
        return None, caps.select("lib_id", F.lit(True).alias("complete"))
    kept = ingest.within_cap(sizes.join(caps, "lib_id"), F.col("cap"))
    status = caps.join(kept.groupBy("lib_id").agg(F.bool_and("complete").alias("done")), "lib_id", "left")
    return (
        chunks.join(kept.select("lib_id", "path"), ["lib_id", "path"], "left_semi"),
        status.select("lib_id", F.coalesce("done", F.lit(True)).alias("complete")),
    )


def ingest_libs(
    libs: DataFrame, fetch: Fetch, existing: DataFrame, query: Column | None = None,
    state: DataFrame | None = None, crawl_rounds: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(chunks, status, frontier) for libraries (lib_id, docs_url, cap; cap 0 or null: read whole).

    Source per library: link list and sitemap, sitemap, repository README, crawl, single page.
    Status: lib_id, branch, complete.
    """
    query = F.lit("") if query is None else query
    pages, seen = discover(libs, fetch)
    lists = seen.filter("n_links > 0 OR (NOT has_list AND n_locs > 0)").select("lib_id")
    caps = libs.join(lists, "lib_id", "left_semi").select("lib_id", F.when(F.coalesce("cap", F.lit(0)) > 0, F.col("cap")).otherwise(F.lit(ingest.NO_CAP)).alias("cap"))
    parts, states = [], []
    chunks, status = ingest_list(pages, caps, existing, fetch, query)
    if chunks is not None:
        parts.append(chunks)
    branch = F.when(F.col("n_links") > 0, "list+sitemap").otherwise("sitemap")
    states.append(status.join(seen.select("lib_id", branch.alias("branch")), "lib_id"))

    alone = seen.filter("has_list AND n_links = 0").select("lib_id", F.col("list_url").alias("url"), F.lit("list-as-page").alias("branch"))
    rest = libs.join(lists, "lib_id", "left_anti").join(alone, "lib_id", "left_anti").select("lib_id", "docs_url")
    readmes = stored(_texts(http.readme_urls(rest), fetch, http.page_text).filter("text IS NOT NULL"))
    readme = readmes.groupBy("lib_id").agg(F.min_by(F.struct("url", "text"), "ord").alias("r")).select("lib_id", "r.url", "r.text")
    rest = rest.join(readme, "lib_id", "left_anti")
    sites = rest.filter(~paths.is_code_host(F.concat("docs_url", F.lit("/"))))

    def saved(batch: DataFrame) -> DataFrame:
        got = fetch(batch.select("url").distinct().filter(guards.ssrf_safe(F.col("url"))))
        text = F.explode_outer(F.array(http.crawl_text(F.col("status"), F.col("content_type"), F.col("body"))))
        found = got.select("url", F.when(F.col("status") == 200, F.col("body")).alias("html"), text.alias("text"))
        # a refused page gives no links either
        return batch.join(found.withColumn("html", F.when(F.col("text").isNotNull(), F.col("html"))), "url", "left")

    own_caps = libs.filter("cap > 0").select("lib_id", "cap")
    found, frontier = crawl.crawl(crawl.start(sites, state), saved, query, existing, own_caps, max_rounds=crawl_rounds)
    finished = crawl.completed(frontier) if found is not None else sites.select("lib_id", F.lit(True).alias("complete"))
    crawled = sites.select("lib_id").limit(0)
    if found is not None:
        parts.append(found)
        some = found.select("lib_id").distinct().unionByName(finished.filter("NOT complete").select("lib_id")).distinct()
        crawled = cut(finished.join(some, "lib_id", "left_semi"))
        states.append(crawled.select("lib_id", "complete", F.lit("crawl").alias("branch")))
    single = rest.join(crawled.select("lib_id"), "lib_id", "left_anti").select("lib_id", F.col("docs_url").alias("url"), F.lit("single-page").alias("branch"))
    whole = stored(_texts(alone.unionByName(single), fetch, http.page_text)).unionByName(readme.withColumn("branch", F.lit("readme")).select("url", "lib_id", "branch", "text"))
    parts.append(ingest.page_chunks(whole.select("lib_id", F.col("url").alias("path"), "text")))
    states.append(whole.select("lib_id", F.lit(True).alias("complete"), "branch"))
    out, status = parts[0], states[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    for more in states[1:]:
        status = status.unionByName(more.select(status.columns))
    return stored(out), cut(status), frontier if found is not None else None


def refresh_store(
    store: Store, ids: DataFrame, fetch: Fetch, query: Column | None = None, crawl_rounds: int | None = None,
    max_age: int | None = None,
) -> DataFrame:
    """Ingest the stored libraries named in ``ids`` (id), write chunks, index, flags and crawl state; returns status.

    Finished libraries lose pages no longer found; pages skipped because they were stored are kept.
    Pages fetched more than ``max_age`` seconds ago are read again; without it every stored page is skipped.
    """
    now = F.current_timestamp()
    libs = store.read("libs")
    target = libs.join(ids.select("id").distinct(), "id", "left_semi")
    asked = cut(target.select(F.col("id").alias("lib_id"), F.when(F.coalesce("docs_url", F.lit("")) != "", F.col("docs_url")).otherwise(
        F.concat(F.lit("https://"), "repo")).alias("docs_url"), F.coalesce("cap", F.lit(0)).alias("cap"), F.coalesce("latest_ver", F.lit("")).alias("ver")))
    # only the buckets of these libraries are read and written again
    touched = store.buckets_of(asked)
    before, state = store.read("chunks", touched), store.read("crawl_state")
    mine = before.join(asked.select("lib_id"), "lib_id", "left_semi")
    if max_age is not None:
        age = freshness.seconds_since(F.col("fetched_at"), now)
        mine = mine.filter(F.coalesce(age <= max_age, F.lit(False)))
    # fixed now: the age of a page must not change between the steps that read it
    existing = cut(mine.select("lib_id", "path").distinct())
    chunks, status, frontier = ingest_libs(asked, fetch, existing, query, state, crawl_rounds)
    incoming = ingest.numbered(chunks.join(asked.select("lib_id", "ver"), "lib_id"), "ord").select("lib_id", "ver", "path", "title", "text", now.alias("fetched_at"), "ord")
    after = upsert.add_chunks(before, incoming, store.last_id())
    keep = chunks.select("lib_id", "path").unionByName(existing).distinct()
    filled = chunks.select("lib_id").distinct()
    after = upsert.prune_chunks(after, keep, status.filter("complete").join(filled, "lib_id", "left_semi"))
    store.write_chunks(after, touched)
    counts = chunks.groupBy("lib_id").agg(F.count("*").alias("n"))
    flags = status.join(counts, "lib_id", "left").select(
        F.col("lib_id").alias("id"), guards.is_full(F.col("complete"), F.coalesce("n", F.lit(0))).alias("full"), now.alias("recrawl_at"))
    store.write("libs", upsert.set_flags(libs, flags))
    kept_state = upsert.drop_libs(state, asked.select(F.col("lib_id").alias("id")))
    if frontier is not None:
        kept_state = kept_state.unionByName(crawl.saved_state(frontier, now).select(kept_state.columns))
    store.write("crawl_state", kept_state)
    return status


def to_check(store: Store, now: Column) -> DataFrame:
    """id of the stored libraries whose interval since the last check, which grows while they stay stable, is over."""
    over = freshness.refresh_due(F.col("last_check"), F.coalesce("trust", F.lit(0.0)), F.coalesce("stable", F.lit(0)), now)
    return store.read("libs").filter(over).select("id")


def check_libs(store: Store, checks: DataFrame, now: Column, resolved: DataFrame | None = None) -> None:
    """Fold freshness probes (id, latest_ver, versions, etag) of the libraries :func:`to_check` names, and newly resolved addresses (id, docs_url, repo)
    into the stored libraries; :func:`due` then names those that must be read again."""
    libs = freshness.apply_check(store.read("libs"), checks, now)
    store.write("libs", libs if resolved is None else freshness.docs_moved(libs, resolved))


def embed_missing(store: Store, encoder: Callable[[Column], Column], ids: DataFrame | None = None) -> int:
    """Give vectors to the chunks that have none; vectors are keyed by chunk, so text is never written again.

    ``ids`` (id): only the directories of these libraries are read and written.
    """
    touched = None if ids is None else store.buckets_of(ids, "id")
    chunks, have = store.read("chunks", touched), store.read("chunk_vec", touched)
    todo = chunks.select("chunk_id", "lib_id", "text").join(have.select("chunk_id"), "chunk_id", "left_anti")
    fresh = todo.select("chunk_id", "lib_id", encoder(F.col("text")).alias("embedding"))
    stray = have.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    if store.newest("chunk_vec") is not None and stray.isEmpty():
        return store.append("chunk_vec", fresh)
    live = have.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return store.write("chunk_vec", live.select("chunk_id", "lib_id", "embedding").unionByName(fresh), only=touched)


def due(store: Store, now: Column) -> DataFrame:
    """id of the libraries that should be ingested: empty, incomplete, or old and not cooling down."""
    stats = store.read("chunks").groupBy("lib_id").agg(F.count("*").alias("n"), F.max("fetched_at").alias("at"))
    df = store.read("libs").join(stats.withColumnRenamed("lib_id", "id"), "id", "left")
    stale = freshness.recrawl_allowed(F.col("recrawl_at"), F.col("at"), now)
    need = freshness.needs_ingest(F.coalesce("n", F.lit(0)), F.coalesce("full", F.lit(True)), stale, F.lit(""))
    return df.filter(need).select("id")


def sites_with_index(answers: DataFrame) -> DataFrame:
    """docs_url of the sites whose list file answered with more than fifty characters."""
    return answers.filter((F.col("status") == 200) & (F.length("body") > 50)).select("docs_url").distinct()


def answer(store: Store, queries: DataFrame, resolved: DataFrame | None = None, **options) -> DataFrame:
    """Documents for queries on known libraries; guidance where a library is unknown or still empty.

    ``resolved`` (lib_id, use_id) redirects names to the stored library with the same documentation.
    """
    if resolved is not None:
        queries = queries.join(resolved, "lib_id", "left").withColumn("lib_id", F.coalesce("use_id", "lib_id")).drop("use_id")
    known = store.read("libs").select(F.col("id").alias("lib_id")).withColumn("__lib", F.lit(True))
    asked = queries.select("lib_id").distinct()
    held = store.read("chunks", store.buckets_of(asked)).select("lib_id").join(asked, "lib_id", "left_semi")
    filled = held.distinct().withColumn("__has", F.lit(True))
    tagged = cut(queries.join(known, "lib_id", "left").join(filled, "lib_id", "left"))
    plain = ~guards.empty_query(F.col("query")) & ~guards.needs_guidance(F.col("query"))
    names = queries.columns
    lost = tagged.filter(plain & F.col("__lib").isNull() & F.col("__has").isNull()).select(names)
    bare = tagged.filter(plain & F.col("__lib").isNotNull() & F.col("__has").isNull()).select(names)
    rest = tagged.filter(~plain | F.col("__has").isNotNull()).select(names)
    return store.get_docs(rest, **options).unionByName(retrieval.guidance(lost, "resolve")).unionByName(retrieval.guidance(bare, "ingest"))
