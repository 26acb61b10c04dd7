"""Page lists: link lists in Markdown and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text as tx

#: Fixed value: the form of a link line.
LINK = r"^\s*[-*\d.]*\s*\[([^\]]+)\]\((\S+)\)"


def markdown_links(text: Column, base_url: Column | None = None) -> Column:
    """Array of (url, title) for the lines that hold a web link, filtered by site and language."""
    rows = F.transform(
        F.filter(tx.lines(text), lambda ln: F.rlike(ln, F.lit(LINK))),
        lambda ln: F.struct(F.regexp_extract(ln, LINK, 2).alias("url"), F.regexp_extract(ln, LINK, 1).alias("title")),
    )
    rows = F.filter(rows, lambda r: F.startswith(r["url"], F.lit("http")))
    return rows if base_url is None else F.filter(rows, lambda r: paths.url_allowed(r["url"], base_url))


def sitemap_locs(xml: Column) -> Column:
    """Addresses of a sitemap or sitemap index; an empty list for anything else.

    Read with a pattern instead of an XML parser: a broken file gives what it holds or nothing,
    and never fails the job.
    """
    spaced = F.rlike(F.coalesce(xml, F.lit("")), F.lit(r'^\s*<(?s:.)*xmlns(?::\w+)?\s*=\s*["\']http://www\.sitemaps\.org/schemas/sitemap/0\.9["\']'))
    closed = F.rlike(F.coalesce(xml, F.lit("")), F.lit(r"</(?:\w+:)?(?:urlset|sitemapindex)\s*>\s*\z"))
    body = F.regexp_replace(xml, r"(?s)<!--.*?-->", "")
    raw = F.regexp_extract_all(body, F.lit(r"<(?:\w+:)?loc\s*>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc\s*>"), F.lit(1))
    plain = F.transform(raw, lambda u: F.replace(F.replace(F.replace(F.replace(F.replace(
        u, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')),
        F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&")))
    return F.when(spaced & closed, F.filter(plain, lambda u: u != "")).otherwise(F.array().cast("array<string>"))


def is_nested(loc: Column) -> Column:
    return F.endswith(loc, F.lit(".xml")) & F.contains(F.lower(loc), F.lit("sitemap"))


def collect_locs(probes: DataFrame, fetched: DataFrame) -> DataFrame:
    """lib_id, url: pages of the sitemaps, one level of nesting followed.

    ``probes``: lib_id, base, kind_ord (0 index, 1 sitemap), text. ``fetched``: url, text of nested
    sitemaps. Per library the first kind that gives any page wins.
    """
    locs = probes.select("lib_id", "base", "kind_ord", F.explode_outer(sitemap_locs(F.col("text"))).alias("url")).filter("url IS NOT NULL")
    nested = locs.filter(is_nested(F.col("url"))).join(fetched.select("url", F.col("text").alias("__sub")), "url")
    inner = nested.select("lib_id", "base", "kind_ord", F.explode_outer(sitemap_locs(F.col("__sub"))).alias("url")).filter("url IS NOT NULL")
    pages = locs.filter(~is_nested(F.col("url"))).unionByName(inner).filter(paths.url_allowed(F.col("url"), F.col("base")))
    first = pages.groupBy("lib_id").agg(F.min("kind_ord").alias("kind_ord"))
    return pages.join(first, ["lib_id", "kind_ord"], "left_semi").select("lib_id", "url").distinct()


def union_pages(listed: DataFrame, mapped: DataFrame) -> DataFrame:
    """Listed pages plus the mapped ones whose canonical address is not listed (lib_id, url)."""
    page = paths.norm_url(F.col("url"))
    known = listed.select("lib_id", page.alias("__page")).distinct()
    extra = mapped.withColumn("__page", page).join(known, ["lib_id", "__page"], "left_anti").select("lib_id", "url")
    return listed.select("lib_id", "url").unionByName(extra)
