"""Batch HTTP reader: :func:`fetch` turns a DataFrame of addresses into one of answers."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards, html as hx, paths

PAGE_SCHEMA = "url string, status int, content_type string, etag string, body string"
AGENT = "folioscope/1.0"


def get_page(url: str, timeout: float, etag: str = "", method: str = "GET", opener=urllib.request.urlopen) -> tuple:
    """One request; any failure is a row with status 0, never an exception."""
    headers = {"User-Agent": AGENT, **({"If-None-Match": etag} if etag else {})}
    try:
        with opener(urllib.request.Request(url, headers=headers, method=method), timeout=timeout) as answer:
            charset = answer.headers.get_content_charset() or "utf-8"
            body = answer.read().decode(charset, errors="replace")
            return url, answer.status, answer.headers.get("content-type") or "", answer.headers.get("etag") or "", body
    except urllib.error.HTTPError as error:
        return url, error.code, "", "", ""
    except (OSError, ValueError, LookupError):
        return url, 0, "", "", ""


def fetch(urls: DataFrame, timeout: float = 20.0, method: str = "GET", at_once: int = 4) -> DataFrame:
    """Fetch the ``url`` column (with optional ``etag``) where it is safe to; one row per address.

    Addresses are spread over tasks; a task waits for ``at_once`` pages at a time and holds no more.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tags = batch["etag"].fillna("") if "etag" in batch else [""] * len(batch)
            asked = list(zip(batch["url"], tags))
            with ThreadPoolExecutor(at_once) as pool:
                for i in range(0, len(asked), at_once):
                    got = list(pool.map(lambda one: get_page(one[0], timeout, one[1], method), asked[i:i + at_once]))
                    yield pd.DataFrame(got, columns=["url", "status", "content_type", "etag", "body"])

    columns = [c for c in ("url", "etag") if c in urls.columns]
    safe = urls.select(*columns).filter(guards.ssrf_safe(F.col("url"))).dropDuplicates(["url"])
    return safe.repartition("url").mapInPandas(run, PAGE_SCHEMA)


def page_text(status: Column, content_type: Column, body: Column) -> Column:
    """Document text of an answer, or null: status, type, extraction and injection rules."""
    markup = F.contains(content_type, F.lit("text/html")) | F.startswith(F.ltrim(body), F.lit("<"))
    text = F.when(markup, hx.extract(body)).otherwise(body)
    fit = (status == 200) & guards.textual_mime(content_type)
    return F.when(fit & (text != "") & ~guards.has_injection(text), text)


def crawl_text(status: Column, content_type: Column, body: Column) -> Column:
    """Text of a crawled page; empty where only its links are of use, null where it is refused."""
    text = hx.extract(body)
    return F.when((status == 200) & guards.textual_mime(content_type) & ~guards.has_injection(text), text)


def probe_text(status: Column, content_type: Column, body: Column) -> Column:
    """Body of a plain-text or XML list file, or null for pages and disguised missing pages."""
    start = F.lower(F.ltrim(body))
    page = F.contains(content_type, F.lit("text/html")) | F.rlike(start, F.lit("^(<html|<!doctype)"))
    return F.when((status == 200) & ~page & ~guards.looks_missing(body), body)


def probe_urls(libs: DataFrame) -> DataFrame:
    """lib_id, kind, url: where a library's page lists may lie (libs: lib_id, docs_url)."""
    base = paths.strip_slashes(F.col("docs_url"))
    root = F.concat(paths.scheme_of(base), F.lit("://"), paths.netloc_of(base))
    at_root = F.when(root != base, root)
    kinds = [
        ("llms-full", base, "llms-full.txt"), ("llms", base, "llms.txt"),
        ("sitemap-index", base, "sitemap-index.xml"), ("sitemap", base, "sitemap.xml"),
        ("root-sitemap-index", at_root, "sitemap-index.xml"), ("root-sitemap", at_root, "sitemap.xml"),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.concat_ws("/", b, F.lit(f)).alias("url"), b.isNotNull().alias("ok")) for k, b, f in kinds])
    return libs.select("lib_id", F.explode(rows).alias("p")).filter("p.ok").select("lib_id", "p.kind", "p.url")


def readme_urls(libs: DataFrame) -> DataFrame:
    """lib_id, ord, url: the places of a repository's README, in order."""
    repo = F.regexp_extract(paths.strip_slashes(F.col("docs_url")), r"^https?://github\.com/([\w.-]+/[\w.-]+)", 1)
    names = [f"{branch}/README.{end}" for branch in ("main", "master") for end in ("md", "rst", "txt")]
    tails = F.array(*map(F.lit, names))
    return libs.filter(repo != "").select("lib_id", repo.alias("__r"), F.posexplode(tails).alias("ord", "__t")).select(
        "lib_id", "ord", F.concat(F.lit("https://raw.githubusercontent.com/"), "__r", F.lit("/"), "__t").alias("url")
    )


def current_etag(answers: DataFrame) -> DataFrame:
    """id, etag from HEAD answers (id, ord, status, etag, old_etag): 304 keeps the old mark."""
    mark = F.when(F.col("status") == 304, F.col("old_etag")).when((F.col("status") == 200) & (F.col("etag") != ""), F.col("etag"))
    return answers.groupBy("id").agg(F.min_by(mark, F.when(mark.isNotNull(), F.col("ord"))).alias("etag"))
