"""When a library is looked at again. ``now`` is a column, so runs are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400
COOLDOWN = 3_600
MAX_AGE = 7 * DAY


def seconds_since(moment: Column, now: Column) -> Column:
    """Age in seconds; null where the stored text is no timestamp."""
    return F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(moment.cast("string")))


def recrawl_allowed(recrawl_at: Column, fetched_at: Column, now: Column, force: Column | bool = False) -> Column:
    """No within the cooldown; else yes if forced, never fetched, or older than a week."""
    forced = force if isinstance(force, Column) else F.lit(force)
    cooling = F.coalesce(seconds_since(recrawl_at, now) < COOLDOWN, F.lit(False))
    old = F.coalesce(seconds_since(fetched_at, now) > MAX_AGE, F.lit(True))
    return ~cooling & (forced | old)


def refresh_due(last_check: Column, trust: Column, stable: Column, now: Column) -> Column:
    """Check interval: a day (week for little-trusted libraries), doubled per unchanged check."""
    base = F.when(trust > 5, DAY).otherwise(7 * DAY)
    interval = F.least(base * F.pow(F.lit(2), F.least(F.coalesce(stable, F.lit(0)), F.lit(3))), F.lit(7 * DAY))
    return F.coalesce(seconds_since(last_check, now) >= interval, F.lit(True))


def needs_ingest(n_chunks: Column, full: Column, stale: Column, version: Column) -> Column:
    pinned = F.coalesce(version, F.lit("")) != ""
    return (n_chunks == 0) | (~pinned & ~full) | (~pinned & stale)


def apply_check(libs: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """Fold one freshness probe (id, latest_ver, versions, etag) into ``libs``.

    New version: taken over, ingest marked incomplete, interval reset. Else a changed etag marks
    the ingest incomplete, a first etag is only stored, an equal one lengthens the interval.
    """
    probe = checks.select("id", *[F.col(c).alias(f"__{c}") for c in ("latest_ver", "versions", "etag")], F.lit(True).alias("__seen"))
    df = libs.join(probe, "id", "left")
    seen = F.coalesce(F.col("__seen"), F.lit(False))
    moved = seen & (F.coalesce(F.col("__latest_ver"), F.lit("")) != "") & (F.col("__latest_ver") != F.coalesce(F.col("latest_ver"), F.lit("")))
    old = F.coalesce(F.col("etag"), F.lit(""))
    tagged = seen & ~moved & F.col("__etag").isNotNull()
    changed, first, same = tagged & (F.col("__etag") != old) & (old != ""), tagged & (old == "") & (F.col("__etag") != ""), tagged & (F.col("__etag") == old)
    new = {
        "latest_ver": F.when(moved, F.col("__latest_ver")).otherwise(F.col("latest_ver")),
        "versions": F.when(moved, F.col("__versions")).otherwise(F.col("versions")),
        "full": F.col("full") & ~F.coalesce(moved | changed, F.lit(False)),
        "stable": F.when(moved | changed, 0).when(same, F.col("stable") + 1).otherwise(F.col("stable")),
        "etag": F.when(changed | first, F.col("__etag")).otherwise(F.col("etag")),
        "last_check": F.when(seen, now).otherwise(F.col("last_check")),
    }
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in libs.columns])


def docs_moved(libs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Libraries whose resolved address (id, docs_url, repo) is new: take it, ingest again."""
    def address(url: Column, repo: Column) -> Column:
        return F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(F.concat(F.lit("https://"), F.coalesce(repo, F.lit(""))))

    found = resolved.select("id", address(F.col("docs_url"), F.col("repo")).alias("__url"))
    df = libs.join(found, "id", "left")
    moved = F.coalesce(F.col("__url") != address(F.col("docs_url"), F.col("repo")), F.lit(False))
    new = {"docs_url": F.when(moved, F.col("__url")).otherwise(F.col("docs_url")), "full": F.col("full") & ~moved}
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in libs.columns])


def unexpired(cache: DataFrame, now: Column, ttl: int = 3_600, at: str = "cached_at") -> DataFrame:
    """Rows of a timestamped lookup table that are still valid."""
    return cache.filter(F.unix_timestamp(now) - F.unix_timestamp(F.col(at)) < ttl)


def same_docs(candidates: DataFrame, libs: DataFrame) -> DataFrame:
    """Add ``use_id``: the stored library with the candidate's documentation address, else its own id.

    The smallest id other than the candidate's own wins. The two smallest ids per address are
    enough to know it, and both are plain aggregates, so a popular address stays one row.
    """
    known = libs.filter("coalesce(docs_url, '') <> ''").select("docs_url", F.col("id").alias("__id"))
    first = known.groupBy("docs_url").agg(F.min("__id").alias("__first"))
    second = known.join(first, "docs_url").filter("__id > __first").groupBy("docs_url").agg(F.min("__id").alias("__second"))
    df = candidates.join(first, "docs_url", "left").join(second, "docs_url", "left")
    other = F.when(F.col("__first") != F.col("id"), F.col("__first")).otherwise(F.col("__second"))
    return df.select(*candidates.columns, F.coalesce(other, F.col("id")).alias("use_id"))
