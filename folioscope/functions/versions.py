"""Version lists: which are stable releases, and their order. Native array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP = 20
# A final release: optional epoch, numbers, optional local label; no pre, post or dev part.
_FINAL = r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"


def is_stable(version: Column) -> Column:
    return F.rlike(version, F.lit(_FINAL))


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda p: p.cast("decimal(38,0)"))


def sort_key(version: Column) -> Column:
    """Comparable form: epoch, release numbers without trailing zeros, local label."""
    epoch = F.coalesce(F.nullif(F.regexp_extract(version, _FINAL, 1), F.lit("")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    release = _numbers(F.regexp_replace(F.regexp_extract(version, _FINAL, 2), r"(?:\.0+)+$", ""))
    label = F.lower(F.regexp_extract(version, _FINAL, 3))
    local = F.transform(
        F.filter(F.split(label, "[-_.]"), lambda p: p != ""),
        lambda p: F.struct(
            F.rlike(p, F.lit(r"^\d+$")).alias("numeric"),
            F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("number"),
            F.when(F.rlike(p, F.lit(r"^\d+$")), "").otherwise(p).alias("word"),
        ),
    )
    return F.struct(epoch.alias("epoch"), release.alias("release"), local.alias("local"))


def stable_versions(versions: Column, keep: int | None = KEEP) -> Column:
    """Stable releases, newest first; equal versions keep their order."""
    ranked = F.transform(
        F.filter(versions, is_stable),
        lambda v, i: F.struct(sort_key(v).alias("key"), (-i).alias("pos"), v.alias("version")),
    )
    newest = F.transform(F.sort_array(ranked, asc=False), lambda r: r["version"])
    return newest if keep is None else F.slice(newest, 1, keep)
