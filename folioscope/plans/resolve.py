"""Library names to candidates, and version histories, for batches of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import versions as vs
from ..operators import candidates as cd
from ..sources import packages

_COLUMNS = ["name", "query", "src_ord", "id", "repo", "docs_url", "trust", "latest_ver", "versions"]


def resolve(
    names: DataFrame, aliases: DataFrame, modules: DataFrame, answers: DataFrame,
    histories: DataFrame, stars: DataFrame, indexes: DataFrame, libs: DataFrame | None = None,
) -> DataFrame:
    """Ranked candidates for ``names`` (name, query).

    A trusted curated entry answers alone, then the standard libraries, then the merged registry
    ``answers`` (see ``sources.packages``). ``histories`` (name, versions) completes curated entries.
    """
    none = F.array().cast("array<string>")
    hist = histories.select("name", F.col("versions").alias("__vs"))
    known = cd.curated(names, aliases).filter(F.col("trust") > 90).join(hist, "name", "left")
    has = F.coalesce(F.size("__vs") > 0, F.lit(False))
    curated = known.select(
        "name", "query", F.lit(0).alias("src_ord"), "id", F.col("repo"),
        F.regexp_replace("docs_url", r"/+\z", "").alias("docs_url"), "trust",
        F.when(has & ~F.array_contains("__vs", F.col("latest_ver")), F.get("__vs", F.lit(0))).otherwise(F.col("latest_ver")).alias("latest_ver"),
        F.when(has, F.slice("__vs", 1, vs.KEEP)).when(F.col("latest_ver") != "", F.array("latest_ver")).otherwise(none).alias("versions"),
    )
    rest = names.join(curated.select("name").distinct(), "name", "left_anti")
    builtin = cd.standard_modules(rest, modules).withColumn("src_ord", F.lit(0)).withColumn("versions", none).select(_COLUMNS)
    rest = rest.join(builtin.select("name").distinct(), "name", "left_anti")
    merged = cd.enrich(cd.merge(cd.normalize(answers.join(rest.select("name").distinct(), "name", "left_semi"))), stars, indexes)
    boosted = merged.join(rest, "name").withColumn(
        "trust", cd.boost(F.col("trust"), cd.query_terms(F.col("query")), F.col("id"), F.col("repo"), F.col("docs_url"))
    ).select(_COLUMNS)
    found = curated.select(_COLUMNS).unionByName(builtin).unionByName(boosted)
    return cd.rank(found if libs is None else cd.backfill(found, libs))


def from_answers(raw: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, histories) for :func:`resolve` from stored registry answers, one table per source.

    ``raw`` maps a name of ``packages.SOURCES`` to its rows. Of a name's version lists the longest
    counts, measured before any list is cut.
    """
    rows = None
    for source, table in raw.items():
        part = packages.SOURCES[source](table)
        rows = part if rows is None else rows.unionByName(part)
    return rows, cd.versions_argmax(cd.histories_of(rows))


def version_history(candidates: DataFrame, ecosystem: DataFrame, libs: DataFrame) -> DataFrame:
    """name, versions: the resolved list if it has more than one entry, else the longest ecosystem
    history, else what the store knows (libs: id = name)."""
    top = candidates.filter("rank = 1").select("name", F.col("versions").alias("__resolved"))
    eco = ecosystem.select("name", F.col("versions").alias("__eco"))
    old = libs.select(F.col("id").alias("name"), F.col("versions").alias("__old"))
    names = top.select("name").unionByName(eco.select("name")).unionByName(old.select("name")).distinct()
    df = names.join(top, "name", "left").join(eco, "name", "left").join(old, "name", "left")
    return df.select("name", F.when(F.size("__resolved") > 1, F.col("__resolved")).when(F.size("__eco") > 0, F.col("__eco")).otherwise(
        F.coalesce("__old", F.array().cast("array<string>"))).alias("versions"))
