"""Registry: from raw source answers to scored library candidates, for any number of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text as tx, versions as vs
from .ordering import running

CURATED_TRUST, NODE_TRUST, PYTHON_TRUST = 95.0, 99.0, 98.0
MIN_TRUST = 0.5
NODE_DOCS, PYTHON_DOCS = "https://nodejs.org/docs/latest/api/", "https://docs.python.org/3/library/"
FIELDS = ("id", "repo", "docs_url", "trust", "latest_ver", "versions")


def normalize(found: DataFrame) -> DataFrame:
    """Uniform candidates: text id, address without trailing slash, numeric trust, version list.

    Lists are cut here; ``histories_of`` reads them whole.
    """
    latest = F.coalesce(F.col("latest_ver"), F.lit(""))
    given = F.coalesce(F.col("versions"), F.array().cast("array<string>"))
    fallback = F.when(latest != "", F.array(latest)).otherwise(F.array().cast("array<string>"))
    own_id = F.col("id").cast("string")
    return found.select(
        "name", "src_ord",
        F.when(F.coalesce(own_id, F.lit("")) != "", own_id).otherwise(paths.clean_id(F.col("name"))).alias("id"),
        F.coalesce(F.col("repo"), F.lit("")).alias("repo"),
        paths.strip_slashes(F.col("docs_url")).alias("docs_url"),
        F.coalesce(F.col("trust").cast("double"), F.lit(0.0)).alias("trust"),
        latest.alias("latest_ver"),
        F.when(F.size(given) > 0, F.slice(given, 1, vs.KEEP)).otherwise(fallback).alias("versions"),
    )


def _first(value: Column, usable: Column) -> Column:
    """Value of the first usable row: highest trust, then source order. Merges map-side."""
    return F.min_by(F.when(usable, value), F.when(usable, F.struct(-F.col("trust"), F.col("src_ord"))))


def merge(candidates: DataFrame) -> DataFrame:
    """One row per name and repository (or address): the best row, its gaps filled by the others.

    An address outside the code hosts wins over one there. Rows without repository and address
    are used up: they give version data to the candidates of the same id.
    """
    key = F.when(F.col("repo") != "", F.col("repo")).otherwise(F.col("docs_url"))
    keyed = candidates.withColumn("key", key)
    site = (F.col("docs_url") != "") & ~paths.is_code_host(F.col("docs_url"))
    no_ver, no_list = F.col("latest_ver") != "", F.size("versions") > 0
    always = F.lit(True)
    whole = keyed.filter("key <> ''").groupBy("name", "key").agg(
        _first(F.col("id"), F.col("id") != "").alias("id"),
        _first(F.col("repo"), F.col("repo") != "").alias("repo"),
        F.coalesce(_first(F.col("docs_url"), site), _first(F.col("docs_url"), F.col("docs_url") != ""), F.lit("")).alias("docs_url"),
        F.max("trust").alias("trust"),
        F.coalesce(_first(F.col("latest_ver"), no_ver), F.lit("")).alias("latest_ver"),
        F.coalesce(_first(F.col("versions"), no_list), F.array().cast("array<string>")).alias("versions"),
        _first(F.col("src_ord"), always).alias("src_ord"),
    )
    bare = keyed.filter("key = ''").groupBy("name", "id").agg(
        _first(F.col("latest_ver"), no_ver).alias("__ver"), _first(F.col("versions"), no_list).alias("__list")
    )
    df = whole.join(bare, ["name", "id"], "left")
    return df.select(
        "name", "src_ord", "id", F.coalesce("repo", F.lit("")).alias("repo"), "docs_url", "trust",
        F.when(F.col("latest_ver") != "", F.col("latest_ver")).otherwise(F.coalesce("__ver", F.lit(""))).alias("latest_ver"),
        F.when(F.size("versions") > 0, F.col("versions")).otherwise(F.coalesce("__list", F.col("versions"))).alias("versions"),
    )


def final_trust(base: Column, stars: Column, has_index: Column, repo: Column, docs_url: Column, name: Column) -> Column:
    """Popularity, plus 2 for a machine-readable index, minus 2 for a foreign repository name,
    minus 1 for documentation on a code host; never below zero."""
    popularity = F.greatest(base, F.log10(F.greatest(F.coalesce(stars, F.lit(0)), F.lit(1)).cast("double")))
    last = F.element_at(F.split(repo, "/", -1), -1)
    fork = (repo != "") & (paths.fuzzy_name(last) != paths.fuzzy_name(name))
    total = (
        popularity + F.when(F.coalesce(has_index, F.lit(False)), 2.0).otherwise(0.0)
        - F.when(fork, 2.0).otherwise(0.0) - F.when(F.contains(docs_url, F.lit("github.com")), 1.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.round(total, 2))


def enrich(candidates: DataFrame, stars: DataFrame, indexes: DataFrame) -> DataFrame:
    """Final trust from repository stars (repo, stars) and sites with an index (docs_url)."""
    flagged = indexes.select("docs_url").distinct().withColumn("__index", F.lit(True))
    df = candidates.join(stars.select("repo", F.col("stars").alias("__stars")), "repo", "left").join(flagged, "docs_url", "left")
    trust = final_trust(F.col("trust"), F.col("__stars"), F.col("__index"), F.col("repo"), F.col("docs_url"), F.col("name"))
    return df.withColumn("trust", trust).filter(F.col("trust") >= MIN_TRUST).select(candidates.columns)


def boost(trust: Column, terms: Column, id_: Column, repo: Column, docs_url: Column) -> Column:
    """Half a point for a candidate one of the query terms names."""
    hay = F.lower(F.concat_ws(" ", id_, repo, docs_url))
    return trust + F.when(F.exists(terms, lambda t: F.contains(hay, t)), 0.5).otherwise(0.0)


def stable_releases(releases: DataFrame, keep: int = vs.KEEP) -> DataFrame:
    """name, src_ord, versions, n_stable: newest final releases per package and ecosystem.

    ``releases``: name, src_ord, version, one row each. The window keeps ``keep`` rows per task and
    group, so no package's whole history is gathered; the list holds what is left of it.
    """
    good = releases.filter(vs.is_stable(F.col("version"))).select("name", "src_ord", "version").distinct()
    counts = good.groupBy("name", "src_ord").agg(F.count("*").alias("n_stable"))
    newest = W.partitionBy("name", "src_ord").orderBy(vs.sort_key(F.col("version")).desc(), "version")
    top = good.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= keep)
    lists = top.groupBy("name", "src_ord").agg(F.sort_array(F.collect_list(F.struct("__n", "version"))).alias("__l"))
    return lists.join(counts, ["name", "src_ord"]).select("name", "src_ord", F.col("__l.version").alias("versions"), "n_stable")


def versions_argmax(histories: DataFrame) -> DataFrame:
    """name, versions: the ecosystem with the longest stable history, earlier source on ties.

    ``histories``: name, src_ord, versions, n_stable. Lengths are those before the list was cut.
    """
    best = F.min_by("versions", F.struct((-F.col("n_stable")).alias("n"), F.col("src_ord")))
    return histories.filter("n_stable > 0").groupBy("name").agg(best.alias("versions"))


def histories_of(answers: DataFrame, keep: int = vs.KEEP) -> DataFrame:
    """The same from registry answers, whose version lists are arrays (name, src_ord, versions)."""
    stable = F.explode_outer(F.array(vs.stable_versions(F.col("versions"), None)))
    return answers.select("name", "src_ord", stable.alias("__all")).select(
        "name", "src_ord", F.slice("__all", 1, keep).alias("versions"), F.size("__all").cast("long").alias("n_stable"))


def curated(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names with a curated entry, whatever their case (aliases: alias, repo, docs_url, trust, latest_ver)."""
    known = aliases.select(F.lower("alias").alias("__key"), "repo", "docs_url", "trust", "latest_ver")
    return names.withColumn("__key", F.lower("name")).join(known, "__key").select(
        "name", "query", paths.clean_id(F.col("name")).alias("id"), "repo", "docs_url", "trust", "latest_ver"
    )


def standard_modules(names: DataFrame, modules: DataFrame) -> DataFrame:
    """Standard-library modules (modules: lang, module, page); a prefix decides, then the query.

    Without prefix a name known to both belongs to Node unless the query speaks of Python.
    """
    prefix = F.substring_index("name", ":", 1)
    asked = names.withColumn("__pre", F.when(F.contains("name", F.lit(":")), prefix)).withColumn(
        "module", F.when(F.contains("name", F.lit(":")), F.substring(F.col("name"), F.length(prefix) + 2, F.length("name"))).otherwise(F.col("name"))
    )
    pages = modules.groupBy("module").agg(
        F.max(F.when(F.col("lang") == "node", F.col("page"))).alias("__node"),
        F.max(F.when(F.col("lang") == "python", F.col("page"))).alias("__py"),
    )
    low = F.lower("query")
    speaks = F.contains(low, F.lit("python")) | F.contains(low, F.lit("import "))
    node, py = F.col("__node").isNotNull(), F.col("__py").isNotNull()
    to_py = py & (~node | F.coalesce(F.col("__pre") == "py", F.lit(False)) | (speaks & ~F.coalesce(F.col("__pre") == "node", F.lit(False))))
    return asked.join(pages, "module").select(
        "name", "query",
        F.concat(F.when(to_py, "py:").otherwise("node:"), F.col("module")).alias("id"),
        F.when(to_py, "python/cpython").otherwise("nodejs/node").alias("repo"),
        F.when(to_py, F.concat(F.lit(PYTHON_DOCS), "__py")).otherwise(F.concat(F.lit(NODE_DOCS), "__node")).alias("docs_url"),
        F.when(to_py, PYTHON_TRUST).otherwise(NODE_TRUST).alias("trust"),
        F.lit("").alias("latest_ver"),
    )


def backfill(candidates: DataFrame, libs: DataFrame) -> DataFrame:
    """Missing version data from the stored libraries."""
    known = libs.filter("coalesce(latest_ver, '') <> ''").select(
        "id", F.col("latest_ver").alias("__ver"),
        F.when(F.size("versions") > 0, F.col("versions")).otherwise(F.array("latest_ver")).alias("__list"),
    )
    df = candidates.join(known, "id", "left")
    new = {
        "latest_ver": F.when(F.col("latest_ver") != "", F.col("latest_ver")).otherwise(F.coalesce("__ver", F.lit(""))),
        "versions": F.when(F.size("versions") > 0, F.col("versions")).otherwise(F.coalesce("__list", F.col("versions"))),
    }
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in candidates.columns])


def rank(candidates: DataFrame) -> DataFrame:
    """Add ``rank`` per name: trust, then source order."""
    order = [F.col("trust").desc(), F.col("src_ord").asc(), F.col("id").asc(), F.col("repo").asc(), F.col("docs_url").asc()]
    return running(candidates, ["name"], order, out="rank")


def query_terms(query: Column) -> Column:
    return tx.boost_terms(query)
