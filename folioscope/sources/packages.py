"""Package registries: stored JSON answers become candidate rows.

Input rows: name, query, status, body [, extra]. ``extra`` is the second answer some registries need.
Each function returns name, src_ord, id, repo, docs_url, trust, latest_ver, versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, versions as vs

#: Order in which sources win ties.
ORDER = {"directory": 0, "npm": 1, "pypi": 2, "crates": 3, "rubygems": 4, "github": 5, "go": 6}
# Language names a repository search can be narrowed to.
LANGUAGES = "python javascript typescript go rust java kotlin swift ruby php c c++ dart".split()


def _row(df: DataFrame, source: str, *, id=None, repo=None, docs=None, trust=None, latest=None, versions=None) -> DataFrame:
    text = F.lit(None).cast("string")
    return df.select(
        "name", F.lit(ORDER[source]).alias("src_ord"),
        (text if id is None else id).alias("id"), (F.lit("") if repo is None else repo).alias("repo"),
        (F.lit("") if docs is None else F.coalesce(docs, F.lit(""))).alias("docs_url"),
        (F.lit(0.0) if trust is None else trust).alias("trust"),
        (F.lit("") if latest is None else F.coalesce(latest, F.lit(""))).alias("latest_ver"),
        (F.array().cast("array<string>") if versions is None else F.coalesce(versions, F.array().cast("array<string>"))).alias("versions"),
    )


def _json(path: str, column: str = "body") -> Column:
    return F.get_json_object(column, path)


def _stable(versions: Column) -> Column:
    """All final releases: the longest history is chosen before any list is cut."""
    return vs.stable_versions(versions, None)


def _log_trust(count: Column) -> Column:
    return F.log10(F.greatest(F.coalesce(count.cast("double"), F.lit(0.0)), F.lit(1.0)))


def directory(raw: DataFrame) -> DataFrame:
    """A site directory's list file: its final address without the file name. Needs ``url``."""
    ok = raw.filter((F.col("status") == 200) & (F.length("body") > 100))
    return _row(ok, "directory", docs=F.regexp_replace("url", r"llms\.txt\z", ""))


def npm(raw: DataFrame) -> DataFrame:
    """``extra`` holds the monthly downloads."""
    place = F.coalesce(F.nullif(_json("$.repository.url"), F.lit("")), F.nullif(_json("$.repository"), F.lit("")), _json("$.homepage"), F.lit(""))
    names = F.json_object_keys(_json("$.versions"))
    return _row(
        raw.filter("status = 200"), "npm", repo=paths.repo_of(place), docs=_json("$.homepage"),
        trust=_log_trust(_json("$.downloads", "extra")), latest=_json("$['dist-tags'].latest"), versions=_stable(names),
    )


def pypi(raw: DataFrame) -> DataFrame:
    urls = F.from_json(_json("$.info.project_urls"), "map<string,string>")

    def link(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at(urls, F.lit(k)), F.lit("")) for k in keys], F.lit(""))

    repo = F.regexp_extract(link("Source", "Source Code", "Repository", "Homepage"), r"github\.com[/:]([\w.-]+/[\w.-]+)", 1)
    return _row(
        raw.filter("status = 200"), "pypi", repo=repo, docs=link("Documentation"), latest=_json("$.info.version"),
        versions=_stable(F.json_object_keys(_json("$.releases"))),
    )


def crates(raw: DataFrame) -> DataFrame:
    rows = F.from_json(_json("$.versions"), "array<struct<num:string,yanked:boolean>>")
    good = F.transform(F.filter(rows, lambda v: ~F.coalesce(v["yanked"], F.lit(False))), lambda v: v["num"])
    return _row(raw.filter("status = 200"), "crates", latest=_json("$.crate.max_version"), versions=_stable(good))


def go(raw: DataFrame) -> DataFrame:
    """``extra`` holds the plain version list."""
    listed = F.filter(F.split(F.coalesce("extra", F.lit("")), r"\s+"), lambda v: v != "")
    return _row(raw.filter("status = 200"), "go", latest=_json("$.Version"), versions=_stable(listed))


def rubygems(raw: DataFrame) -> DataFrame:
    """``extra`` holds the version array."""
    rows = F.from_json("extra", "array<struct<number:string,yanked:boolean,prerelease:boolean>>")
    good = F.transform(
        F.filter(rows, lambda v: ~F.coalesce(v["yanked"], F.lit(False)) & ~F.coalesce(v["prerelease"], F.lit(False))),
        lambda v: v["number"],
    )
    return _row(raw.filter("status = 200"), "rubygems", docs=_json("$.documentation_uri"), latest=_json("$.version"), versions=_stable(good))


def search_language(query: Column) -> Column:
    """First language name among the query's words, or an empty string."""
    words = F.regexp_extract_all(F.lower(query), F.lit("[A-Za-z+#]+"), F.lit(0))
    return F.coalesce(F.get(F.filter(words, lambda w: w.isin(*LANGUAGES)), F.lit(0)), F.lit(""))


def repository_search(raw: DataFrame) -> DataFrame:
    """Repository search: per answer the item of that very name, else the first; the narrow form first.

    Rows: name, form (0 narrow, 1 wide), status, body. Names with a namespace are not searched.
    """
    item = "struct<name:string,full_name:string,html_url:string,stargazers_count:long>"
    items = F.from_json(_json("$.items"), f"array<{item}>")
    asked = raw.filter((F.col("status") == 200) & ~F.rlike("name", F.lit("[:/]")))
    wanted = paths.fuzzy_name(F.col("name"))
    found = asked.withColumn("__items", items).filter(F.size("__items") > 0).withColumn(
        "__same", F.filter("__items", lambda i: paths.fuzzy_name(i["name"]) == wanted)
    ).withColumn("__pick", F.coalesce(F.get("__same", F.lit(0)), F.get("__items", F.lit(0))))
    base = F.element_at(F.split("__pick.full_name", "/"), -1)
    best = found.groupBy("name").agg(
        F.min_by("__pick", F.struct((paths.fuzzy_name(base) != wanted).alias("other"), F.col("form"))).alias("p")
    )
    return _row(best, "github", repo=F.col("p.full_name"), docs=F.col("p.html_url"), trust=_log_trust(F.col("p.stargazers_count")))


SOURCES = {
    "directory": directory, "npm": npm, "pypi": pypi, "crates": crates, "rubygems": rubygems,
    "github": repository_search, "go": go,
}
