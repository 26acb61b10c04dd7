"""URL and path expressions: canonical forms, crawl filters, priorities, link resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language segments that mark a translated page.
LANGUAGE_SEGMENTS = (
    "en es fr de it ja ko zh pt-br pl ru el ar tr uk cs nl fi sv da no id th vi"
).split()
# Path segments and link parts that never hold documentation.
DENIED_SEGMENTS = ("feeds", "showcase", "plus", "blog")
DENIED_LINK_PARTS = (
    "_static", "_sources", "genindex", "search.html", "404", "whatsnew/", "release/",
)
# Substrings that raise a URL's crawl priority.
FIRST_PARTS = ("/basics", "basics.", "/tutorial", "/getting-started", "/user/")
SECOND_PARTS = ("/reference/", "/guide/", "/api/", "/en/latest/")
CODE_HOST_PREFIXES = ("https://github.com/", "http://github.com/", "https://raw.githubusercontent.com/")

_LEADING_EN = r"^/?en(?=$|/)"


def _cut_tail(path: Column) -> Column:
    """Drop trailing slashes, then one ``.html``."""
    return F.regexp_replace(F.regexp_replace(path, r"/+\z", ""), r"\.html\z", "")


def norm_path(path: Column) -> Column:
    """Canonical page path: no leading ``en`` segment, trailing slash or ``.html``."""
    return _cut_tail(F.regexp_replace(F.trim(path), _LEADING_EN, ""))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def host_of(url: Column) -> Column:
    """Host name in lower case, without user, port and brackets."""
    bare = F.regexp_replace(netloc_of(url), r"^.*@", "")
    v6 = F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(v6 != "", v6).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1)))


def norm_url(url: Column) -> Column:
    """Canonical page URL: scheme and host kept; parameters, query and fragment dropped."""
    last = F.regexp_replace(path_of(url), r";[^/]*\z", "")
    path = F.regexp_replace(_cut_tail(last), _LEADING_EN, "")
    scheme, netloc = scheme_of(url), netloc_of(url)
    head = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""),
    )
    return F.concat(head, F.when(path == "", "/").otherwise(path))


def path_variants(path: Column) -> Column:
    """The spellings under which one page may be stored."""
    base = _cut_tail(path)
    return F.array_distinct(F.array(path, base, F.concat(base, F.lit(".html")), F.concat(base, F.lit("/"))))


def url_allowed(url: Column, base_url: Column) -> Column:
    """Same host, English or unmarked language, no noise segment, no dated article."""
    path = path_of(url)
    language = F.lower(F.regexp_extract(path, rf"(?i)/({'|'.join(LANGUAGE_SEGMENTS)})(?:/|$)", 1))
    noise = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, DENIED_SEGMENTS)))
    return (
        (netloc_of(url) == netloc_of(base_url))
        & language.isin("", "en")
        & ~noise
        & ~F.rlike(path, F.lit(r"/\d{4}/\d{2}/"))
    )


def link_denied(url: Column) -> Column:
    """Crawl links that lead to generated or duplicated material."""
    return F.rlike(url, F.lit("|".join(p.replace(".", r"\.") for p in DENIED_LINK_PARTS)))


def _has_any(url: Column, parts: tuple[str, ...]) -> Column:
    return F.rlike(url, F.lit("|".join(p.replace(".", r"\.") for p in parts)))


def matched_terms(url: Column, terms: Column) -> Column:
    """How many of the query terms the URL contains."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(url), t)))


def crawl_priority(url: Column, terms: Column) -> Column:
    """-1 query match, 0 introductions, 1 reference material, 2 everything else."""
    return (
        F.when(matched_terms(url, terms) > 0, -1)
        .when(_has_any(url, FIRST_PARTS), 0)
        .when(_has_any(url, SECOND_PARTS), 1)
        .otherwise(2)
    )


def is_code_host(url: Column) -> Column:
    """Repository pages, which are not documentation sites."""
    return F.rlike(url, F.lit("^(" + "|".join(p.replace(".", r"\.") for p in CODE_HOST_PREFIXES) + ")"))


def hrefs(html: Column) -> Column:
    """Link targets in document order, without query and fragment."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"#?]+)'), F.lit(1))


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    segments = F.slice(F.split(path, "/", -1), 2, 2_000_000)
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)),
    )
    tail = F.when(last.isin(".", ".."), "/").otherwise("")
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    resolved = F.when(joined == "/", "/").otherwise(F.concat(joined, tail))
    return F.when(F.rlike(path, F.lit(r"/\.\.?(/|\z)")), resolved).otherwise(path)


def url_join(base: Column, ref: Column) -> Column:
    """Resolve a link against the page it stands on."""
    origin = F.concat(scheme_of(base), F.lit("://"), netloc_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*\z", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(F.trim(ref) == "", base)
        .when(scheme_of(ref) != "", ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme_of(base), F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(origin, _resolve_dots(ref)))
        .otherwise(F.concat(origin, _resolve_dots(F.concat(folder, ref))))
    )


def repo_of(url: Column) -> Column:
    """``owner/name`` of a repository URL, without a ``.git`` ending."""
    return F.regexp_replace(F.regexp_extract(url, r"github\.com[/:]([\w.-]+/[\w.-]+)", 1), r"\.git\z", "")


def strip_slashes(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"/+\z", "")


def clean_id(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9-]", "-")
    return F.regexp_replace(dashed, r"^-+|-+\z", "")


def fuzzy_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[._\-]+", "")


def letters_only(name: Column) -> Column:
    """Comparison form used by the evaluation: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
