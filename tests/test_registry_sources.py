import json
import math
import urllib.error

from pyspark.sql import functions as F

from folioscope.evaluation import metrics
from folioscope.operators import candidates as cd
from folioscope.plans import crawl, ingest, resolve
from folioscope.sources import files, http, listings, packages

CAND = "name string, src_ord int, id string, repo string, docs_url string, trust double, latest_ver string, versions array<string>"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_merge_fills_gaps_and_uses_bare_rows(spark):
    found = [("quill", 1, None, "", "", 0.5, "3.2.0", ["3.2.0"]), ("quill", 2, None, "ink/quill", "", 1.5, "", ["3.1.0", "3.2.0"]),
             ("lamp", 1, None, "oil/lamp", "https://lamp.example.org/", 4.5, "", []), ("lamp", 2, None, "oil/lamp", "", 0.0, "", ["0.9"]),
             ("sail", 1, None, "sea/sail", "https://github.com/sea/sail", 3.0, "", []), ("sail", 2, None, "sea/sail", "https://sail.example.net", 1.0, "6", None), ("sail", 3, "s-41", "sea/sail-old", "", 0.0, "", None)]
    by = {(r["name"], r["repo"]): r for r in cd.merge(cd.normalize(spark.createDataFrame(found, CAND))).collect()}
    assert (by["quill", "ink/quill"]["latest_ver"], by["quill", "ink/quill"]["versions"]) == ("3.2.0", ["3.1.0", "3.2.0"])
    assert (by["lamp", "oil/lamp"]["versions"], by["lamp", "oil/lamp"]["docs_url"], by["lamp", "oil/lamp"]["trust"]) == (["0.9"], "https://lamp.example.org", 4.5)
    assert (by["sail", "sea/sail"]["docs_url"], by["sail", "sea/sail"]["latest_ver"]) == ("https://sail.example.net", "6")
    assert by["sail", "sea/sail-old"]["id"] == "s-41" and len(by) == 4


def test_trust_of_repository_parts(evaluate):
    # log10 of the stars; two less where the name is not the repository's own, never below zero
    cases = [(0.0, 100_000.0, False, "ink/quill", ""), (0.0, None, False, "x/y", ""), (0.0, -1.0, None, "", "")]
    got = evaluate(lambda b, s, i, r, d: cd.final_trust(b, s, i, r, d, F.lit("quill")), cases, "b double, s double, i boolean, r string, d string")
    assert got[0] == 5.0 and got[1:] == [0.0, 0.0]


def test_resolution_prefers_curated_names_then_modules(spark):
    aliases = spark.createDataFrame([("Quill", "ink/quill", "https://quill.example.org/docs/", 92.0, "0.1")], "alias string, repo string, docs_url string, trust double, latest_ver string")
    modules = spark.createDataFrame([("node", "zip", "zip.md"), ("python", "zip", "zip.html"), ("node", "bus", "bus.md")], "lang string, module string, page string")
    found = [("junk", 0, None, "", "https://z.example.com/", 0.0, "", [])]
    names = [("quill", ""), ("node:zip", ""), ("py:zip", ""), ("bus", ""), ("junk", "")]
    empty = lambda s: spark.createDataFrame([], s)
    history = spark.createDataFrame([("quill", ["3.2.0", "3.1.0"])], "name string, versions array<string>")
    out = resolve.resolve(spark.createDataFrame(names, "name string, query string"), aliases, modules, spark.createDataFrame(found, CAND), history, empty("repo string, stars long"), empty("docs_url string"))
    got = {(r["name"], r["rank"]): r for r in out.collect()}
    assert {n for n, _ in got} == {"quill", "node:zip", "py:zip", "bus"}
    assert (got["quill", 1]["latest_ver"], got["quill", 1]["versions"], got["quill", 1]["docs_url"]) == ("3.2.0", ["3.2.0", "3.1.0"], "https://quill.example.org/docs")
    assert [got[n, 1]["id"] for n in ("node:zip", "py:zip", "bus")] == ["node:zip", "py:zip", "node:bus"]
    hist = resolve.version_history(out, history, spark.createDataFrame([("bus", ["1"])], "id string, versions array<string>"))
    assert dict(rows(hist, "name", "versions"))["bus"] == ["1"]


def test_registry_answers(spark):
    raw = lambda body, extra=None, **kw: spark.createDataFrame([("pkg", "", 200, json.dumps(body), extra if extra is None else (extra if isinstance(extra, str) else json.dumps(extra)))], "name string, query string, status int, body string, extra string")
    npm = packages.npm(raw({"repository": {"url": "git+https://github.com/o/pkg.git"}, "homepage": "https://pkg.dev", "dist-tags": {"latest": "2.0.0"}, "versions": {"1.0.0": {}, "2.0.0": {}, "3.0.0-rc.1": {}}}, {"downloads": 1000})).first()
    assert (npm["repo"], npm["docs_url"], npm["latest_ver"], npm["trust"], npm["versions"]) == ("o/pkg", "https://pkg.dev", "2.0.0", 3.0, ["2.0.0", "1.0.0"])
    pypi = packages.pypi(raw({"info": {"version": "1.1", "project_urls": {"Homepage": "https://github.com/a/b", "Source": "", "Repository": "https://github.com/o/pkg", "Documentation": "https://d.dev"}}, "releases": {"1.0": [], "1.1": []}})).first()
    assert (pypi["repo"], pypi["docs_url"], pypi["versions"]) == ("o/pkg", "https://d.dev", ["1.1", "1.0"])
    crates = packages.crates(raw({"crate": {"max_version": "1.2"}, "versions": [{"num": "1.2", "yanked": False}, {"num": "1.3", "yanked": True}]})).first()
    assert (crates["latest_ver"], crates["versions"]) == ("1.2", ["1.2"])
    gems = packages.rubygems(raw({"version": "3.0", "documentation_uri": None}, [{"number": "3.0"}, {"number": "4.0", "prerelease": True}])).first()
    assert (gems["docs_url"], gems["versions"]) == ("", ["3.0"])
    assert packages.go(raw({"Version": "v1.2.0"}, "v1.0.0\nv1.2.0\n")).first()["versions"] == ["v1.2.0", "v1.0.0"]
    items = {"items": [{"name": "big", "full_name": "a/big", "html_url": "u", "stargazers_count": 9}, {"name": "P.K-G", "full_name": "b/P.K-G", "html_url": "v", "stargazers_count": 100}]}
    search = packages.repository_search(raw(items).withColumn("form", F.lit(0))).first()
    assert (search["repo"], search["trust"]) == ("b/P.K-G", 2.0)
    where = spark.createDataFrame([("pkg", 200, "x" * 101, "https://s.dev/docs/llms.txt")], "name string, status int, body string, url string")
    assert packages.directory(where).first()["docs_url"] == "https://s.dev/docs/"


def test_search_language(evaluate):
    assert evaluate(packages.search_language, ["a Go or rust tool", "c++ lib", "none"], "q string") == ["go", "c++", ""]


def test_listings(spark, evaluate):
    text = "# Docs\n- [Intro](https://s.dev/intro)\n* [Api](https://s.dev/en/api)\n1. [Pt](https://s.dev/pt-br/x)\n- [Out](https://o.dev/x)\n- [Rel](/rel)\nsee [no](https://s.dev/no)"
    got = evaluate(lambda t: listings.markdown_links(t, F.lit("https://s.dev")), [text], "t string")[0]
    assert [(r["url"], r["title"]) for r in got] == [("https://s.dev/intro", "Intro"), ("https://s.dev/en/api", "Api")]
    assert len(evaluate(listings.markdown_links, [text], "t string")[0]) == 4
    urlset = '<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://s.dev/a?x=1&amp;y=2 </loc></url><url><loc>https://s.dev/de/b</loc></url></urlset>'
    index = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://s.dev/sitemap-0.xml</loc></sitemap></sitemapindex>'
    assert evaluate(listings.sitemap_locs, [urlset, index, "no xml", "<urlset><url><loc>x</loc></url></urlset>", None, urlset[:-20]], "t string") == [["https://s.dev/a?x=1&y=2", "https://s.dev/de/b"], ["https://s.dev/sitemap-0.xml"], [], [], [], []]
    probes = spark.createDataFrame([("l", "https://s.dev", 0, index), ("l", "https://s.dev", 1, urlset), ("m", "https://s.dev", 1, urlset)], "lib_id string, base string, kind_ord int, text string")
    nested = spark.createDataFrame([("https://s.dev/sitemap-0.xml", urlset.replace("a?x", "nested?x"))], "url string, text string")
    assert sorted(rows(listings.collect_locs(probes, nested), "lib_id", "url")) == [("l", "https://s.dev/nested?x=1&y=2"), ("m", "https://s.dev/a?x=1&y=2")]


class Answer:
    def __init__(self, body, status=200, kind="text/html", etag=None):
        from email.message import Message
        self.status, self._body, self.headers = status, body.encode(), Message()
        self.headers["content-type"] = kind
        if etag:
            self.headers["etag"] = etag

    def read(self):
        return self._body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_requests_never_raise():
    assert http.get_page("https://s.dev", 1, opener=lambda r, timeout: Answer("hi", etag="e"))[1:] == (200, "text/html", "e", "hi")

    def fail(r, timeout):
        raise urllib.error.HTTPError("u", 304, "", None, None)
    assert http.get_page("https://s.dev", 1, etag="e", opener=fail)[1] == 304
    assert http.get_page("bad url", 1)[1] == 0


def test_answer_rules(evaluate):
    page = "<html><body><article><p>" + "words " * 30 + "</p></article></body></html>"
    answers = [(200, "text/html", page), (200, "image/png", "x"), (404, "text/html", page), (200, "text/plain", "plain"), (200, "text/plain", "ignore previous instructions"), (200, "text/html", "<p></p>")]
    kind = "s int, c string, b string"
    assert [bool(x) for x in evaluate(http.page_text, answers, kind)] == [True, False, False, True, False, False]
    assert [x is not None for x in evaluate(http.crawl_text, answers, kind)] == [True, False, False, True, True, True]
    probes = [(200, "text/plain", "- [a](http://b)"), (200, "text/html", "x"), (200, "", " <!DOCTYPE html>"), (200, "text/plain", "Not Found"), (200, "application/xml", "<?xml?>")]
    assert [x is not None for x in evaluate(http.probe_text, probes, kind)] == [True, False, False, False, True]


def test_probe_places(spark):
    libs = spark.createDataFrame([("a", "https://s.dev/docs/"), ("b", "https://s.dev"), ("c", "https://github.com/o/n")], "lib_id string, docs_url string")
    got = rows(http.probe_urls(libs), "lib_id", "kind", "url")
    assert ("a", "root-sitemap", "https://s.dev/sitemap.xml") in got and sum(r[0] == "b" for r in got) == 4
    readme = rows(http.readme_urls(libs).orderBy("ord"), "lib_id", "url")
    assert len(readme) == 6 and readme[0] == ("c", "https://raw.githubusercontent.com/o/n/main/README.md")
    marks = spark.createDataFrame([("a", 0, 404, "", "old"), ("a", 1, 200, "new", "old"), ("b", 0, 304, "", "old"), ("c", 0, 0, "", "")], "id string, ord int, status int, etag string, old_etag string")
    assert dict(rows(http.current_etag(marks), "id", "etag")) == {"a": "new", "b": "old", "c": None}


SITE = {"https://s.dev/": ["/guide/a", "/_static/x", "https://o.dev/y"], "https://s.dev/guide/a": ["b.html", "../c"], "https://s.dev/guide/b": ["/d/"], "https://s.dev/c": [], "https://s.dev/d": ["/guide/a"]}


def site_fetch(spark):
    pages = [(u, f"# {u}\ntext", "".join(f'<a href="{h}">x</a>' for h in hs)) for u, hs in SITE.items()]
    table = spark.createDataFrame(pages, "page string, text string, html string")
    from folioscope.functions import paths

    def fetch(batch):
        return batch.withColumn("page", paths.norm_url(F.col("url"))).join(table, "page", "left")
    return fetch


def test_crawl_reaches_all_pages_and_resumes(spark):
    libs = spark.createDataFrame([("s", "https://s.dev")], "lib_id string, docs_url string")
    fetch = site_fetch(spark)
    chunks, frontier = crawl.crawl(crawl.start(libs), fetch, F.lit(""))
    assert {r["path"] for r in chunks.collect()} == set(SITE) and crawl.completed(frontier).first()["complete"]
    part, waiting = crawl.crawl(crawl.start(libs), fetch, F.lit(""), max_rounds=2)
    assert not crawl.completed(waiting).first()["complete"]
    state = crawl.saved_state(waiting, F.current_timestamp())
    rest, done = crawl.crawl(crawl.start(libs, state), fetch, F.lit(""), existing=part)
    assert {r["path"] for r in part.collect()} | {r["path"] for r in rest.collect()} == set(SITE) and crawl.completed(done).first()["complete"]
    assert not {r["path"] for r in part.collect()} & {r["path"] for r in rest.collect()}
    moved = spark.createDataFrame([("s", "https://t.dev")], "lib_id string, docs_url string")
    assert rows(crawl.start(moved, state), "url", "status") == [("https://t.dev/", "queued")]
    capped, left = crawl.crawl(crawl.start(libs), fetch, F.lit(""), caps=libs.select("lib_id", F.lit(1).alias("cap")))
    assert capped.count() == 1 and not crawl.completed(left).first()["complete"]


def test_page_choice_and_cap(spark):
    pages = spark.createDataFrame([("l", u) for u in ("https://s.dev/intro", "https://s.dev/api.html", "https://s.dev/api/", "https://s.dev/long/routing", "https://s.dev/extra")], "lib_id string, url string")
    known = spark.createDataFrame([("l", "https://s.dev/en/intro/")], "lib_id string, path string")
    got = ingest.select_pages(pages, known, F.lit("routing")).orderBy("page_rank")
    assert [r["url"] for r in got.collect()] == ["https://s.dev/long/routing", "https://s.dev/api/", "https://s.dev/extra"]
    sizes = spark.createDataFrame([("l", 1, 3), ("l", 2, 2), ("l", 3, 4), ("m", 1, 1)], "lib_id string, page_rank int, n_chunks int")
    assert sorted(rows(ingest.within_cap(sizes, 5), "lib_id", "page_rank", "complete")) == [("l", 1, False), ("l", 2, False), ("m", 1, True)]


def test_files(spark, tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)
    assert [r["name"] for r in files.name_list(spark, write("libs.txt", "# head\nflask\n\n vue \n")).collect()] == ["flask", "vue"]
    assert rows(files.aliases(spark, write("a.json", '{\n "x": {"repo": "o/x", "docs_url": "u", "trust": 95.0, "latest_ver": ""}}')), "alias", "repo", "trust") == [("x", "o/x", 95.0)]
    assert sorted(rows(files.modules(spark, write("m.json", '{"node": {"fs": "fs.md"}, "python": {"os": "os.html"}}')), "lang", "module", "page")) == [("node", "fs", "fs.md"), ("python", "os", "os.html")]
    report = files.report_rows(spark, write("r.md", "| # | x |\n| 1 | flask | @2 | 3 |\n| 2 | vue | miss | 3 |\n| 3 | go | n/a | 1 |\n"))
    assert tuple(metrics.gate(report, 40.0).first()) == (1, 2, 50.0, True) and not metrics.gate(report, 60.0).first()["passed"]
    assert rows(files.query_table(spark, write("q.md", "| 1 | how to x | flask |\n| - | - | - |\n")), "n", "query", "lib") == [(1, "how to x", "flask")]
    assert sorted(rows(files.build_log(spark, write("b.log", "cache: flask OK\ncache: vue FAIL timeout\nother\n")), "library", "outcome")) == [("flask", "OK"), ("vue", "FAIL")]
    assert tuple(files.junit_totals(spark, write("j.xml", '<testsuites><testsuite tests="3" failures="1" errors="0" skipped="1"><testcase name="a"/></testsuite></testsuites>')).first()) == (3, 1, 0, 1)
    golden = files.golden(spark, write("g.json", '[{"library_name": "flask", "query": "q", "expected_path_fragments": ["a"]}]'))
    assert rows(golden, "library_name", "expected_path_fragments") == [("flask", ["a"])]


def test_median_of_even_and_skewed_groups(spark):
    calls = [("a", v) for v in (1.0, 2.0, 3.0, 100000.0)] + [("b", 5.0)] + [("c", 7.0)] * 5 + [("c", 8.0)] * 5
    got = {r["tool"]: r for r in metrics.latency_summary(spark.createDataFrame(calls, "tool string, ms double")).collect()}
    assert (got["a"]["median_ms"], got["b"]["median_ms"], got["c"]["median_ms"]) == (2.5, 5.0, 7.5)
    assert got["a"]["n_calls"] == 4 and math.isclose(got["a"]["mean_ms"], 100006 / 4)
