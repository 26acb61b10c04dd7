from pyspark.sql import functions as F

from folioscope import schema
from folioscope.operators import models
from folioscope.functions import text as tx
from folioscope.plans import libraries
from folioscope.plans.store import Store

PARA = "<p>" + "Words about {0} and how it is used in practice. " * 8 + "</p>"


def page(title, *links):
    body = "".join(f'<a href="{u}">{u}</a>' for u in links)
    return 200, "text/html", f"<html><body><nav>{body}</nav><article><h1>{title}</h1>{PARA.format(title)}</article></body></html>"


def urlset(*urls):
    return 200, "application/xml", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


WEB = {
    "https://list.dev/llms.txt": (200, "text/plain", "# L\n- [A](https://list.dev/alpha)\n- [B](https://list.dev/beta.html)\n- [X](https://other.dev/x)"),
    "https://list.dev/sitemap.xml": urlset("https://list.dev/beta", "https://list.dev/gamma", "https://list.dev/de/gamma"),
    "https://list.dev/alpha": page("alpha routing"), "https://list.dev/beta.html": page("beta storage"), "https://list.dev/gamma": page("gamma sessions"),
    "https://map.dev/sitemap.xml": urlset("https://map.dev/docs/one", "https://map.dev/docs/two"),
    "https://map.dev/docs/one": page("one indexes"), "https://map.dev/docs/two": page("two caches"),
    "https://text.dev/llms.txt": (200, "text/plain", "Plain notes about configuration without any link."),
    "https://raw.githubusercontent.com/o/n/master/README.md": (200, "text/plain", "# Readme\nInstall the widget."),
    "https://crawl.dev/": page("home", "/guide", "/_static/x"), "https://crawl.dev/guide": page("guide queues", "/"),
    "https://github.com/o/none": page("repository page"),
}
LIBS = [("list", "https://list.dev"), ("map", "https://map.dev/docs"), ("text", "https://text.dev"), ("gh", "https://github.com/o/n"), ("crawl", "https://crawl.dev"), ("page", "https://github.com/o/none"), ("gone", "https://gone.dev")]


def web(spark):
    table = spark.createDataFrame([(u, *a) for u, a in WEB.items()], "url string, status int, content_type string, body string")
    return lambda urls: urls.join(table, "url", "left").select("url", F.coalesce("status", F.lit(404)).alias("status"), F.coalesce("content_type", F.lit("")).alias("content_type"), F.lit("").alias("etag"), F.coalesce("body", F.lit("")).alias("body"))


def test_sources_of_seven_libraries(spark):
    libs = spark.createDataFrame([(i, u, 0) for i, u in LIBS], "lib_id string, docs_url string, cap int")
    existing = spark.createDataFrame([("list", "https://list.dev/en/gamma/")], "lib_id string, path string")
    chunks, status, frontier = libraries.ingest_libs(libs, web(spark), existing)
    assert {r["lib_id"]: (r["branch"], r["complete"]) for r in status.collect()} == {
        "list": ("list+sitemap", True), "map": ("sitemap", True), "text": ("list-as-page", True), "gh": ("readme", True),
        "crawl": ("crawl", True), "page": ("single-page", True), "gone": ("single-page", True)}
    got = {(r["lib_id"], r["path"]) for r in chunks.collect()}
    assert got == {
        ("list", "https://list.dev/alpha"), ("list", "https://list.dev/beta"), ("map", "https://map.dev/docs/one"), ("map", "https://map.dev/docs/two"),
        ("text", "https://text.dev/llms.txt"), ("gh", "https://raw.githubusercontent.com/o/n/master/README.md"),
        ("crawl", "https://crawl.dev/"), ("crawl", "https://crawl.dev/guide"), ("page", "https://github.com/o/none")}


def test_a_cap_leaves_the_library_incomplete(spark):
    libs = spark.createDataFrame([("list", "https://list.dev", 2)], "lib_id string, docs_url string, cap int")
    chunks, status, _ = libraries.ingest_libs(libs, web(spark), spark.createDataFrame([], "lib_id string, path string"))
    assert chunks.count() == 2 and not status.first()["complete"]


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path), n_buckets=4)
    blank = {f.name: None for f in schema.LIBS.fields}
    rows = [tuple({**blank, "id": i, "name": i, "docs_url": u, "trust": 9.0, "full": False, "cap": 0, "stable": 0, "versions": []}.values()) for i, u in (LIBS[0], LIBS[4], LIBS[6])]
    store.write("libs", spark.createDataFrame(rows, schema.LIBS))
    assert {r["id"] for r in libraries.due(store, F.current_timestamp()).collect()} == {"list", "crawl", "gone"}
    libraries.refresh_store(store, store.read("libs").select("id"), web(spark))
    first = store.read("chunks").count()
    assert first == 5 and {r["id"]: r["full"] for r in store.read("libs").collect()} == {"list": True, "crawl": False, "gone": False}
    libraries.refresh_store(store, spark.createDataFrame([("list",)], "id string"), web(spark))
    assert store.read("chunks").count() == first  # nothing new, nothing lost
    libraries.embed_missing(store, lambda t: models.hashed_embedding(tx.doc_tokens(t), 16))
    store.build_index()
    assert store.read("chunk_vec").count() == first
    asked = [(0, "list", "gamma sessions", None, ""), (1, "gone", "some question", None, ""), (2, "nobody", "some question", None, ""), (3, "list", "docs", None, "")]
    got = libraries.answer(store, spark.createDataFrame(asked, schema.QUERIES)).collect()
    top = {r["qid"]: r for r in got if r["rank"] == 1}
    assert top[0]["path"] == "https://list.dev/gamma" and [top[q]["title"] for q in (1, 2, 3)] == ["Guidance"] * 3
    assert top[1]["text"] != top[2]["text"]


def test_model_absence_is_reported():
    scorer, reason = models.or_default("/nowhere", "fallback")
    assert scorer == "fallback" and "/nowhere" in reason


def test_command_line_build_and_ask(spark, tmp_path, monkeypatch, capsys):
    from folioscope import __main__ as cli
    (tmp_path / "names.txt").write_text("# libraries\nList\nlist\n")
    (tmp_path / "aliases.json").write_text('{"list": {"repo": "", "docs_url": "https://list.dev/", "trust": 95.0, "latest_ver": "1.0"}}')
    monkeypatch.setattr(cli.http, "fetch", web(spark))
    base = ["--store", str(tmp_path / "s"), "--buckets", "4"]
    cli.main([*base, "build", "--names", str(tmp_path / "names.txt"), "--aliases", str(tmp_path / "aliases.json"), "--force"])
    cli.main([*base, "ask", "list", "gamma sessions"])
    assert "https://list.dev/gamma" in capsys.readouterr().out


def test_report_is_read_back_by_the_gate(spark, tmp_path):
    from folioscope.evaluation import metrics, report
    from folioscope.sources import files
    rows = [(1, "flask", ["a"], 2, 5, 12.4, 80), (2, "vue", ["b"], None, 0, 3.0, 0), (3, "go", [], None, 1, 1.0, 9)]
    scored = spark.createDataFrame(rows, "n int, library string, fragments array<string>, hit_rank int, n_chunks int, ms double, tokens int")
    report.write_report(scored, str(tmp_path / "report"))
    assert tuple(metrics.gate(files.report_rows(spark, str(tmp_path / "report"))).first()) == (1, 2, 50.0, True)


def test_libraries_to_check_follow_their_interval(spark, tmp_path):
    import datetime

    store = Store(spark, str(tmp_path / "store"), n_buckets=4)
    ago = lambda hours: datetime.datetime(2024, 5, 8, 12) - datetime.timedelta(hours=hours)
    kind = "id string, name string, trust double, latest_ver string, versions array<string>, full boolean, etag string, last_check timestamp, stable int"
    rows = [("a", "A", 9.0, "", [], True, "", ago(25), 0), ("b", "B", 9.0, "", [], True, "", ago(25), 1), ("c", "C", None, "", [], True, "", None, None)]
    store.write("libs", spark.createDataFrame(rows, kind))
    now = F.lit("2024-05-08 12:00:00").cast("timestamp")
    assert {r["id"] for r in libraries.to_check(store, now).collect()} == {"a", "c"}
    libraries.check_libs(store, spark.createDataFrame([("a", "", None, "e1")], "id string, latest_ver string, versions array<string>, etag string"), now)
    assert {r["id"] for r in libraries.to_check(store, now).collect()} == {"c"}
