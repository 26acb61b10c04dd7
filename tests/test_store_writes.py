import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import hashing
from folioscope.operators import freshness, neardup, upsert
from folioscope.plans.store import lib_stats, pick_release
from folioscope.streaming import flows
from folioscope.plans.store import Store
from tests.test_text import python_simhash


def flipped(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value - 2**64 if value >= 2**63 else value


def cluster_rows(seed, n):
    """Fingerprints in tight and loose groups, with exact copies."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and rows:
            rows.append((rng.choice(["a", "b"]), rows[rng.randrange(len(rows))][1], i))
        else:
            rows.append((rng.choice(["a", "a", "b"]), flipped(rng, rng.choice(centres), rng.choice([0, 1, 3, 5, 8, 12])), i))
    return rows


def greedy(rows, known=()):
    kept = {}
    for lib, h in known:
        kept.setdefault(lib, []).append(h)
    out = set()
    for lib, h, _ in sorted(rows, key=lambda r: r[2]):
        if all(((h ^ o) & (2**64 - 1)).bit_count() > 6 for o in kept.setdefault(lib, [])):
            kept[lib].append(h)
            out.add((lib, h))
    return out


@pytest.mark.parametrize("finish_rows", [0, 20, 10_000])
def test_leaders_match_the_sequential_rule(spark, finish_rows):
    rows = cluster_rows(2, 150)
    known = [("a", rows[3][1]), ("b", flipped(random.Random(1), rows[10][1], 4))]
    df = spark.createDataFrame(rows, "lib_id string, simhash long, ord long")
    got = neardup.keep_leaders(df, spark.createDataFrame(known, "lib_id string, simhash long"), finish_rows)
    assert {tuple(r) for r in got.collect()} == greedy(rows, known)


def test_every_block_plan_is_exact(spark):
    rng = random.Random(8)
    pairs = [(flipped(rng, v := rng.getrandbits(64), 0), flipped(rng, v, d)) for d in range(7) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for plan in ((7, 1), (8, 2), (9, 3), (10, 4)):
        met = F.arrays_overlap(neardup.block_keys(F.col("a"), *plan), neardup.block_keys(F.col("b"), *plan))
        assert df.filter(~met).count() == 0
    assert [neardup.block_plan(n) for n in (10, 10**6, 10**8, 10**10)] == [(7, 1), (8, 2), (9, 3), (10, 4)]


LONG = " ".join(f"paragraph {w} explains routing of requests to handlers" for w in "one two three four five six seven eight nine ten".split())
OTHER = " ".join(f"storage engine number {i} keeps pages sorted by key on disk" for i in range(12))
CHUNKS = "chunk_id long, lib_id string, ver string, path string, title string, text string, fetched_at timestamp, simhash long"
INCOMING = "ord long, lib_id string, ver string, path string, title string, text string, fetched_at timestamp"


def test_add_chunks_drops_copies_and_replaces_pages(spark):
    assert len(LONG) >= hashing.MIN_CHARS
    stored = spark.createDataFrame([(5, "f", "", "/en/old.html", "T", OTHER, None, python_simhash(OTHER)), (6, "f", "", "/x/", "T", "short", None, None), (7, "g", "", "/x", "T", "other lib", None, None)], CHUNKS)
    incoming = [(0, "f", "3", "/similar", "T", LONG, None), (1, "f", "3", "/already", "T", LONG.replace("ten", "tin"), None), (2, "f", "3", "/x.html", "T", "short", None),
                (3, "f", "3", "/copy", "T", OTHER, None), (4, "g", "3", "/other", "T", OTHER, None), (5, "f", "3", "/tiny", "T", "short", None)]
    got = upsert.add_chunks(stored, spark.createDataFrame(incoming, INCOMING)).collect()
    assert sorted((r["lib_id"], r["path"]) for r in got) == [("f", "/en/old.html"), ("f", "/similar"), ("f", "/tiny"), ("f", "/x.html"), ("g", "/other"), ("g", "/x")]
    ids = [r["chunk_id"] for r in got]
    assert len(set(ids)) == len(ids) and min(r["chunk_id"] for r in got if r["ver"] == "3") > 7


def test_a_page_may_be_written_again_with_the_same_text(spark):
    stored = spark.createDataFrame([(1, "f", "", "/en/p.html", "T", LONG, None, python_simhash(LONG))], CHUNKS)
    again = spark.createDataFrame([(0, "f", "4", "/en/p", "T", LONG, None)], INCOMING)
    assert [(r["path"], r["ver"]) for r in upsert.add_chunks(stored, again).collect()] == [("/en/p", "4")]


def test_prune_keeps_other_libraries(spark):
    rows = [(1, "f", "/en/a.html"), (2, "f", "/b"), (3, "g", "/b")]
    df = spark.createDataFrame(rows, "chunk_id long, lib_id string, path string")
    out = upsert.prune_chunks(df, spark.createDataFrame([("f", "/a")], "lib_id string, path string"), spark.createDataFrame([("f",)], "lib_id string"))
    assert sorted(r["chunk_id"] for r in out.collect()) == [1, 3]


LIBS = "id string, name string, repo string, docs_url string, trust double, latest_ver string, versions array<string>, full boolean, etag string, last_check timestamp, stable int"


def lib(**kw):
    row = dict(id="f", name="F", repo="o/f", docs_url="https://f.dev", trust=95.0, latest_ver="3.0.0", versions=["3.0.0"], full=True, etag="", last_check=None, stable=0)
    row.update(kw)
    return tuple(row.values())


def test_freshness_probe(spark):
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    libs = spark.createDataFrame([lib(id="new"), lib(id="first"), lib(id="same", etag="e1", stable=2), lib(id="changed", etag="e1", stable=2), lib(id="quiet"), lib(id="failed", etag="e1")], LIBS)
    checks = spark.createDataFrame([("new", "3.1.0", ["3.1.0"], "e"), ("first", "", None, "e1"), ("same", "3.0.0", None, "e1"), ("changed", "", None, "e2"), ("failed", "", None, None)], "id string, latest_ver string, versions array<string>, etag string")
    got = {r["id"]: r for r in freshness.apply_check(libs, checks, now).collect()}
    assert (got["new"]["latest_ver"], got["new"]["full"], got["new"]["stable"]) == ("3.1.0", False, 0)
    assert (got["first"]["etag"], got["first"]["full"], got["first"]["stable"]) == ("e1", True, 0)
    assert (got["same"]["stable"], got["same"]["full"]) == (3, True)
    assert (got["changed"]["etag"], got["changed"]["full"], got["changed"]["stable"]) == ("e2", False, 0)
    assert got["quiet"]["last_check"] is None and got["failed"]["last_check"] is not None and got["failed"]["etag"] == "e1"


def test_intervals(spark):
    def ask(expr):
        return spark.range(1).select(expr.alias("x")).first()["x"]
    now = F.lit("2024-05-08 12:00:00").cast("timestamp")
    at = lambda t: F.lit(t)
    assert ask(freshness.recrawl_allowed(at(""), at("2024-01-01 00:00:00"), now)) is True
    assert ask(freshness.recrawl_allowed(at("2024-05-08 11:30:00"), at("2024-01-01 00:00:00"), now, True)) is False
    assert ask(freshness.recrawl_allowed(at("garbage"), at("2024-05-08 00:00:00"), now)) is False
    assert ask(freshness.recrawl_allowed(at(""), at("2024-05-08 00:00:00"), now, True)) is True
    assert ask(freshness.recrawl_allowed(at(""), F.lit(None), now)) is True
    for stable, last, due in ((0, "2024-05-07 11:00:00", True), (1, "2024-05-07 11:00:00", False), (2, "2024-05-04 11:00:00", True), (9, "2024-05-01 13:00:00", False), (9, "2024-05-01 11:00:00", True)):
        assert ask(freshness.refresh_due(at(last), F.lit(95.0), F.lit(stable), now)) is due
    assert ask(freshness.refresh_due(at("bad"), F.lit(1.0), F.lit(0), now)) is True


def test_moved_docs_and_expiry(spark):
    libs = spark.createDataFrame([lib(id="a"), lib(id="b", docs_url="")], LIBS)
    seen = spark.createDataFrame([("a", "https://new.dev", ""), ("b", "", "o/f")], "id string, docs_url string, repo string")
    got = {r["id"]: (r["docs_url"], r["full"]) for r in freshness.docs_moved(libs, seen).collect()}
    assert got == {"a": ("https://new.dev", False), "b": ("", True)}
    cache = spark.createDataFrame([("x", "2024-05-01 00:00:00"), ("y", "2024-05-01 00:59:00")], "k string, t string").select("k", F.col("t").cast("timestamp").alias("cached_at"))
    assert [r["k"] for r in freshness.unexpired(cache, F.lit("2024-05-01 01:30:00").cast("timestamp")).collect()] == ["y"]


def test_release_choice_and_stats(spark):
    kind = "tag_name string, created_at string, assets array<struct<name:string,size:long>>"
    rows = [("manual", "2026-09-03", [("docs.db", 1)]), ("old", "2026-08-01", [("cache.gz", 2)]), ("new", "2026-08-03", [("x", 0), ("cache.gz", 3)])]
    got = pick_release(spark.createDataFrame(rows, kind), "cache.gz").collect()
    assert [(r["tag_name"], r["asset"]["size"]) for r in got] == [("new", 3)]
    assert pick_release(spark.createDataFrame(rows[:1], kind), "cache.gz").count() == 0
    df = spark.createDataFrame([("l", "/a", 1), ("l", "/a", 2), ("l", "/b", 1)], "lib_id string, path string, t long").select("lib_id", "path", F.timestamp_seconds("t").alias("fetched_at"))
    assert tuple(lib_stats(df).select("n_chunks", "n_paths").first()) == (3, 2)


def test_streamed_ingest_replaces_pages_and_survives_replay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), n_buckets=4)
    source = str(tmp_path / "pages")

    def drop(rows):
        spark.createDataFrame(rows, flows.RAW_PAGES).coalesce(1).write.mode("append").parquet(source)

    def run():
        q = flows.start_ingest(store, flows.raw_pages(spark, source), str(tmp_path / "cp"))
        q.awaitTermination()

    page = "<html><body><article><h1>{t}</h1><p>{b}</p></article></body></html>"
    drop([("f", "1", "https://f.dev/en/a.html", page.format(t="A", b=LONG)), ("f", "1", "https://f.dev/b", page.format(t="B", b=LONG))])
    run()
    assert [r["path"] for r in store.read("chunks").collect()] in (["https://f.dev/a"], ["https://f.dev/b"])
    drop([("f", "2", "https://f.dev/a", page.format(t="A2", b=OTHER))])
    run()
    now = {r["path"]: r["ver"] for r in store.read("chunks").collect()}
    assert now["https://f.dev/a"] == "2"
    before = store.newest("chunks")["version"]
    flows.ingest_batch(store, spark.createDataFrame([], flows.RAW_PAGES), 1)
    assert store.newest("chunks")["version"] == before


def test_activity_log_round_trip(spark, tmp_path):
    log, copy = str(tmp_path / "log"), str(tmp_path / "copy")
    flows.log_activity(spark.createDataFrame([("get_docs", "f", "q", '["/a"]')], "tool string, lib string, q string, top string"), log)
    flows.append_activity(flows.activity_stream(spark, log), copy, str(tmp_path / "cp")).awaitTermination()
    from folioscope.sources import files
    row = files.activity(spark, copy).first()
    assert (row["tool"], row["lib"], row["top"]) == ("get_docs", "f", '["/a"]')


def test_index_follows_writes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), n_buckets=4)
    rows = [(1, "f", "", "/a", "T", "zebra stripes are black", None, None), (2, "f", "", "/b", "T", "lions sleep at noon", None, None), (3, "g", "", "/c", "T", "zebra crossing", None, None)]
    libs = spark.createDataFrame([("f",)], "id string")
    store.write("chunks", spark.createDataFrame(rows, CHUNKS))
    with pytest.raises(ValueError, match="build_index"):
        store.get_docs_one("f", "zebra stripes")
    store.build_index()
    store.write("chunk_vec", spark.createDataFrame([(1, "f", [1.0, 0.0]), (2, "f", [0.0, 1.0])], "chunk_id long, lib_id string, embedding array<float>"))
    touched = store.buckets_of(libs, "id")
    new = [(4, "f", "", "/d", "T", "a quagga is a zebra too", None, None)]
    after = store.read("chunks", touched).filter("chunk_id <> 1").unionByName(spark.createDataFrame(new, CHUNKS))
    store.write_chunks(after, touched)
    assert store.index_is_current()
    assert [r["path"] for r in store.get_docs_one("f", "zebra quagga").collect()] == ["/d"]
    assert [r["chunk_id"] for r in store.read("chunk_vec").collect()] == [2]
    followed = {t: sorted(map(tuple, store.read(t).collect()), key=repr) for t in ("postings", "terms", "corpus_stats")}
    store.build_index()
    assert followed == {t: sorted(map(tuple, store.read(t).collect()), key=repr) for t in followed}


def page_rows(ids, text, path="/p{}"):
    return [(i, "f" if i % 3 else "g", "", path.format(i), "T", text.format(i), None, None) for i in ids]


def contents(store):
    return {t: sorted(map(tuple, store.read(t).collect()), key=repr) for t in ("chunks", "chunk_vec", "postings", "terms", "corpus_stats")}


def test_a_page_costs_the_rows_of_a_page(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), n_buckets=4)
    store.FAN, store.HIDDEN_LEAST = 3, 6
    df = lambda rows: spark.createDataFrame(rows, CHUNKS)
    every = list(range(4))
    now = page_rows(range(40), "the common words of page number{0}")
    store.write("chunks", df(now))
    store.build_index()
    store.write("chunk_vec", spark.createDataFrame([(i, "f" if i % 3 else "g", [1.0, float(i)]) for i in range(40)], "chunk_id long, lib_id string, embedding array<float>"))
    for turn in range(5):
        # one page is replaced, one goes
        now = [r for r in now if r[0] not in (turn, 20 + turn)] + page_rows([100 + turn], "the common quagga{0} words")
        before = {r["path"] for r in store.versions().collect()}
        store.write_chunks(df(now), every)
        written = {t: [r["n_rows"] for r in store.versions().collect() if r["table_name"] == t and r["path"] not in before and not r["replaces"] and r["delta"]]
                   for t in ("chunks", "postings", "terms")}
        if turn < 2:  # later turns fold and clean up as well
            assert written["chunks"] == [1] and written["postings"] == [5] and written["terms"][0] <= 12
        assert store.index_is_current() and store.last_id() == 100 + turn
        assert [r["path"] for r in store.get_docs_one("f" if (100 + turn) % 3 else "g", f"quagga{100 + turn}").collect()] == [f"/p{100 + turn}"]
        assert store.get_docs_one("g", "number0").collect() == []
        assert {r["chunk_id"] for r in store.read("chunk_vec").collect()} == {r[0] for r in now if r[0] < 100}
    followed = contents(store)
    live = store._live("postings", "chunks")
    assert len(live["postings"]) < 5 and len(store._hidden("chunks", live)) == 1  # folded, and cleaned up once
    assert followed["chunks"] == sorted(now, key=repr)
    store.build_index()
    assert followed == contents(store)
    store.append("chunk_vec", spark.createDataFrame([(104, "f", [0.0, 1.0])], "chunk_id long, lib_id string, embedding array<float>"))
    assert 104 in {r["chunk_id"] for r in store.read("chunk_vec").collect()}


def test_a_chunk_changed_under_its_id_and_a_new_start(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), n_buckets=4)
    df = lambda rows: spark.createDataFrame(rows, CHUNKS)
    store.write_chunks(df(page_rows([1, 2, 3], "first text {0}")), list(range(4)))
    store.build_index()
    store.write_chunks(df(page_rows([2, 3], "first text {0}")), list(range(4)))
    store.write_chunks(df(page_rows([2, 3], "second text {0}")), list(range(4)))
    assert [r["path"] for r in store.get_docs_one("f", "second").collect()] == ["/p2"] and store.get_docs_one("f", "first").collect() == []
    store.write("chunks", df(page_rows([1, 2], "third text {0}")))  # ids that were hidden once are whole again
    assert sorted(r["chunk_id"] for r in store.read("chunks").collect()) == [1, 2]
