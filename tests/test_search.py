import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folioscope.functions import vectors as vc
from folioscope.operators import fusion, hits as ht, lexical, nearest
from folioscope.plans import retrieval
from folioscope.plans.store import Store
from folioscope import schema

WORDS = "route view table index query cache session token merge stream café a_b".split()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS + ["the"] * 4 + ["a b"]) for _ in range(rng.randint(1, 40)))
        rows.append((i, f"lib{i % 2}", rng.choice(["", "3.1.0", "2.3.0"]), rng.choice([f"/en/p{i // 2}.html", f"/p{i // 2}/", f"p{i}"]), "t", text))
    return rows


CHUNKS = "chunk_id long, lib_id string, ver string, path string, title string, text string"
QUERY_ROWS = [(0, "lib0", "route view", [1.0, 0.0], ""), (1, "lib1", "the Index the", None, ""), (2, "lib0", "a_b café", [0.0, 1.0], "3.1.0"), (3, "lib1", "zebra", None, ""), (4, "lib0", "__ !", None, "")]
QUERIES = "qid long, lib_id string, query string, query_vec array<float>, version string"


def plain(text):
    return text.lower().replace("é", "e")


def bm25(rows, lib, query):
    """Scores and full-match flags by counting, phrases as adjacent tokens."""
    docs = {r[0]: re.findall("[a-z0-9]+", plain(r[5])) for r in rows}
    libs = {r[0]: r[1] for r in rows}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    units = [[p for p in w.lower().split("_") if p] for w in re.findall("[A-Za-z0-9_]+", query)]
    units = [tuple(u) for u in units if u]

    def tf(tokens, unit):
        return sum(tuple(tokens[i:i + len(unit)]) == unit for i in range(len(tokens)))

    df = {u: sum(tf(t, u) > 0 for t in docs.values()) for u in set(units)}
    out = {}
    for cid, tokens in docs.items():
        if libs[cid] != lib:
            continue
        score, hit = 0.0, set()
        for u in units:
            f = tf(tokens, u)
            if f:
                hit.add(u)
                idf = math.log((n - df[u] + 0.5) / (df[u] + 0.5))
                score += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(tokens) / mean))
        if hit:
            out[cid] = (score, hit == set(units))
    return out


def top(scores, full_only, k=20):
    keep = [(c, s) for c, (s, full) in scores.items() if full or not full_only]
    return [c for c, _ in sorted(keep, key=lambda x: (-round(x[1], 9), x[0]))[:k]]


def test_bm25_counts_phrases_and_accents(spark):
    rows = corpus()
    got = lexical.search_documents(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(QUERY_ROWS, QUERIES)).collect()
    for qid, lib, query, *_ in QUERY_ROWS:
        want = bm25(rows, lib, query)
        mine = [r for r in got if r["qid"] == qid]
        assert [r["chunk_id"] for r in sorted((r for r in mine if r["or_rank"]), key=lambda r: r["or_rank"])] == top(want, False)
        assert [r["chunk_id"] for r in sorted((r for r in mine if r["and_rank"]), key=lambda r: r["and_rank"])] == top(want, True)
        for r in mine:
            assert math.isclose(r["score"], want[r["chunk_id"]][0], rel_tol=1e-12)


def test_or_finds_partial_matches(spark):
    rows = [(0, "l", "", "a", "t", "alpha beta"), (1, "l", "", "b", "t", "alpha only"), (2, "l", "", "c", "t", "none")]
    found = retrieval.search(spark.createDataFrame([(0, "l", "alpha beta", None, "")], QUERIES), spark.createDataFrame(rows, CHUNKS))
    assert [r["id"] for r in found.orderBy("rank").collect()] == [0, 1]


def test_relative_threshold_both_metrics(spark):
    p, m, n = [1.0, 0.0], [0.5, 0.0], [-1.0, 0.0]
    vectors = spark.createDataFrame([(0, "l", p), (1, "l", m), (2, "l", n)], "chunk_id long, lib_id string, embedding array<float>")
    q = spark.createDataFrame([(0, "l", "x", p, "")], QUERIES)
    for metric in ("l2", "cosine"):
        rows = nearest.flag_weak(nearest.nearest(q, vectors, metric), metric).orderBy("vec_rank").collect()
        assert [(r["chunk_id"], r["weak"]) for r in rows] == [(0, False), (1, False), (2, True)]
    far = spark.createDataFrame([(0, "l", n)], "chunk_id long, lib_id string, embedding array<float>")
    assert nearest.flag_weak(nearest.nearest(q, far, "l2"), "l2").first()["weak"]
    assert not nearest.flag_weak(nearest.nearest(q, far, "cosine"), "cosine").first()["weak"]


def test_neighbours_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BROADCAST_VECTORS", 10)
    monkeypatch.setattr(nearest, "AT_ONCE", 3)
    rng = random.Random(4)
    point = lambda: [float(rng.randint(-3, 3)) for _ in range(3)]  # noqa: E731  # small grid: many ties, some zeros
    vectors = spark.createDataFrame(
        [(i, "l" if i % 3 else "m", point()) for i in range(300)] + [(900, "l", None), (901, "l", [1.0]), (902, "l", [float("nan")] * 3), (903, None, point())],
        "chunk_id long, lib_id string, embedding array<float>").repartition(3)
    q = spark.createDataFrame(
        [(i, "lmz"[i % 3], "x", point(), "") for i in range(25)] + [(90, "l", "x", None, ""), (91, None, "x", point(), "")], QUERIES)
    for metric in ("l2", "cosine"):
        far = vc.distance(F.col("embedding"), F.col("query_vec"), metric)
        pairs = vectors.where("chunk_id < 900").join(q, "lib_id").select("qid", "chunk_id", far.alias("d")).where("d IS NOT NULL").collect()
        want = {}
        for r in sorted(pairs, key=lambda r: (round(r["d"], 9), r["chunk_id"])):
            want.setdefault(r["qid"], []).append(r["chunk_id"])
        got = {}
        for r in nearest.nearest(q, vectors, metric, top=7).orderBy("qid", "vec_rank").collect():
            got.setdefault(r["qid"], []).append(r["chunk_id"])
        assert got == {qid: ids[:7] for qid, ids in want.items()}
    assert nearest.nearest(q.limit(0), vectors).isEmpty() and nearest.nearest(q, vectors.limit(0)).isEmpty()


def fused_by_hand(ranked, weak, k):
    scores, first = {}, {}
    for pos, cid in enumerate(ranked):
        first.setdefault(cid, pos)
        scores[cid] = scores.get(cid, 0.0) + 1.0 / (k + len(scores))
    return {c: (s, first[c]) for c, s in scores.items() if c not in weak}


def hybrid_by_hand(rows, vectors, query, k):
    qid, lib, text, vec, version = query
    scores = bm25(rows, lib, text)
    full = top(scores, True)
    ranked = full + [c for c in top(scores, False) if c not in full]
    weak = set()
    if vec:
        def cos(a):
            return sum(x * y for x, y in zip(a, vec)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in vec))
        near = sorted(((1 - cos(v), c) for c, l, v in vectors if l == lib), key=lambda x: (round(x[0], 9), x[1]))[:20]
        if near and 1 - near[0][0] > 0:
            weak = {c for d, c in near if 1 - d < 0.5 * (1 - near[0][0])}
        ranked += [c for _, c in near]
    fused = fused_by_hand(ranked, weak, 60)
    order = sorted(fused, key=lambda c: (-round(fused[c][0], 12), fused[c][1]))[: 3 * k if version else k]
    by_id = {r[0]: r for r in rows}
    if version:
        order = [c for c in order if by_id[c][2] in (version, "")]
        order.sort(key=lambda c: by_id[c][2] != version)
    pages, out = set(), []
    for c in order:
        page = re.sub(r"\.html$", "", re.sub(r"^/?en(?=/|$)", "", by_id[c][3]).rstrip("/"))
        if page not in pages:
            pages.add(page)
            out.append((c, round(fused[c][0], 4)))
    return out[:k]


def test_hybrid_search_matches_a_walk_over_lists(spark):
    rows = corpus(4, 90)
    rng = random.Random(9)
    vectors = [(i, f"lib{i % 2}", [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(0, 90, 2)] + [(i, "lib1", [1.0, rng.random()]) for i in range(1, 30, 4)]
    found = retrieval.search(
        spark.createDataFrame(QUERY_ROWS, QUERIES), spark.createDataFrame(rows, CHUNKS),
        spark.createDataFrame(vectors, "chunk_id long, lib_id string, embedding array<float>"), k=5).collect()
    for query in QUERY_ROWS:
        mine = sorted((r for r in found if r["qid"] == query[0]), key=lambda r: r["rank"])
        want = hybrid_by_hand(rows, vectors, query, 5)
        assert [r["id"] for r in mine] == [c for c, _ in want]
        assert all(abs(r["score"] - s) < 1.01e-4 for r, (_, s) in zip(mine, want))


def test_fusion_counts_distinct_ids_ahead(spark):
    ranked = spark.createDataFrame([(0, c, b, r, False) for b, r, c in [(0, 1, 5), (0, 2, 7), (2, 1, 7), (2, 2, 9), (2, 3, 5)]], "qid long, chunk_id long, branch int, rank int, weak boolean")
    got = {r["chunk_id"]: r["score"] for r in fusion.fuse(fusion.list_positions(ranked)).collect()}
    want = fused_by_hand([5, 7, 7, 9, 5], set(), 60)
    assert got.keys() == want.keys() and all(math.isclose(got[c], want[c][0]) for c in got)


def test_budget(spark):
    def lengths(texts):
        df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "qid long, rank int, text string")
        return [len(r["text"]) for r in ht.trim_to_budget(df).orderBy("rank").collect()]
    assert lengths(["x" * 20000, "ok"]) == [12000]
    assert lengths(["x" * 7000, "y" * 6000, "z" * 100]) == [7000, 5000]
    assert lengths(["", "a"]) == [0, 1]


def test_rerank_moves_better_overlap_up_and_leaves_the_tail(spark):
    rows = [(0, 1, "alpha", 0.9, "alpha beta"), (0, 2, "alpha beta", 0.8, "alpha beta"), (0, 3, "none", 0.7, "alpha beta"), (1, 1, "x", 0.5, "q")]
    df = spark.createDataFrame(rows, "qid long, rank int, text string, score double, query string")
    got = [(r["qid"], r["text"], r["score"]) for r in ht.rerank(df, top_n=2).orderBy("qid", "rank").collect()]
    assert got == [(0, "alpha beta", 1.0), (0, "alpha", 0.5), (0, "none", 0.7), (1, "x", 0.5)]


def test_get_docs_guidance_and_empty(spark):
    rows = corpus(2, 20)
    asked = [(0, "lib0", "route view", None, ""), (1, "lib0", "docs", None, ""), (2, "lib0", "  ", None, ""), (3, "lib0", "xy", None, "")]
    got = retrieval.get_docs(spark.createDataFrame(asked, QUERIES), spark.createDataFrame(rows, CHUNKS)).collect()
    assert {r["qid"] for r in got} == {0, 1, 3}
    assert [r["title"] for r in got if r["qid"] in (1, 3)] == ["Guidance", "Guidance"]
    assert sum(r["qid"] == 0 for r in got) <= 10


def test_stored_index_gives_the_same_answers(spark, tmp_path):
    rows = corpus(6, 50)
    store = Store(spark, str(tmp_path))
    store.write("chunks", spark.createDataFrame(rows, CHUNKS), sort=("lib_id", "chunk_id"))
    store.build_index()
    queries = spark.createDataFrame(QUERY_ROWS, QUERIES)
    a = store.search(queries, k=5).orderBy("qid", "rank").collect()
    b = retrieval.search(queries, spark.createDataFrame(rows, CHUNKS), k=5).orderBy("qid", "rank").collect()
    assert a == b and a
    one = store.get_docs_one("lib0", "route view").collect()
    assert [r["rank"] for r in one] == list(range(1, len(one) + 1))


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("libs").count() == 0
    old = spark.createDataFrame([("a", "A", "", "", 1.0, "", ["1"])], "id string, name string, repo string, docs_url string, trust double, latest_ver string, versions array<string>")
    assert store.write("libs", old) == 1
    assert store.read("libs").columns == schema.LIBS.names and store.read("libs").first()["full"] is True
    assert store.write("libs", store.read("libs").filter("id = 'b'")) == 2 and store.read("libs").count() == 0
    store.rollback("libs", 1)
    assert [r["version"] for r in store.versions_of("a").collect()] == ["1"]
    try:
        store.write("libs", old.limit(0), least_rows=1)
        raise AssertionError("published an empty table")
    except ValueError:
        assert store.read("libs").count() == 1


def test_partial_versions_replace_single_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path), n_buckets=4)
    store.MAX_PARTS = 2
    rows = [(i, f"lib{i}", "", f"/p{i}", "t", "old") for i in range(12)]
    store.write("chunks", spark.createDataFrame(rows, CHUNKS))
    now = {r[1]: "old" for r in rows}
    for turn in range(4):
        lib = f"lib{turn * 2}"
        touched = store.buckets_of(spark.createDataFrame([(lib,)], "lib_id string"))
        part = store.read("chunks", touched)
        assert 0 < part.count() < 12
        text = f"new {turn}"
        changed = part.filter(f"lib_id <> '{lib}'").unionByName(part.filter(f"lib_id = '{lib}'").selectExpr(*[f"'{text}' AS text" if c == "text" else c for c in part.columns]))
        store.write("chunks", changed, only=touched)
        now[lib] = text
        assert {r["lib_id"]: r["text"] for r in store.read("chunks").collect()} == now
    assert store.versions().filter("only IS NULL").count() == 2 and store.last_id() == 11
