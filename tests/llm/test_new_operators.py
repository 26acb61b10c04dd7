"""Hard negatives, line removal and whitening against brute force on small tables."""

import hashlib
import math
import random

import numpy as np
import pytest

from folioscope.llm import line_dedup, negatives, tables, vectors, whitening

SPACES = " \t\n\x0b\x0c\r"


# --- line removal

def plain_line_dedup(rows):
    """What each row keeps, by a walk over all lines."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stays = [
            line for line in lines
            if len(holders.get(key(line), ())) < 3 or doc == max((d for d in holders[key(line)] if d is not None), default=None)]
        out.append((doc, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


def test_lines_agree_with_a_walk_over_all_of_them(spark):
    rng = random.Random(3)
    pool = [f"This Line number {i} is shared by some" for i in range(6)] + ["short", "", "  ", "É" * 20, "é" * 20, "x" * 19, "x" * 20]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice(pool)) + rng.choice(["", " \x0b"])
                          for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(7, rows[7][1]), (7, pool[0] + "\n" + pool[1]), (None, pool[0] + "\nmine"), (None, pool[1]), (80, None), (81, ""), (82, "\n\n")]
    rows += [(99, "\n".join([pool[2]] * 200 + ["own"] + [pool[3]] * 70))]  # several words of a bitmap, and a key many times
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, kept_text string, __doc int")
    got = line_dedup.without_shared_lines(docs, line_dedup.keep_bitmaps(docs))
    assert got.columns == ["doc_id", "text", "__doc", "n_lines", "n_dropped", "kept_text"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted(plain_line_dedup(rows), key=order)


@pytest.mark.parametrize("tasks", ["2", "40"])
def test_a_line_in_most_documents_is_cut_into_pieces(spark, tasks):
    hot = "A line that nearly all documents hold"
    rows = [(i, f"{hot}\nthe own line of document {i}\n{hot if i % 3 else 'z'}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        assert line_dedup._pieces(tables.kept(line_dedup._hashed(docs, 20))).where("piece > 0").count() > 0
        marks = {r.doc_id: r for r in line_dedup.keep_bitmaps(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(marks) == set(range(299))  # the last document keeps its copies
    assert all(m.n_dropped == (2 if i % 3 else 1) for i, m in marks.items())
    assert [(w.word, w.bits) for w in marks[1].keep] == [(0, ~0b101)]


def test_windows_need_no_second_shuffle(spark, capsys):
    docs = spark.createDataFrame([(i, "a line that is long enough") for i in range(9)], "doc_id long, text string")
    held = line_dedup._pieces(tables.kept(line_dedup._hashed(docs, 20))).repartitionByRange("h1", "h2", "piece")
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    ranked = held.withColumn("nth", F.dense_rank().over(Window.partitionBy("h1", "h2", "piece").orderBy(F.col("doc").desc_nulls_last())))
    ranked.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 0


def test_no_documents_no_lines(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    marks = line_dedup.keep_bitmaps(docs)
    assert marks.count() == 0 and line_dedup.without_shared_lines(docs, marks).count() == 0


def test_a_very_long_text_of_short_and_long_lines(spark):
    long_ = "\n".join(f"line {i % 5000} of a very long document" for i in range(60_000))
    rows = [(1, long_), (2, long_), (3, "line 77 of a very long document")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.without_shared_lines(docs, line_dedup.keep_bitmaps(docs)).collect()}
    assert [got[i].n_dropped for i in (1, 2, 3)] == [12, 12, 0]
    want = "\n".join(x for x in long_.split("\n") if x != rows[2][1])
    assert hashlib.sha256(got[1].kept_text.encode()).digest() == hashlib.sha256(want.encode()).digest()


# --- hard negatives

def plain_negatives(rows, low=50, high=95):
    usable = [(i, v, lab, [math.floor(256 * c) for c in vec], anchor) for i, (v, lab, vec, anchor) in enumerate(rows)
              if v is not None and lab is not None and vec is not None and all(c is not None and math.isfinite(c) for c in vec)]
    out = []
    for i, v, lab, x, anchor in usable:
        if not anchor:
            continue
        others = sorted((-sum(a * b for a, b in zip(x, y)), w, j, m) for j, w, m, y, _ in usable if j != i and len(y) == len(x))
        for s, w, _, _ in [o for o in others if o[3] == lab][:5]:
            found = [o for o in others if o[3] != lab and low * -s <= 100 * -o[0] <= high * -s][:3]
            out += [(v, w, n, o[1], -s, -o[0]) for n, o in enumerate(found, 1)]
    return sorted(out)


def as_items(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, label int, embedding array<double>, anchor boolean, row int, score string")


@pytest.mark.parametrize("block", [4096, 7])
def test_negatives_agree_with_all_pairs(spark, monkeypatch, block):
    rng = np.random.default_rng(block)
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", min(block, 5))
    rows = []
    for i in range(150):
        vec = (np.round(rng.normal(size=4), 1) if i % 4 else np.array([0.5, 0.5, 0.0, 0.0])).tolist()  # copies, so ties
        rows.append((i - 3, int(rng.integers(0, 3)) if i % 5 else 1, vec, i % 10 == 0))
    rows += [(200, None, [1.0] * 4, True), (201, 1, None, True), (202, 1, [1.0, None, 0.0, 0.0], True), (203, 1, [math.nan, 1.0, 0.0, 0.0], True),
             (204, 1, [math.inf, 1.0, 0.0, 0.0], True), (205, 2, [], True), (206, 2, [], False), (207, 1, [], None), (None, 1, [1.0] * 4, True),
             (208, 2, [1.0, 2.0], True), (209, 2, [0.0] * 4, True), (10, 1, [0.9, 0.1, 0.0, 0.0], True)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(as_items(spark, rows)).collect())
    assert got == plain_negatives(rows) and len(got) > 100


def test_negatives_of_large_numbers_are_exact(spark):
    rows = [(i, i % 2, [float(2 ** (20 + i % 3)) + i, float(i) * 2**24, 1.0], i == 0) for i in range(12)]
    rows += [(20, 0, [1e300, 0.0, 0.0], True)]  # its scores are given as the nearest long
    got = sorted(tuple(r) for r in negatives.hard_negatives(as_items(spark, rows)).where("anchor_id = 0").collect())
    want = [r for r in plain_negatives(rows) if r[0] == 0 and r[1] != 20]
    assert [r for r in got if r[1] != 20] == want


def test_no_anchors_and_no_rows(spark):
    empty = spark.createDataFrame([], "id long, label int, embedding array<float>, anchor boolean")
    assert negatives.hard_negatives(empty).collect() == []
    assert negatives.hard_negatives(as_items(spark, [(1, 1, [1.0], False), (2, 2, [1.0], False)])).collect() == []


# --- whitening

def test_rank_one_updates_give_the_spectrum(spark):
    rng = np.random.default_rng(1)
    for width, n in ((1, 4), (3, 2), (12, 300), (20, 9)):
        x = rng.integers(-40, 40, (n, width))
        x[:, 0] = 7  # no variance
        x[: n // 2] = x[0]  # copies: many equal eigenvalues on the way
        whole, a, b = (whitening.Spectrum(width) for _ in range(3))
        whole.add(x), a.add(x[: n // 3]), b.add(x[n // 3:])
        a.merge(b)
        scatter = np.cov(x.T, bias=True).reshape(width, width) * n
        size = max(1.0, np.abs(scatter).max())
        for s in (whole, a):
            assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - scatter).max() < 1e-11 * size
            assert np.abs(s.vectors.T @ s.vectors - np.eye(width)).max() < 1e-12
            assert np.allclose(s.mean, x.mean(axis=0)) and s.n == n and s.sums() == x.sum(axis=0).tolist()


def test_roots_close_to_their_poles():
    d = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-9, 2.0])
    z = np.array([1e-7, 0.6, 1e-6, 0.5, 0.6])
    z /= np.linalg.norm(z)
    values, basis = whitening.rank_one(d, np.eye(5), z, 3.0)
    assert np.allclose(values, np.linalg.eigvalsh(np.diag(d) + 3 * np.outer(z, z)), rtol=0, atol=1e-14)
    assert np.abs(basis.T @ basis - np.eye(5)).max() < 1e-14


def table(spark, rows):
    return spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<float>, n string")


def test_whitening_agrees_with_a_dense_solver(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TASK_ROWS", 20)  # many tasks, several levels of combining
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(400, 20)) * np.linspace(0.1, 2, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(200)]
    rows += [(None, base[1].tolist()), (2000, None), (2001, [math.nan] * 20), (2002, [None] + [1.0] * 19), (2003, [math.inf] * 20), (2004, [1.0]), (2005, [])]
    got = whitening.whitened(table(spark, rows)).toPandas()
    used = [r for r in rows if r[0] is None or r[0] < 2000]
    x = np.floor(64 * np.array([r[1] for r in used], dtype=np.float64)).astype(np.int64) + whitening.SHIFT
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    off = fit - sums / n
    e, u = np.linalg.eigh(off.T @ off / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 16 * len(used) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    mine = got[got.vec_id.notna()].pivot(index="vec_id", columns="component", values="whitened")
    at = {r[0]: i for i, r in enumerate(used)}
    want = (x - sums / n) @ u[:, :16] / np.sqrt(e[:16])
    want = want[[at[int(i)] for i in mine.index]]
    assert np.abs(want * np.sign((want * mine.to_numpy()).sum(axis=0)) - mine.to_numpy()).max() < 1e-8
    assert np.allclose(got[got.vec_id == 5].sort_values("component").explained, e[:16] / e.sum(), rtol=1e-9)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert all(deviation[at[int(i)]] == d for i, d in zip(got.vec_id, got.deviation) if not math.isnan(i))


def test_directions_without_variance_have_no_component(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    got = whitening.whitened(table(spark, flat)).collect()
    assert {r.component for r in got} == {1} and math.isclose(got[0].explained, 1.0)
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whitened(table(spark, [])).collect() == []


def test_deviation_beyond_a_long_is_null():
    rows, sums = np.array([[2**40, 0], [1, 1]]), np.array([2**40 + 1, 1], dtype=object)
    assert whitening._deviations(rows, 2, sums) == [None, None]
    assert whitening._deviations(np.array([[3, 4]]), 2, np.array([3, 4], dtype=object)) == [25]


def test_packed_numbers_come_back(spark):
    x = np.array([[0, -1, 127], [-128, 5, 5], [128, 0, 0], [-(2**31), 0, 1], [2**52, -(2**52), 3]])
    data = vectors.packed(x)
    assert [len(d) for d in data] == [4, 4, 7, 13, 25] and (vectors.unpacked(data, 3) == x).all()
    assert vectors.unpacked(vectors.packed(np.empty((2, 0), dtype=np.int64)), 0).shape == (2, 0)
