"""Postings are counted inside the row of a chunk; only rows that share their id are brought together."""

from __future__ import annotations

from collections import Counter

from folioscope.operators import lexical

KIND = "chunk_id long, lib_id string, text string"


def told(df):
    return sorted((r["chunk_id"], r["term"], r["tf"], r["dl"], tuple(r["positions"])) for r in df.collect())


def plain(rows):
    out = []
    for i, _, text in rows:
        words = (text or "").lower().split()
        counts = Counter(words)
        out += [(i, w, n, len(words), tuple(k for k, x in enumerate(words) if x == w)) for w, n in counts.items()]
        out.append((i, lexical.DOC_MARK, 1, len(words), (len(words),)))
    return sorted(out)


def test_postings_take_no_shuffle(spark):
    rows = [(1, "a", "one two one Three one"), (2, "a", ""), (3, "b", "two")]
    got = lexical.document_postings(spark.createDataFrame(rows, KIND).coalesce(2), positions=True)
    assert told(got) == plain(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_rows_of_one_id_count_as_one_chunk(spark):
    rows = [(1, "a", "one two one"), (1, "a", "two two one"), (1, "b", "one")]
    got = lexical.document_postings(spark.createDataFrame(rows, KIND), positions=True)
    found = {(r["lib_id"], r["term"]): (r["tf"], r["positions"]) for r in got.collect()}
    assert found["a", "one"] == (3, [0, 2, 2]) and found["a", "two"] == (3, [0, 1, 1]) and found["b", "one"] == (1, [0])
    assert found["a", lexical.DOC_MARK] == (2, [3, 3])
