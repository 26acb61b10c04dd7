"""Lookups by bounds give the ranks of a full pass and read less."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import bounds, lexical
from folioscope.plans.store import Store

DOCS = "chunk_id long, lib_id string, text string"
RARE = [f"rare{i}" for i in range(40)]
COMMON = ["the", "of", "and", "to"]


def corpus(seed, n):
    """Every chunk holds frequent words, few hold a rare one; some texts repeat, one is empty."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(COMMON, k=rng.randint(4, 60)) + rng.choices(RARE, k=rng.choice([0, 0, 0, 1, 2]))
        rows.append((i * 3, rng.choice("aab"), rows[-1][2] if rows and rng.random() < 0.1 else " ".join(words)))
    return [*rows, (n * 3, "a", ""), (n * 3 + 1, "b", "rare0 " * 500)]


def asked_of(spark):
    rows = [(1, "a", "the rare1 of rare2"), (2, "b", "rare0 the and"), (3, "a", "the of"), (4, "a", "the"), (5, "b", "nowhere the rare3 rare3"),
            (6, "a", "nowhere"), (7, "c", "the rare1"), (8, "a", " ".join(RARE[:20] + COMMON)), (9, "b", "rare4 rare5"), (10, "a", "")]
    return spark.createDataFrame(rows, "qid long, lib_id string, query string")


def ranks(df):
    return {(r.qid, r.chunk_id, r.and_rank, r.or_rank, round(r.score, 7), r.all_terms) for r in df.collect()}


@pytest.mark.parametrize("block, lead, top", [(1, 0.6, 5), (30, 0.3, 3), (30, 0.0, 20)])
def test_ranks_are_those_of_a_full_pass(spark, monkeypatch, block, lead, top):
    monkeypatch.setattr(bounds, "BLOCK", block)
    monkeypatch.setattr(bounds, "LEAD", lead)
    docs = spark.createDataFrame(corpus(block + top, 200), DOCS)
    asked = lexical.query_terms(asked_of(spark))
    postings = lexical.document_postings(docs).cache()
    stats, term_df = lexical.corpus_stats(postings), postings.groupBy("term").agg(F.count("*").alias("df"))
    weights = lexical.word_weights(asked, stats, term_df)
    found = bounds.best_scores(postings, bounds.of_postings(postings), weights, top, asked.n_units)
    want = ranks(lexical.lexical_ranks(lexical.bm25_scores(postings, asked, stats, term_df), top))
    assert ranks(lexical.lexical_ranks(found, top)) == want and want


def test_frequent_words_are_looked_up_where_they_matter(spark, monkeypatch):
    monkeypatch.setattr(bounds, "BLOCK", 30)
    docs = spark.createDataFrame(corpus(5, 2000), DOCS)
    asked = lexical.query_terms(spark.createDataFrame([(1, "a", "the rare1 of rare2"), (2, "a", "rare5 and to rare3 of")], "qid long, lib_id string, query string"))
    postings = lexical.document_postings(docs).cache()
    weights = lexical.word_weights(asked, lexical.corpus_stats(postings), postings.groupBy("term").agg(F.count("*").alias("df"))).cache()
    plan = bounds.steps(postings, bounds.of_postings(postings), weights, 5, asked.n_units)
    words = postings.withColumnRenamed("term", "unit")
    total = words.join(weights, ["unit", "lib_id"]).count()
    first, second = words.join(plan.first, ["unit", "lib_id"]).count(), plan.looked_up(postings).count()
    assert {r.unit for r in plan.second.collect()} == {"the", "of", "and", "to"}
    assert 0 < second and (first + second) * 10 < total


def test_bounds_follow_writes_of_the_store(spark, tmp_path):
    rows = [(i, lib, "", f"/p{i}", "t", text) for i, lib, text in corpus(7, 90)]
    chunks = spark.createDataFrame(rows, "chunk_id long, lib_id string, ver string, path string, title string, text string")
    store = Store(spark, str(tmp_path), n_buckets=2)
    store.write("chunks", chunks.filter("chunk_id % 2 = 0"))
    store.build_index()
    store.write_chunks(chunks, [0, 1])
    store.write_chunks(chunks.filter("chunk_id % 9 > 0"), [0, 1])
    asked = asked_of(spark).withColumn("query_vec", F.lit(None).cast("array<float>")).withColumn("version", F.lit(""))
    full = ranks(store.lexical_ranks(asked, 5))
    store.PRUNE_FROM = 0
    assert ranks(store.lexical_ranks(asked, 5)) == full
    one = [(r.rank, r.id) for r in store.get_docs_one("a", "the rare1 of rare2").collect()]
    store.PRUNE_FROM = 10**9
    assert [(r.rank, r.id) for r in store.get_docs_one("a", "the rare1 of rare2").collect()] == one and one
