"""Writes of a store that cost less give the same store; words are counted as the expressions have them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import bounds, lexical, places
from folioscope.plans.store import Store
from folioscope.session import among, settled

KIND = "chunk_id long, lib_id string, text string"


def told(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_words_are_those_of_the_expressions(spark):
    rng = random.Random(4)
    letters = list("abcXYZ 019_-") * 8 + list("éÉßİıŉΣσςǅ中文한̧́﻿ \U0001d400\U00010400\U000f0000\U0001f600")
    rows = [(i, "ab"[i % 2], "".join(rng.choices(letters, k=rng.choice([0, 1, 3, 20, 200])))) for i in range(150)] + [(900, "a", None), (None, None, "x y x")]
    texts = spark.createDataFrame(rows, KIND).unionByName(spark.createDataFrame([(901, "a", bytearray(b"one \xff two"))], "chunk_id long, lib_id string, b binary").select(
        "chunk_id", "lib_id", F.col("b").cast("string").alias("text"))).coalesce(1)
    plain = texts.select("chunk_id", "lib_id", tx.word_places(tx.doc_tokens(F.col("text")), lexical.DOC_MARK, True).alias("f")).select(
        "chunk_id", "lib_id", F.col("f.n").cast("long").alias("dl"), F.explode_outer("f.words").alias("w")).select("chunk_id", "lib_id", "dl", "w.*")
    columns = ("chunk_id", "lib_id", "dl", F.hex("term"), "tf", "positions")
    assert told(lexical.document_postings(texts, positions=True), *columns) == told(plain, *columns)
    assert 0 < texts.filter(places.settled(F.col("text"), spark)).count() < len(rows)


def test_the_index_of_a_store_is_that_of_its_postings(spark, tmp_path):
    rng = random.Random(6)
    words = ["the", "of"] + [f"w{i}" for i in range(30)]
    rows = [(i * rng.choice([1, 9000]), rng.choice("aab"), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120)]
    chunks = spark.createDataFrame([(*r[:2], "", "/p", "t", r[2]) for r in rows + rows[:3]], "chunk_id long, lib_id string, ver string, path string, title string, text string")
    store = Store(spark, str(tmp_path), n_buckets=3)
    store.write("chunks", chunks)
    store.build_index()
    want = lexical.document_postings(chunks, positions=True)
    columns = ("term", "lib_id", "chunk_id", "tf", "positions", "dl")
    assert told(store.read("postings"), *columns) == told(want, *columns)
    columns = ("term", "lib_id", "block", "n", "max_tf", "min_dl")
    assert told(store.read("blocks"), *columns) == told(bounds.of_postings(want), *columns)


def test_a_write_that_hides_many_writes_whole_versions_at_once(spark, tmp_path):
    rows = [(i, "ab"[i % 2], "", f"/p{i}", "t", f"the words of number{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "chunk_id long, lib_id string, ver string, path string, title string, text string")
    store = Store(spark, str(tmp_path), n_buckets=2)
    store.HIDDEN_LEAST = 5
    store.write("chunks", df.filter("chunk_id < 20"))
    store.build_index()
    store.write_chunks(df.filter("chunk_id > 9"), [0, 1], tag="last")
    made = store.versions().filter("table_name = 'hidden' OR delta").count()
    assert made == 0 and store.index_is_current() and store.newest("chunks")["tag"] == "last"
    follows = {t: told(store.read(t), *store.read(t).columns) for t in ("chunks", "postings", "terms", "blocks", "corpus_stats")}
    assert {r[0] for r in follows["chunks"]} == set(range(10, 30))
    store.build_index()
    assert follows == {t: told(store.read(t), *store.read(t).columns) for t in follows}


def test_many_ids_are_met_as_bits(spark, monkeypatch):
    monkeypatch.setattr("folioscope.session.BROADCAST_ROWS", 40)
    df = spark.createDataFrame([(i,) for i in [*range(-200, 300), 2**40, 2**62, None]], "chunk_id long")
    for ids in ([*range(-130, 150, 3), 2**62], [i * 1000 for i in range(60)]):  # close together, and too far apart
        given = spark.createDataFrame([(i,) for i in [*ids, None]], "chunk_id long")
        for stays, how in ((True, "left_semi"), (False, "left_anti")):
            got = among(df, given, len(ids) + 1, stays)
            assert told(got, "chunk_id") == told(df.join(given, "chunk_id", how), "chunk_id")


def test_rows_of_files_are_not_stored_again(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert settled(rows.filter("id > 1").withColumn("x", F.col("id") + 1)).inputFiles() == rows.inputFiles()
    for other in (rows.withColumn("x", F.rand()), rows.groupBy("id").count(), rows.join(rows, "id")):
        assert settled(other).inputFiles() != rows.inputFiles()
