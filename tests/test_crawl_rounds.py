"""Rounds of a crawl follow the depth of the links where nothing may end it before its queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.plans import crawl

BASE = "https://d.dev"
TEXT = "# Page\n\n" + "words of this page " * 20


def crawled(spark, **options):
    """Rounds and pages of a start page with thirty links, each of which has one more."""
    pages = {f"{BASE}/": [f"{BASE}/p{i}" for i in range(30)]} | {f"{BASE}/p{i}": [f"{BASE}/q{i}"] for i in range(30)} | {f"{BASE}/q{i}": [] for i in range(30)}
    rows = [(u, TEXT, "".join(f'<a href="{x}">x</a>' for x in links)) for u, links in pages.items()]
    saved = spark.createDataFrame(rows, "url string, text string, html string").cache()
    rounds = []

    def fetch(batch):
        rounds.append(batch.count())
        return batch.join(saved, "url", "left")

    libs = spark.createDataFrame([("d", BASE)], "lib_id string, docs_url string")
    chunks, frontier = crawl.crawl(crawl.start(libs), fetch, F.lit(""), **options)
    seen = {r["page"] for r in frontier.filter("status = 'seen'").collect()}
    return rounds, seen, chunks.select("path").distinct().count(), crawl.completed(frontier).first()["complete"]


def test_a_round_takes_the_whole_queue(spark):
    rounds, seen, n_paths, complete = crawled(spark)
    assert rounds == [1, 30, 30] and len(seen) == n_paths == 61 and complete


def test_caps_and_budgets_keep_their_order(spark):
    caps = spark.createDataFrame([("d", 9)], "lib_id string, cap int")
    rounds, seen, n_paths, complete = crawled(spark, caps=caps)
    assert rounds == [1, 4, 4] and n_paths == 9 and not complete
    rounds, seen, n_paths, complete = crawled(spark, max_rounds=2)
    assert rounds == [1, 4] and n_paths == 5 and not complete
    no_cap = spark.createDataFrame([("d", None), ("other", 1)], "lib_id string, cap int")
    assert crawled(spark, caps=no_cap)[0] == [1, 30, 30]
