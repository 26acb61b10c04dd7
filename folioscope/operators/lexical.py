"""BM25 over a batch of queries.

Scores follow the usual full-text defaults: k1 1.2, b 0.75, inverse document frequency with a
floor of 1e-6, statistics over all libraries. A query word holding ``_`` is a phrase.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import local, small_side, spread, stored
from . import places

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
TOP = 20
#: Term every document carries once: its posting brings document count and lengths along.
DOC_MARK = ""


@dataclass(frozen=True)
class QueryTerms:
    """Units of a query batch and their measured size.

    ``by_query``: qid, lib_id, unit, weight, n_units. ``parts``: unit, part, term, n_parts.
    ``n_queries`` and ``n_units`` bound what may be broadcast.
    """

    by_query: DataFrame
    parts: DataFrame
    phrases: bool
    n_queries: int
    n_units: int
    #: Of a single query: its words and its library, known to the driver.
    terms: list[str] | None = None
    lib_id: str | None = None


def query_terms(queries: DataFrame) -> QueryTerms:
    """``queries``: qid, lib_id, query. The units are stored once and measured there."""
    units = queries.select(
        "qid", "lib_id", F.explode_outer(tx.query_units(F.col("query"))).alias("words")
    ).groupBy("qid", "lib_id", "words").agg(F.count("words").cast("double").alias("weight"))
    units = units.withColumn("n_units", F.count("words").over(W.partitionBy("qid")))
    units = stored(units.withColumn("unit", F.array_join("words", " ")))
    size = units.agg(
        F.count_distinct("qid").alias("n"), F.count("words").alias("units"),
        F.coalesce(F.max(F.size("words")), F.lit(0)).alias("longest"),
    ).first()
    units = units.filter("words IS NOT NULL")
    parts = units.select("unit", "words").distinct().select(
        "unit", F.size("words").alias("n_parts"), F.posexplode_outer("words").alias("part", "term")
    )
    by_query = units.select("qid", "lib_id", "unit", "weight", "n_units")
    return QueryTerms(by_query, parts, size["longest"] > 1, size["n"], size["units"])


def local_terms(query: DataFrame) -> QueryTerms:
    """:func:`query_terms` of one local row, counted on the driver without a job."""
    spark = query.sparkSession
    row = query.select("qid", "lib_id", F.transform(tx.query_units(F.col("query")), lambda u: u).alias("units")).first()
    counts = Counter(tuple(u) for u in row["units"])
    kinds = {f.name: f.dataType for f in query.schema}
    by_query = [(row["qid"], row["lib_id"], " ".join(u), float(n), len(counts)) for u, n in counts.items()]
    parts = [(" ".join(u), len(u), i, t) for u in counts for i, t in enumerate(u)]
    text, long_, int_ = T.StringType(), T.LongType(), T.IntegerType()
    struct = lambda **f: T.StructType([T.StructField(n, k) for n, k in f.items()])
    return QueryTerms(
        local(spark, struct(qid=kinds["qid"], lib_id=text, unit=text, weight=T.DoubleType(), n_units=long_), by_query),
        local(spark, struct(unit=text, n_parts=int_, part=int_, term=text), parts),
        any(len(u) > 1 for u in counts), 1, len(counts), sorted({t for u in counts for t in u}), row["lib_id"])


def document_postings(docs: DataFrame, asked: QueryTerms | None = None, positions: bool = False) -> DataFrame:
    """term, lib_id, chunk_id, dl, tf [, positions] from chunk texts, in one pass over them.

    With ``asked`` only the words of that batch are kept, before anything is shuffled.
    """
    ids = docs.groupBy("chunk_id", "lib_id").count().filter("count > 1")
    texts = spread(docs.select("chunk_id", "lib_id", "text"))
    # a chunk is one row, so its words are counted in place and nothing is shuffled
    settled = places.settled(F.col("text"), docs.sparkSession)
    rest = texts.filter(~settled).select("chunk_id", "lib_id", tx.word_places(tx.doc_tokens(F.col("text")), DOC_MARK, positions).alias("__found")).select(
        "chunk_id", "lib_id", F.col("__found.n").cast("long").alias("dl"), F.explode_outer("__found.words").alias("w")).select(
        "chunk_id", "lib_id", "dl", "w.*")
    words = places.places(texts.filter(settled), DOC_MARK, positions).unionByName(rest)
    if asked is not None:
        wanted = asked.parts.select("term").distinct().withColumn("__asked", F.lit(True))
        words = words.join(small_side(wanted, asked.n_units), "term", "left").filter(
            F.col("__asked") | (F.col("term") == DOC_MARK)
        ).drop("__asked")
    columns = ["chunk_id", "lib_id", "dl", "term", "tf", *(["positions"] if positions else [])]
    if ids.isEmpty():
        return words.select(columns)
    # rows that share their id count together, as one chunk
    counts = [F.sum("tf").alias("tf")]
    if positions:
        counts.append(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return words.groupBy("chunk_id", "lib_id", "dl", "term").agg(*counts)


def asked_postings(docs: DataFrame, asked: QueryTerms) -> DataFrame:
    """The postings of one batch, stored so that statistics and scores share one pass over the texts."""
    return stored(document_postings(docs, asked, positions=asked.phrases))


def matches(postings: DataFrame, asked: QueryTerms) -> DataFrame:
    """unit, lib_id, chunk_id, dl, tf: how often a chunk holds each unit of the batch."""
    if asked.terms is not None and not asked.phrases:  # the scan lets the asked words through only
        return postings.select(F.col("term").alias("unit"), "lib_id", "chunk_id", "dl", "tf")
    single = small_side(asked.parts.filter("n_parts = 1").select("unit", "term"), asked.n_units)
    found = postings.join(single, "term").select("unit", "lib_id", "chunk_id", "dl", "tf")
    if not asked.phrases:
        return found
    multi = small_side(asked.parts.filter("n_parts > 1"))  # counted: a word may have many parts
    starts = postings.join(multi, "term").select(
        "unit", "n_parts", "lib_id", "chunk_id", "dl", "part", F.explode("positions").alias("pos")
    )
    runs = starts.groupBy("chunk_id", "unit", "n_parts", "lib_id", "dl", (F.col("pos") - F.col("part")).alias("start")).count()
    phrases = runs.filter("count = n_parts").groupBy("unit", "lib_id", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    return found.unionByName(phrases)


def corpus_stats(postings: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length, from the per-chunk mark."""
    return postings.filter(F.col("term") == DOC_MARK).agg(
        F.count("*").cast("double").alias("n_docs"), F.avg("dl").alias("avg_dl")
    )


def bm25_scores(
    postings: DataFrame, asked: QueryTerms, stats: DataFrame | None = None, term_df: DataFrame | None = None
) -> DataFrame:
    """qid, lib_id, chunk_id, score, all_terms for every chunk of the query's library that holds a unit.

    ``term_df`` (term, df) are stored frequencies; with them ``postings`` may hold the asked
    libraries only. Phrases are counted in the postings, which must then be those of all libraries.
    """
    stats = corpus_stats(postings) if stats is None else stats
    found = matches(postings, asked)
    if term_df is None or asked.phrases:
        corpus = stats.select(F.struct("n_docs", "avg_dl")).scalar()
        weights = small_side(_weighted(asked, corpus, found.groupBy("unit").agg(F.count("*").alias("df"))), asked.n_units)
    else:
        weights = word_weights(asked, stats, term_df)
    return summed(found, weights).select("qid", "lib_id", "chunk_id", "score", holds_all().alias("all_terms"))


def word_weights(asked: QueryTerms, stats: DataFrame, term_df: DataFrame) -> DataFrame:
    """qid, lib_id, unit, weight, n_units, idf, avg_dl of a batch without phrases, from stored frequencies."""
    if asked.terms is not None:
        return _local_weights(asked, stats, term_df)
    corpus = stats.select(F.struct("n_docs", "avg_dl")).scalar()
    terms = small_side(asked.parts.select("unit", "term"), asked.n_units)
    return small_side(_weighted(asked, corpus, term_df.join(terms, "term").select("unit", "df")), asked.n_units)


def _weighted(asked: QueryTerms, corpus: Column, frequency: DataFrame) -> DataFrame:
    raw_idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = frequency.withColumn("n_docs", corpus["n_docs"]).select(
        "unit", F.when(raw_idf <= 0, IDF_FLOOR).otherwise(raw_idf).alias("idf")
    )
    # units no chunk holds need no weight; n_units still counts them
    return asked.by_query.join(idf, "unit").withColumn("avg_dl", corpus["avg_dl"])


def _local_weights(asked: QueryTerms, stats: DataFrame, term_df: DataFrame) -> DataFrame:
    """Weights of the words of one query; the few frequencies they need are read by one job."""
    n_docs, avg_dl = stats.first()
    idf = {}
    for term, df in term_df.select("term", "df").collect():
        raw = math.log((n_docs - df + 0.5) / (df + 0.5))
        idf[term] = IDF_FLOOR if raw <= 0 else raw
    rows = [(*r, idf[r["unit"]], avg_dl) for r in asked.by_query.collect() if r["unit"] in idf]
    kind = T.StructType(asked.by_query.schema.fields + [T.StructField(n, T.DoubleType()) for n in ("idf", "avg_dl")])
    return F.broadcast(local(asked.by_query.sparkSession, kind, rows))


def added_score(tf: Column, dl: Column) -> Column:
    """What a unit adds to the score of a chunk of length ``dl`` that holds it ``tf`` times."""
    return F.col("weight") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (dl / F.col("avg_dl"))))


def sums() -> list[Column]:
    return [F.sum(added_score(F.col("tf"), F.col("dl"))).alias("score"), F.count("*").alias("hit_units"), F.first("n_units").alias("n_units")]


def holds_all() -> Column:
    return F.col("hit_units") == F.col("n_units")


def summed(found: DataFrame, weights: DataFrame) -> DataFrame:
    return found.join(weights, ["unit", "lib_id"]).groupBy("qid", "lib_id", "chunk_id").agg(*sums())


def lexical_ranks(scores: DataFrame, top: int = TOP) -> DataFrame:
    """qid, chunk_id, score, all_terms, and_rank, or_rank: the best ``top`` of both readings.

    The best of a query are among the best of its full and of its partial matches, so one
    pruned window serves both lists and no query's whole match set meets in one task.
    """
    # scores that differ only in floating-point noise tie, and the smaller id wins
    best = F.round("score", 9).desc()
    kept = scores.withColumn(
        "half_rank", F.row_number().over(W.partitionBy("qid", "all_terms").orderBy(best, "chunk_id"))
    ).filter(F.col("half_rank") <= top)
    ranked = kept.withColumn("or_rank", F.row_number().over(W.partitionBy("qid").orderBy(best, "chunk_id")))
    return ranked.select(
        "qid", "chunk_id", "score", "all_terms",
        F.when(F.col("all_terms"), F.col("half_rank")).alias("and_rank"),
        F.when(F.col("or_rank") <= top, F.col("or_rank")).alias("or_rank"),
    ).filter("and_rank IS NOT NULL OR or_rank IS NOT NULL")


def best_of_one(scores: DataFrame, top: int = TOP) -> DataFrame:
    """The rows that :func:`lexical_ranks` of one query needs: the best full matches and the best of all."""
    order = [F.round("score", 9).desc(), F.col("chunk_id")]
    return scores.filter("all_terms").orderBy(*order).limit(top).unionByName(scores.orderBy(*order).limit(top))


def search_documents(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """Lexical ranks straight from chunk texts, without a kept index."""
    asked = query_terms(queries)
    return lexical_ranks(bm25_scores(asked_postings(docs, asked), asked), top)
