"""Batch retrieval: one lazy plan answers any number of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards
from ..operators import bounds, fusion, hits as ht, lexical, nearest
from ..session import small_side

SEARCH_POOL = 20
ANSWER_ROWS = 10


@dataclass(frozen=True)
class Corpus:
    """What a batch is searched in. Without ``postings`` the chunk texts are tokenized on the way."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    postings: DataFrame | None = None
    stats: DataFrame | None = None
    term_df: DataFrame | None = None
    #: Bounds of blocks of the postings (``operators.bounds``).
    blocks: DataFrame | None = None

    def scores(self, asked: lexical.QueryTerms, top: int) -> DataFrame:
        """BM25 scores of at least all chunks that may be among the best ``top``."""
        if self.blocks is not None and not asked.phrases:
            weights = lexical.word_weights(asked, self.stats, self.term_df)
            return bounds.best_scores(self.postings, self.blocks, weights, top, asked.n_units)
        postings = lexical.asked_postings(self.chunks, asked) if self.postings is None else self.postings
        return lexical.bm25_scores(postings, asked, self.stats, self.term_df)


#: Chooses the corpus once the batch is measured; a store opens only what the batch needs.
Opener = Callable[[DataFrame, lexical.QueryTerms], Corpus]


def ranked_ids(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, *, metric: str = "cosine"
) -> DataFrame:
    """The joined rank list of both searches, with positions."""
    return _ranked(queries, lexical.query_terms(queries), Corpus(chunks, vectors), metric, lexical.TOP)


def _ranked(queries: DataFrame, asked: lexical.QueryTerms, corpus: Corpus, metric: str, top: int) -> DataFrame:
    found = lexical.lexical_ranks(corpus.scores(asked, top), top)
    near = None
    if corpus.vectors is not None:
        near = nearest.flag_weak(nearest.nearest(queries, corpus.vectors, metric, top, n_queries=asked.n_queries), metric)
    return fusion.list_positions(fusion.ranked_list(found, near))


def search(
    queries: DataFrame, chunks: DataFrame | None = None, vectors: DataFrame | None = None, *, k: int = 5,
    rrf_k: int = fusion.FUSION_K, metric: str = "cosine", opener: Opener | None = None, single: bool = False,
) -> DataFrame:
    """Hybrid search for ``queries`` (qid, lib_id, query, query_vec, version).

    Up to ``k`` hits per query: fused order, soft version filter, one hit per page. ``single``: the caller
    knows that ``queries`` is one local row on a stored index.
    """
    if single:
        asked = lexical.local_terms(queries)
        return search_one(queries, opener(queries, asked), asked, k, rrf_k, metric)
    asked = lexical.query_terms(queries)
    corpus = Corpus(chunks, vectors) if opener is None else opener(queries, asked)
    placed = _ranked(queries, asked, corpus, metric, max(lexical.TOP, k))
    versions = small_side(queries.select("qid", "version"), asked.n_queries)
    fused = fusion.fuse(placed, rrf_k).join(versions, "qid")
    limit = F.when(F.col("version") == "", F.lit(k)).otherwise(F.lit(3 * k))
    top = fusion.best(fused, limit)
    full = ht.attach_chunks(top, corpus.chunks, asked.n_queries * 3 * k)
    return ht.present(ht.one_per_page(ht.prefer_version(full, F.col("version")), k))


def search_one(query: DataFrame, corpus: Corpus, asked: lexical.QueryTerms, k: int, rrf_k: int, metric: str) -> DataFrame:
    """:func:`search` of a batch of one row, with as few jobs as it takes.

    Both searches prune where the data is and hand on ``max(TOP, k)`` ids each; those few rows are the driver's,
    so that fusion, version filter and page rule are one task's work instead of a shuffle each.
    """
    spark, top = query.sparkSession, max(lexical.TOP, k)

    def here(df: DataFrame) -> DataFrame:
        return spark.createDataFrame(df.toArrow(), df.schema).coalesce(1)

    scores = corpus.scores(asked, top)
    found = lexical.lexical_ranks(here(lexical.best_of_one(scores, top)).distinct(), top)
    near = None
    if corpus.vectors is not None and query.first()["query_vec"] is not None:
        closest = [F.round("distance", 9), F.col("chunk_id")]
        near = here(nearest.candidates(query, corpus.vectors, metric, top, n_queries=1).orderBy(*closest).limit(top))
        near = nearest.flag_weak(near.withColumn("vec_rank", F.row_number().over(Window.partitionBy("qid").orderBy(*closest))), metric)
    fused = fusion.fuse(fusion.list_positions(fusion.ranked_list(found, near).coalesce(1)), rrf_k)
    version = query.first()["version"]
    winners = here(fusion.best(fused, F.lit(k if version == "" else 3 * k)))
    ids = [r["chunk_id"] for r in winners.select("chunk_id").collect()]
    text = here(corpus.chunks.select("chunk_id", "path", "title", "text", "ver").filter(F.col("chunk_id").isin(*ids) if ids else F.lit(False)))
    full = text.join(winners.hint("merge"), "chunk_id")
    return ht.present(ht.one_per_page(ht.prefer_version(full, version), k))


def get_docs(
    queries: DataFrame, chunks: DataFrame | None = None, vectors: DataFrame | None = None, *,
    scorer: ht.Scorer = ht.lexical_overlap, **options,
) -> DataFrame:
    """Answers for a batch: guidance for unusable queries, else search, rerank, trim, first ten.

    Empty queries get no row at all.
    """
    asked = queries.filter(~guards.empty_query(F.col("query")))
    vague = asked.filter(guards.needs_guidance(F.col("query")))
    clear = asked.filter(~guards.needs_guidance(F.col("query")))
    if options.get("single") and clear.first() is None:  # one local row: no job
        return guidance(vague, "query")
    hits = search(clear, chunks, vectors, k=SEARCH_POOL, **options)
    if options.get("single"):
        found = hits.withColumn("query", F.lit(clear.first()["query"]))
    else:
        found = hits.join(clear.select("qid", "query"), "qid")
    ordered = ht.rerank(found, scorer).drop("query")
    answers = ht.trim_to_budget(ordered).filter(F.col("rank") <= ANSWER_ROWS)
    answers = answers.withColumn("id", F.col("id").cast("string"))
    return answers if options.get("single") else answers.unionByName(guidance(vague, "query"))


def guidance(queries: DataFrame, reason: str) -> DataFrame:
    """One explanatory row per query instead of documents."""
    text = guards.guidance_text(F.lit(reason))
    return queries.select(
        "qid", F.lit(1).alias("rank"), F.lit("guidance").alias("id"), F.lit("").alias("path"),
        F.lit("Guidance").alias("title"), text.alias("text"), F.lit("Guidance").alias("section_title"),
        F.floor(F.length(text) / 4).cast("long").alias("tokens"), F.lit(0.0).alias("score"),
    )
