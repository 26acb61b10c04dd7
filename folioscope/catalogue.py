"""Registered queries over the driver's tables, each beside the SQL that must give the same rows.

Every query reads its tables whole. The SQL is written for DuckDB; it shares the fixed word lists
with the Spark side, but no logic. Common table expressions and expression helpers stand at the top.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluation import metrics
from .functions import guards, hashing, html as hx, paths, text as tx
from .operators import bounds, candidates as cd
from .operators import freshness, fusion, hits as ht, lexical, nearest, neardup, upsert
from .operators.ordering import running
from .plans import crawl, ingest, resolve, retrieval
from .plans.store import Store, lib_stats
from .session import shared_dir, small_side, spread, stored
from .sources import listings, tables as tb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---------------------------------------------------------------- SQL expressions

def s_norm_path(p: str) -> str:
    return (
        f"regexp_replace(regexp_replace(CASE WHEN regexp_matches(trim({p}), '^/?en(/|$)') "
        f"THEN regexp_replace(trim({p}), '^/?en', '') ELSE trim({p}) END, '/+$', ''), '\\.html$', '')"
    )


def s_path(u: str) -> str:
    return f"regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def s_netloc(u: str) -> str:
    return f"regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)"


def s_norm_url(u: str) -> str:
    cut = f"regexp_replace(regexp_replace(regexp_replace({s_path(u)}, ';[^/]*$', ''), '/+$', ''), '\\.html$', '')"
    tail = f"CASE WHEN regexp_matches({cut}, '^/?en(/|$)') THEN regexp_replace({cut}, '^/?en', '') ELSE {cut} END"
    return f"(regexp_extract({u}, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN ({tail}) = '' THEN '/' ELSE ({tail}) END)"


def s_tokens(t: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({t})), '[\\p{{L}}\\p{{N}}]+')"


def s_allowed(u: str, base: str) -> str:
    codes = "|".join(paths.LANGUAGE_SEGMENTS)
    noise = " OR ".join(f"list_contains(string_split({s_path(u)}, '/'), '{s}')" for s in paths.DENIED_SEGMENTS)
    return (
        f"({s_netloc(u)} = {s_netloc(base)} AND lower(regexp_extract({s_path(u)}, '(?i)/({codes})(/|$)', 1)) IN ('', 'en') "
        f"AND NOT ({noise}) AND NOT regexp_matches({s_path(u)}, '/[0-9]{{4}}/[0-9]{{2}}/'))"
    )


S_CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, source AS lib_id,
         CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '3.1.0' ELSE '2.3.0' END AS ver,
         CASE WHEN (doc_id // 20) % 2 = 0 THEN '/en/guide/p' || ((doc_id // 40) * 20 + doc_id % 20) || '.html'
              ELSE '/guide/p' || ((doc_id // 40) * 20 + doc_id % 20) || '/' END AS path,
         left(regexp_replace(string_split(text, chr(10))[1], '^#+\\s*', ''), 80) AS title, text
  FROM documents)"""
S_QUERIES = """queries AS (
  SELECT item_id AS qid, 'src' || (item_id % 20) AS lib_id, text AS query, embedding AS query_vec
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"""
S_LEXICAL = f"""{S_CHUNKS}, {S_QUERIES},
units AS (SELECT qid, lib_id, term, count(*)::DOUBLE AS weight FROM (
    SELECT qid, lib_id, lower(unnest(regexp_extract_all(query, '[A-Za-z0-9_]+'))) AS term FROM queries) GROUP BY ALL),
n_units AS (SELECT qid, count(*) AS n_units FROM units GROUP BY qid),
toks AS (SELECT chunk_id, lib_id, {s_tokens('text')} AS t FROM chunks),
stats AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(t)) AS avg_dl FROM toks),
post AS (SELECT chunk_id, lib_id, dl, term, count(*) AS tf FROM (
    SELECT chunk_id, lib_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 0) AS raw FROM freq, stats),
scores AS (SELECT qid, chunk_id,
    sum(weight * CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score,
    count(*) = any_value(n_units) AS all_terms
  FROM units JOIN post USING (term, lib_id) JOIN idf USING (term) JOIN n_units USING (qid), stats GROUP BY qid, chunk_id),
or_list AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scores QUALIFY rank <= 20),
and_list AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scores WHERE all_terms QUALIFY rank <= 20)"""


def s_vector(metric: str) -> str:
    pair = "embedding::DOUBLE[], query_vec::DOUBLE[]"
    dist = f"list_distance({pair})" if metric == "l2" else f"1 - list_cosine_similarity({pair})"
    guard = "" if metric == "l2" else " AND max(1 - distance) OVER (PARTITION BY qid) > 0"
    return f"""vec_all AS (SELECT qid, c.chunk_id, {dist} AS distance
  FROM queries q JOIN chunks c USING (lib_id) JOIN embeddings e ON e.vec_id = c.chunk_id WHERE query_vec IS NOT NULL),
vec_list AS (SELECT qid, chunk_id, distance, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), chunk_id) AS rank FROM vec_all QUALIFY rank <= 20),
vec AS (SELECT *, (1 - distance < 0.5 * max(1 - distance) OVER (PARTITION BY qid)){guard} AS weak FROM vec_list)"""


S_RANKED = f"""WITH {S_LEXICAL}, {s_vector('cosine')},
ranked AS (SELECT qid, chunk_id, 0 AS branch, rank, false AS weak FROM and_list
  UNION ALL SELECT qid, chunk_id, 1, rank, false FROM or_list o WHERE NOT EXISTS (SELECT 1 FROM and_list a WHERE a.qid = o.qid AND a.chunk_id = o.chunk_id)
  UNION ALL SELECT qid, chunk_id, 2, rank, weak FROM vec),
numbered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY branch, rank, chunk_id) AS pos FROM ranked),
firsts AS (SELECT *, (row_number() OVER (PARTITION BY qid, chunk_id ORDER BY pos) = 1)::INT AS fresh FROM numbered),
placed AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY qid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM firsts)"""


def s_hits(version: str, k: int) -> str:
    """Hybrid hits from S_RANKED for one wanted version ('' for none)."""
    limit = 3 * k if version else k
    keep = f"ver IN ('{version}', '')" if version else "true"
    other = f"(ver <> '{version}')::INT" if version else "0"
    return f""", fused AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + before)) AS score, min(pos) AS first_pos FROM placed GROUP BY qid, chunk_id HAVING NOT bool_or(weak)),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first_pos) AS fused_rank FROM fused QUALIFY fused_rank <= {limit}),
kept AS (SELECT t.*, path, title, text, ver, row_number() OVER (PARTITION BY qid ORDER BY {other}, fused_rank) AS order_rank FROM top t JOIN chunks USING (chunk_id) WHERE {keep}),
paged AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY qid, {s_norm_path('path')} ORDER BY order_rank) = 1),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY order_rank) AS rank FROM paged QUALIFY rank <= {k})"""


# ---------------------------------------------------------------- search

def _lexical(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search_documents(tb.chunks(spark, sf), tb.queries(spark, sf))


@register("bm25_and", f"WITH {S_LEXICAL} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM and_list")
def _(spark, sf):
    return _lexical(spark, sf).filter("and_rank IS NOT NULL").select("qid", "chunk_id", F.col("and_rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@register("bm25_or", f"WITH {S_LEXICAL} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM or_list")
def _(spark, sf):
    return _lexical(spark, sf).filter("or_rank IS NOT NULL").select("qid", "chunk_id", F.col("or_rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@register("bm25_topk", f"""WITH {S_LEXICAL} SELECT qid, rank, path, title, round(score, 6) AS score FROM or_list JOIN chunks USING (chunk_id) WHERE rank <= 5""")
def _(spark, sf):
    best = _lexical(spark, sf).filter("or_rank <= 5").select("qid", "chunk_id", F.col("or_rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))
    return tb.chunks(spark, sf).select("chunk_id", "path", "title").join(best, "chunk_id").select("qid", "rank", "path", "title", "score")


@register("bm25_bounded", f"""WITH {S_LEXICAL} SELECT qid, chunk_id, o.rank AS or_rank, a.rank AS and_rank, round(coalesce(o.score, a.score), 6) AS score
FROM or_list o FULL JOIN and_list a USING (qid, chunk_id)""")
def _(spark, sf):
    """Both lists from postings whose frequent words are looked up only where the bounds of a block let them matter."""
    asked = lexical.query_terms(tb.queries(spark, sf))
    postings = stored(lexical.document_postings(tb.chunks(spark, sf), asked))
    weights = lexical.word_weights(asked, lexical.corpus_stats(postings), postings.groupBy("term").agg(F.count("*").alias("df")))
    # of the blocks, too, only those of a word in a library that is asked for it
    pairs = small_side(asked.by_query.select(F.col("unit").alias("term"), "lib_id").distinct(), asked.n_units)
    scores = bounds.best_scores(postings, bounds.of_postings(postings.join(pairs, ["term", "lib_id"], "left_semi")), weights, lexical.TOP, asked.n_units)
    return lexical.lexical_ranks(scores).select(
        "qid", "chunk_id", F.col("or_rank").cast("long").alias("or_rank"), F.col("and_rank").cast("long").alias("and_rank"), F.round("score", 6).alias("score"))


def _nearest(metric: str) -> Query:
    def run(spark, sf):
        found = nearest.nearest(tb.queries(spark, sf), tb.chunk_vectors(spark, sf), metric)
        return found.select("qid", "chunk_id", F.col("vec_rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))
    return run


for _metric in ("l2", "cosine"):
    register(f"knn_{_metric}", f"WITH {S_CHUNKS}, {S_QUERIES}, {s_vector(_metric)} SELECT qid, chunk_id, rank, round(distance, 6) AS distance FROM vec_list")(_nearest(_metric))


def _threshold(metric: str) -> Query:
    def run(spark, sf):
        found = nearest.flag_weak(nearest.nearest(tb.queries(spark, sf), tb.chunk_vectors(spark, sf), metric), metric)
        return found.select("qid", "chunk_id", F.round(1 - F.col("distance"), 6).alias("similarity"), "weak")
    return run


register("rel_threshold", f"WITH {S_CHUNKS}, {S_QUERIES}, {s_vector('cosine')} SELECT qid, chunk_id, round(1 - distance, 6) AS similarity, weak FROM vec")(_threshold("cosine"))
register("rel_threshold_l2", f"WITH {S_CHUNKS}, {S_QUERIES}, {s_vector('l2')} SELECT qid, chunk_id, round(1 - distance, 6) AS similarity, weak FROM vec")(_threshold("l2"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.ranked_ids(tb.queries(spark, sf), tb.chunks(spark, sf), tb.chunk_vectors(spark, sf))


@register("rrf_fusion", S_RANKED + """ SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + before)), 9) AS score, min(pos) AS first_pos
  FROM placed GROUP BY qid, chunk_id HAVING NOT bool_or(weak)""")
def _(spark, sf):
    return fusion.fuse(_ranked(spark, sf)).select("qid", "chunk_id", F.round("score", 9).alias("score"), F.col("first_pos").cast("long").alias("first_pos"))


S_HIT_COLUMNS = """SELECT qid, rank, chunk_id AS id, path, title, left(trim(regexp_extract(text, '^#{1,4}\\s+(.*)', 1)), 80) AS section_title,
  length(text) // 4 AS tokens, round(score, 4) AS score FROM hits"""


@register("hybrid_search", S_RANKED + s_hits("", 10) + S_HIT_COLUMNS)
def hybrid_search(spark, sf):
    found = retrieval.search(tb.queries(spark, sf), tb.chunks(spark, sf), tb.chunk_vectors(spark, sf), k=10)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "id", "path", "title", "section_title", "tokens", "score")


@register("version_soft_filter", S_RANKED + s_hits("3.1.0", 10) + S_HIT_COLUMNS)
def _(spark, sf):
    found = retrieval.search(tb.queries(spark, sf, "3.1.0"), tb.chunks(spark, sf), tb.chunk_vectors(spark, sf), k=10)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "id", "path", "title", "section_title", "tokens", "score")


S_TRIM = """, used AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM hits)
SELECT qid, rank, chunk_id AS id, left(text, (12000 - used)::BIGINT) AS text, length(text) // 4 AS tokens FROM used WHERE used < 12000"""


@register("token_budget_trim", S_RANKED + s_hits("", 10) + S_TRIM)
def _(spark, sf):
    found = retrieval.search(tb.queries(spark, sf), tb.chunks(spark, sf), tb.chunk_vectors(spark, sf), k=10)
    return ht.trim_to_budget(found).select("qid", F.col("rank").cast("long").alias("rank"), "id", "text", "tokens")


S_RERANK = f""", counted AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM hits),
scored AS (SELECT c.*, CASE WHEN n >= 2 THEN coalesce(len(list_intersect(list_distinct({s_tokens('q.query')}), {s_tokens('c.text')}))::DOUBLE
    / nullif(len(list_distinct({s_tokens('q.query')})), 0), 0) END AS fresh FROM counted c JOIN queries q USING (qid)),
reordered AS (SELECT qid, chunk_id, text, row_number() OVER (PARTITION BY qid ORDER BY (fresh IS NULL)::INT, round(fresh, 9) DESC, rank) AS rank,
  CASE WHEN fresh IS NULL THEN round(score, 4) ELSE round(fresh, 4) END AS score FROM scored)"""


@register("rerank_overlap", S_RANKED + s_hits("", 20) + S_RERANK + " SELECT qid, rank, chunk_id AS id, score FROM reordered")
def _(spark, sf):
    queries = tb.queries(spark, sf)
    found = retrieval.search(queries, tb.chunks(spark, sf), tb.chunk_vectors(spark, sf), k=20).join(queries.select("qid", "query"), "qid")
    return ht.rerank(found).select("qid", F.col("rank").cast("long").alias("rank"), "id", "score")


@register("get_docs", S_RANKED + s_hits("", 20) + S_RERANK + """, used AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM reordered)
SELECT qid, rank, chunk_id::VARCHAR AS id, left(text, (12000 - used)::BIGINT) AS text, length(text) // 4 AS tokens, score FROM used WHERE used < 12000 AND rank <= 10""")
def _(spark, sf):
    answers = retrieval.get_docs(tb.queries(spark, sf), tb.chunks(spark, sf), tb.chunk_vectors(spark, sf))
    return answers.select("qid", F.col("rank").cast("long").alias("rank"), "id", "text", "tokens", "score")


# ---------------------------------------------------------------- evaluation

S_GOLD = """, gold AS (SELECT qid, unnest(frags) AS frag FROM (SELECT item_id AS qid, ['guide/p' || (doc_id // 40 * 20 + doc_id % 20)] AS frags
  FROM benchmark b JOIN documents d ON d.doc_id = b.item_id))"""


def _golden(spark: SparkSession, sf: str) -> DataFrame:
    """Each passage's expected page: the one of the document with its number."""
    docs = tb.read(spark, sf, "documents").select(F.col("doc_id").alias("qid"))
    page = F.regexp_replace(tb.page_path(F.col("qid")), r"^/(en/)?|/\z|\.html\z", "")
    items = tb.read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), tb.lib_of(F.col("item_id")).alias("library_name"), F.col("text").alias("query"))
    return items.join(docs, "qid").withColumn("fragments", F.array(page))


@register("hit_at_k", S_RANKED + s_hits("", 10) + S_GOLD + """, first AS (SELECT g.qid, min(h.rank) AS r FROM gold g LEFT JOIN hits h
    ON h.qid = g.qid AND h.rank <= 5 AND contains(lower(h.path), lower(g.frag)) GROUP BY g.qid)
  SELECT count(*) AS scored, round(avg(coalesce(r <= 1, false)::INT), 3) AS hit_1, round(avg(coalesce(r <= 3, false)::INT), 3) AS hit_3,
  round(avg(coalesce(r <= 5, false)::INT), 3) AS hit_5 FROM first""")
def _(spark, sf):
    found = retrieval.search(tb.queries(spark, sf), tb.chunks(spark, sf), tb.chunk_vectors(spark, sf), k=10)
    return metrics.hit_rates(metrics.first_hit(found, _golden(spark, sf)))


S_SWEEP = S_RANKED + S_GOLD + f""", ks AS (SELECT unnest([20, 40, 60, 80, 100]) AS k),
fused AS (SELECT k, qid, chunk_id, sum(1.0::DOUBLE / (k + before)) AS score, min(pos) AS first_pos FROM placed, ks GROUP BY ALL HAVING NOT bool_or(weak)),
top AS (SELECT *, row_number() OVER (PARTITION BY k, qid ORDER BY round(score, 12) DESC, first_pos) AS fused_rank FROM fused QUALIFY fused_rank <= 10),
paged AS (SELECT k, qid, fused_rank, path FROM top JOIN chunks USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY k, qid, {s_norm_path('path')} ORDER BY fused_rank) = 1),
hits AS (SELECT *, row_number() OVER (PARTITION BY k, qid ORDER BY fused_rank) AS rank FROM paged),
first AS (SELECT s.k, g.qid, min(CASE WHEN contains(lower(path), lower(frag)) THEN rank END) AS r
  FROM gold g CROSS JOIN ks s LEFT JOIN hits h ON h.k = s.k AND h.qid = g.qid AND rank <= 5 GROUP BY ALL)"""


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    """First hits of every golden query under each setting of the fusion."""
    ks = (20, 40, 60, 80, 100)
    placed = _ranked(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    top = fusion.best(fusion.fuse(placed, F.col("k"), by=("k", "qid")), 10, by=("k", "qid"))
    paged = tb.chunks(spark, sf).select("chunk_id", "path").join(top, "chunk_id").withColumn("kq", F.struct("k", "qid"))
    hits = ht.one_per_page(paged.drop("qid").withColumnRenamed("kq", "qid"), 10, "fused_rank").withColumn("qid", F.col("qid.qid"))
    return metrics.first_hit(hits, _golden(spark, sf), ks=ks)


@register("rrf_sweep", S_SWEEP + """
SELECT k, count(*) AS scored, round(avg(coalesce(r <= 1, false)::INT), 3) AS hit_1, round(avg(coalesce(r <= 3, false)::INT), 3) AS hit_3, round(avg(coalesce(r <= 5, false)::INT), 3) AS hit_5 FROM first GROUP BY k""")
def _(spark, sf):
    return metrics.hit_rates(_sweep(spark, sf), by=("k",))


@register("rrf_best_k", S_SWEEP + """ SELECT k AS best_k, count(*) FILTER (r <= 5) AS hit5, count(*) FILTER (r <= 1) AS hit1, count(*) AS n
FROM first GROUP BY k ORDER BY hit5 DESC, hit1 DESC, k LIMIT 1""")
def _(spark, sf):
    return metrics.best_k(_sweep(spark, sf))


@register("resolve_hit", """SELECT c_custkey AS id, contains(regexp_replace(lower('src-' || c_name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g')) AS by_nation,
  contains(regexp_replace(lower('src-' || c_name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g')) AS by_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    nation = tb.read(spark, sf, "nation")
    both = tb.read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    top = F.concat(F.lit("src-"), "c_name")
    return both.select(F.col("c_custkey").alias("id"), metrics.resolve_hit(top, F.col("n_name")).alias("by_nation"), metrics.resolve_hit(top, F.col("c_name")).alias("by_name"))


@register("keyword_hit", S_RANKED + s_hits("", 20) + S_RERANK + """, used AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM reordered),
  answers AS (SELECT qid, lower(left(text, (12000 - used)::BIGINT)) AS low FROM used WHERE used < 12000 AND rank <= 10),
  asked AS (SELECT qid, list_filter(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 3) AS terms FROM queries),
  found AS (SELECT qid, len(list_filter(terms, lambda t: contains(low, t))) > 0 AS hit FROM asked LEFT JOIN answers USING (qid))
  SELECT qid AS item_id, coalesce(bool_or(hit), false) AS hit, count(*) FILTER (hit) AS n_chunks FROM found GROUP BY qid""")
def _(spark, sf):
    queries = tb.queries(spark, sf)
    answers = retrieval.get_docs(queries, tb.chunks(spark, sf), tb.chunk_vectors(spark, sf)).select("qid", "text")
    hit = metrics.keyword_hit(F.col("text"), F.col("query"))
    return queries.select("qid", "query").join(answers, "qid", "left").groupBy(F.col("qid").alias("item_id")).agg(
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"), F.count_if(hit).alias("n_chunks"))


@register("latency_summary", """SELECT event_type AS tool, count(*) AS n_calls, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms, round(sum(value), 2) AS total_ms FROM events GROUP BY event_type""")
def _(spark, sf):
    calls = tb.read(spark, sf, "events").select(F.col("event_type").alias("tool"), F.col("value").alias("ms"))
    out = metrics.latency_summary(calls)
    return out.select("tool", "n_calls", F.round("mean_ms", 6).alias("mean_ms"), F.round("median_ms", 6).alias("median_ms"), F.round("total_ms", 2).alias("total_ms"))


@register("activity_score", """WITH g AS (SELECT regexp_replace(lower('src' || (item_id % 20)), '[^a-z0-9]', '', 'g') AS lib, regexp_replace(lower(left(text, 24)), '[^a-z0-9]', '', 'g') AS start, item_id,
    'p' || (item_id // 40 * 20 + item_id % 20) AS frag FROM benchmark),
  one AS (SELECT lib, start, arg_min(frag, item_id) AS frag FROM g GROUP BY ALL),
  e AS (SELECT event_id, 'src' || (b.item_id % 20) AS lib, b.text AS q, ['guide/p' || (value::INT % 7), 'guide/p' || user_id] AS top FROM events JOIN benchmark b ON b.item_id = user_id),
  j AS (SELECT event_id, list_position(list_transform(top, lambda p: contains(regexp_replace(lower(p), '[^a-z0-9]', '', 'g'), frag)), true) AS place FROM e JOIN one
    ON one.lib = regexp_replace(lower(e.lib), '[^a-z0-9]', '', 'g') AND one.start = regexp_replace(lower(left(e.q, 24)), '[^a-z0-9]', '', 'g'))
  SELECT count(*) AS docs, count(*) FILTER (place = 1) AS hit1, count(*) FILTER (place > 0) AS hit5, round(100.0 * count(*) FILTER (place = 1) / greatest(count(*), 1), 1) AS pct_hit1,
    round(100.0 * count(*) FILTER (place > 0) / greatest(count(*), 1), 1) AS pct_hit5 FROM j""")
def _(spark, sf):
    items = tb.read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), tb.lib_of(F.col("item_id")).alias("lib"), F.col("text").alias("q"))
    golden = items.select("qid", F.col("lib").alias("library_name"), F.col("q").alias("query"),
                          F.array(F.concat(F.lit("p"), (F.floor(F.col("qid") / 40) * 20 + F.col("qid") % 20).cast("string"))).alias("fragments"))
    events = tb.read(spark, sf, "events").join(items, F.col("user_id") == F.col("qid"))
    calls = events.select("lib", "q", F.array(
        F.concat(F.lit("guide/p"), (F.round("value").cast("int") % 7).cast("string")), F.concat(F.lit("guide/p"), F.col("user_id").cast("string"))).alias("top"))
    return metrics.score_activity(calls, golden)


# ---------------------------------------------------------------- paths and pages

@register("norm_path_store", f"WITH {S_CHUNKS} SELECT chunk_id, path, {s_norm_path('path')} AS page FROM chunks UNION ALL SELECT page_id, {s_path('url')}, {s_norm_path(s_path('url'))} FROM pages")
def _(spark, sf):
    docs = tb.chunks(spark, sf).select("chunk_id", "path")
    pages = tb.read(spark, sf, "pages").select(F.col("page_id").alias("chunk_id"), paths.path_of(F.col("url")).alias("path"))
    return docs.unionByName(pages).withColumn("page", paths.norm_path(F.col("path")))


@register("norm_url", f"SELECT page_id, url, {s_norm_url('url')} AS page FROM pages")
def _(spark, sf):
    return tb.read(spark, sf, "pages").select("page_id", "url", paths.norm_url(F.col("url")).alias("page"))


@register("path_variants", f"""WITH {S_CHUNKS}, b AS (SELECT chunk_id, path, regexp_replace(regexp_replace(path, '/+$', ''), '\\.html$', '') AS base FROM chunks)
  SELECT DISTINCT chunk_id, unnest([path, base, base || '.html', base || '/']) AS variant FROM b""")
def _(spark, sf):
    return tb.chunks(spark, sf).select("chunk_id", F.explode(paths.path_variants(F.col("path"))).alias("variant"))


@register("dedupe_norm_path", f"WITH {S_CHUNKS} SELECT lib_id, {s_norm_path('path')} AS page, min(chunk_id) AS chunk_id, count(*) AS n FROM chunks GROUP BY ALL")
def _(spark, sf):
    return tb.chunks(spark, sf).groupBy("lib_id", paths.norm_path(F.col("path")).alias("page")).agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("n"))


_BASE = "regexp_replace(url, '^([a-z]+://[^/?#]*).*$', '\\1')"


@register("url_allowed", f"""SELECT page_id, {s_allowed('url', 'url')} AS same_site, {s_allowed('url', "'https://m.ththth.example.net/docs'")} AS one_site FROM pages""")
def _(spark, sf):
    url = F.col("url")
    return tb.read(spark, sf, "pages").select("page_id", paths.url_allowed(url, url).alias("same_site"), paths.url_allowed(url, F.lit("https://m.ththth.example.net/docs")).alias("one_site"))


_HOSTS = ["127.0.0.1", "10.1.2.{n}", "172.16.0.{n}", "172.32.0.{n}", "192.168.1.{n}", "169.254.169.254", "8.8.8.{n}", "localhost", "printer.local", "metadata.google.internal", "224.0.0.{n}"]


def _sql_hosts() -> str:
    return " ".join(f"WHEN {i} THEN '{h.split('{n}')[0]}'" + (" || (page_id % 256)" if "{n}" in h else "") for i, h in enumerate(_HOSTS))


@register("ssrf_safe", f"""WITH p AS (SELECT page_id, 'http://' || CASE page_id % 12 {_sql_hosts()} ELSE {s_netloc('url')} END || '/x' AS url FROM pages),
  h AS (SELECT page_id, url, {s_netloc('url')} AS host FROM p)
  SELECT page_id, url, NOT (host IN ('localhost', 'metadata.google.internal') OR host LIKE '%.local'
    OR regexp_matches(host, '^(127|10)\\.') OR host LIKE '192.168.%' OR host LIKE '169.254.%' OR regexp_matches(host, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') OR host LIKE '224.%') AS safe FROM h""")
def _(spark, sf):
    page, n = F.col("page_id"), (F.col("page_id") % 256).cast("string")
    host = paths.netloc_of(F.col("url"))
    for i, h in enumerate(_HOSTS):
        head = h.split("{n}")[0]
        host = F.when(page % 12 == i, F.concat(F.lit(head), n) if "{n}" in h else F.lit(head)).otherwise(host)
    url = F.concat(F.lit("http://"), host, F.lit("/x"))
    return tb.read(spark, sf, "pages").select("page_id", url.alias("url")).withColumn("safe", guards.ssrf_safe(F.col("url")))


# The ending of a page's address and the character set it declares stand in for the header of its answer.
S_TYPE = f"""CASE WHEN ends_with({s_path('url')}, '/') THEN '' WHEN ends_with({s_path('url')}, '.html') THEN 'Application/XHTML+XML' WHEN contains(url, '?page') THEN 'application/json'
  WHEN contains(url, 'utm_') THEN 'image/png' WHEN contains(url, '#') THEN 'application/vnd.x+html' ELSE 'TEXT/' || CASE WHEN contains(html, '<table') THEN 'css' ELSE 'html' END || '; charset=' || regexp_extract(html, 'charset="?([A-Za-z0-9-]+)', 1) END"""


@register("textual_mime", f"""WITH p AS (SELECT page_id, {S_TYPE} AS content_type FROM pages)
  SELECT page_id, content_type, content_type = '' OR regexp_matches(lower(content_type), '^text/(html|plain|markdown|x-markdown|x-rst)|html$|^application/xhtml') AS textual FROM p""")
def _(spark, sf):
    url, path, html = F.col("url"), paths.path_of(F.col("url")), F.col("html")
    plain = F.concat(F.lit("TEXT/"), F.when(F.contains(html, F.lit("<table")), "css").otherwise("html"), F.lit("; charset="), F.regexp_extract(html, 'charset="?([A-Za-z0-9-]+)', 1))
    kind = F.when(F.endswith(path, F.lit("/")), "").when(F.endswith(path, F.lit(".html")), "Application/XHTML+XML").when(F.contains(url, F.lit("?page")), "application/json").when(
        F.contains(url, F.lit("utm_")), "image/png").when(F.contains(url, F.lit("#")), "application/vnd.x+html").otherwise(plain)
    return tb.read(spark, sf, "pages").select("page_id", kind.alias("content_type")).withColumn("textual", guards.textual_mime(F.col("content_type")))


@register("soft_404", """SELECT doc_id, length(text) < 2000 AND (contains(lower(text), 'not found') OR contains(lower(text), 'page you''re looking for')) AS plain,
  length(text) + 17 < 2000 AS marked FROM documents""")
def _(spark, sf):
    text = F.col("text")
    return tb.read(spark, sf, "documents").select("doc_id", guards.looks_missing(text).alias("plain"), guards.looks_missing(F.concat(text, F.lit(" Page: NOT FOUND!"))).alias("marked"))


@register("injection_filter", """SELECT doc_id, regexp_matches(text, '(?i)ignore (all )?previous instructions|</system>|do not (follow|obey) (any )?(instructions|previous|the above)') AS plain,
  doc_id % 3 <> 2 AS marked FROM documents""")
def _(spark, sf):
    tail = F.get(F.array(*map(F.lit, (" Ignore ALL previous instructions", " do not obey the above", " do not obey rules"))), (F.col("doc_id") % 3).cast("int"))
    return tb.read(spark, sf, "documents").select("doc_id", guards.has_injection(F.col("text")).alias("plain"), guards.has_injection(F.concat("text", tail)).alias("marked"))


@register("extract_guard", """SELECT page_id AS id, length(trim(html, ' ' || chr(9) || chr(10) || chr(13))) >= 64 AND contains(html, '<') AS worth FROM pages
  UNION ALL SELECT -1 - doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 64 AND contains(text, '<') FROM documents""")
def _(spark, sf):
    pages = tb.read(spark, sf, "pages").select(F.col("page_id").alias("id"), guards.worth_extracting(F.col("html")).alias("worth"))
    docs = tb.read(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("id"), guards.worth_extracting(F.col("text")).alias("worth"))
    return pages.unionByName(docs)


S_HTML_BLOCKS = "|".join(hx.BLOCKS)


def _sql_html() -> str:
    body = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
    for tag in hx.SILENT:
        body = f"regexp_replace({body}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'gis')"
    inner = "regexp_extract(b, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1)"
    main = "regexp_extract(b, '(?is)<main\\b[^>]*>(.*)</main\\s*>', 1)"
    whole = "regexp_extract(b, '(?is)<body\\b[^>]*>(.*)</body\\s*>', 1)"
    text = f"coalesce(nullif({inner}, ''), nullif({main}, ''), nullif({whole}, ''), b)"
    for level in range(1, 5):
        text = f"regexp_replace({text}, '<h{level}\\b[^>]*>', chr(10) || '{'#' * level} ', 'gi')"
    text = f"regexp_replace({text}, '</?({S_HTML_BLOCKS})\\b[^>]*>', chr(10), 'gi')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for mark, char in hx.REFERENCES:
        text = f"replace({text}, '{mark}', '{char.replace(chr(39), chr(39) * 2)}')"
    text = f"regexp_replace({text}, '[ \\t\\r]+', ' ', 'g')"
    text = f"regexp_replace({text}, ' ?\\n ?', chr(10), 'g')"
    text = f"regexp_replace({text}, '\\n{{2,}}', chr(10) || chr(10), 'g')"
    return f"WITH p AS (SELECT page_id, {body} AS b FROM pages) SELECT page_id, regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '') AS text FROM p"


@register("html_extract", _sql_html())
def _(spark, sf):
    return spread(tb.read(spark, sf, "pages").select("page_id", "html")).select("page_id", hx.extract(F.col("html")).alias("text"))


@register("link_extract", f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"#?]+)', 1)) AS href FROM pages),
  j AS (SELECT page_id, url, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href END AS target FROM l),
  t AS (SELECT page_id, url, {s_norm_url('target')} AS target FROM j)
  SELECT page_id, target, count(*) AS n, {s_allowed('target', 'url')} AND NOT regexp_matches(target, '_static|_sources|genindex|search\\.html|404|whatsnew/|release/') AS follow FROM t GROUP BY ALL""")
def _(spark, sf):
    found = tb.read(spark, sf, "pages").select("page_id", "url", F.explode_outer(paths.hrefs(F.col("html"))).alias("href")).filter("href IS NOT NULL")
    df = found.withColumn("target", paths.norm_url(paths.url_join(F.col("url"), F.col("href"))))
    follow = paths.url_allowed(F.col("target"), F.col("url")) & ~paths.link_denied(F.col("target"))
    return df.withColumn("follow", follow).groupBy("page_id", "target", "follow").agg(F.count("*").alias("n"))


_TERMS = "example guide thresh"


@register("crawl_priority", """SELECT page_id, CASE WHEN regexp_matches(lower(u), 'guide|thresh') THEN -1 WHEN regexp_matches(u, '/basics|basics\\.|/tutorial|/getting-started|/user/') THEN 0
  WHEN regexp_matches(u, '/reference/|/guide/|/api/|/en/latest/') THEN 1 ELSE 2 END AS priority FROM (
    SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/tutorial' WHEN 1 THEN '/api/x' WHEN 2 THEN '/Guide/x' WHEN 3 THEN '/user/x' ELSE '' END AS u FROM pages)""")
def _(spark, sf):
    tail = F.get(F.array(*map(F.lit, ("/tutorial", "/api/x", "/Guide/x", "/user/x", ""))), (F.col("page_id") % 5).cast("int"))
    return tb.read(spark, sf, "pages").select("page_id", paths.crawl_priority(F.concat("url", tail), tx.crawl_terms(F.lit("the guide of thresh"))).alias("priority"))


def _page_list(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as the list of one library per host."""
    return tb.read(spark, sf, "pages").select(paths.netloc_of(F.col("url")).alias("lib_id"), "url", "page_id", "html")


@register("page_order", f"""WITH p AS (SELECT {s_netloc('url')} AS lib_id, url, contains(lower(url), 'feed')::INT + contains(lower(url), 'page')::INT AS n FROM (SELECT DISTINCT url FROM pages))
  SELECT lib_id, url, row_number() OVER (PARTITION BY lib_id ORDER BY (n = 0)::INT, -n, length(url), url) AS page_rank FROM p""")
def _(spark, sf):
    listed = _page_list(spark, sf).select("lib_id", "url").distinct()
    return ingest.page_order(listed, F.lit("feed page of")).select("lib_id", "url", F.col("page_rank").cast("long").alias("page_rank"))


@register("page_cap", f"""WITH p AS (SELECT {s_netloc('url')} AS lib_id, page_id AS page_rank, length(html) // 500 AS n_chunks FROM pages),
  w AS (SELECT *, coalesce(sum(n_chunks) OVER (PARTITION BY lib_id ORDER BY page_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_chunks) OVER (PARTITION BY lib_id) AS total FROM p)
  SELECT lib_id, page_rank, n_chunks, before::BIGINT AS before, total < 20 AS complete FROM w WHERE before < 20""")
def _(spark, sf):
    sizes = _page_list(spark, sf).select("lib_id", F.col("page_id").alias("page_rank"), F.floor(F.length("html") / 500).alias("n_chunks"))
    return ingest.within_cap(sizes, 20).select("lib_id", "page_rank", "n_chunks", "before", "complete")


@register("skip_existing_anti", f"""WITH p AS (SELECT {s_netloc('url')} AS lib_id, url, {s_norm_url('url')} AS page FROM pages),
  e AS (SELECT DISTINCT {s_norm_url('url')} AS page FROM pages WHERE url LIKE 'http://%')
  SELECT DISTINCT lib_id, page FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page = p.page)""")
def _(spark, sf):
    listed = _page_list(spark, sf).select("lib_id", "url")
    stored = listed.filter(F.startswith("url", F.lit("http://"))).withColumnRenamed("url", "path")
    return ingest.select_pages(listed, stored, F.lit("")).select("lib_id", "page")


@register("sitemap_minus_llms", f"""WITH p AS (SELECT {s_netloc('url')} AS lib_id, url, {s_norm_url('url')} AS page FROM pages),
  l AS (SELECT * FROM p WHERE url LIKE '%/en/%') SELECT lib_id, url FROM l UNION ALL
  SELECT lib_id, url FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.lib_id = p.lib_id AND l.page = p.page)""")
def _(spark, sf):
    pages = _page_list(spark, sf).select("lib_id", "url")
    return listings.union_pages(pages.filter(F.contains("url", F.lit("/en/"))), pages)


@register("sitemap_locs", f"""SELECT {s_netloc('url')} AS lib_id, url FROM pages""")
def _(spark, sf):
    parts = _page_list(spark, sf)
    xml = F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '),
        F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url></urlset>"))
    return parts.select("lib_id", F.explode_outer(listings.sitemap_locs(xml)).alias("url"))


@register("llms_links", f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]+)">([^<]+)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]+)">([^<]+)</a>', 2)) AS title FROM pages),
  t AS (SELECT page_id, url AS base, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS url, title FROM l WHERE NOT regexp_matches(href, '\\s') AND NOT contains(title, ']') AND NOT contains(href, ')'))
  SELECT page_id, url, title FROM t WHERE {s_allowed('url', 'base')}""")
def _(spark, sf):
    pages = _page_list(spark, sf)
    origin = F.concat(paths.scheme_of(F.col("url")), F.lit("://"), paths.netloc_of(F.col("url")))
    link = r'<a href="([^"]+)">([^<]+)</a>'
    rows = F.zip_with(
        F.regexp_extract_all("html", F.lit(link), F.lit(1)), F.regexp_extract_all("html", F.lit(link), F.lit(2)),
        lambda h, t: F.when(~F.rlike(h, F.lit(r"\s|\)")), F.concat(F.lit("- ["), t, F.lit("]("), origin, h, F.lit(")"))).otherwise(""))
    listed = pages.select("page_id", "url", F.array_join(rows, "\n").alias("listing"))
    found = listed.select("page_id", F.explode_outer(listings.markdown_links(F.col("listing"), F.col("url"))).alias("l"))
    return found.filter("l IS NOT NULL").select("page_id", "l.url", "l.title")


@register("bfs_levels", """WITH RECURSIVE e AS (SELECT p.page_id AS src, c.page_id AS dst FROM pages p JOIN pages c ON c.page_id IN (2 * p.page_id + 1, 2 * p.page_id + 2)),
  r AS (SELECT 0::BIGINT AS node, 0 AS level UNION SELECT dst, level + 1 FROM r JOIN e ON src = node) SELECT node, min(level) AS level FROM r GROUP BY node""")
def _(spark, sf):
    pages = tb.read(spark, sf, "pages").select(F.col("page_id").alias("dst"))
    links = tb.read(spark, sf, "pages").select(F.col("page_id").alias("src"), F.explode(F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2)).alias("dst"))
    return crawl.levels(links.join(pages, "dst", "left_semi"), pages.filter("dst = 0").select(F.col("dst").alias("node")))


# ---------------------------------------------------------------- text

# Documents as Markdown: a heading first, one more after each sentence that ends a line, and the
# German texts inside a code fence, where such lines are no headings.
S_MARKDOWN = """md AS (SELECT doc_id, source, CASE WHEN lang = 'de' THEN '```' || chr(10) || body || chr(10) || '```' || chr(10) || '## After' ELSE body END AS text
  FROM (SELECT doc_id, source, lang, '# ' || replace(text, '.' || chr(10), '.' || chr(10) || chr(10) || '## ') AS body FROM documents))"""


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit("# "), F.replace("text", F.lit(".\n"), F.lit(".\n\n## ")))
    fenced = F.concat(F.lit("```\n"), body, F.lit("\n```\n## After"))
    docs = tb.read(spark, sf, "documents")
    return spread(docs.select("doc_id", "source", F.when(F.col("lang") == "de", fenced).otherwise(body).alias("text")))


S_LINES = """, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM md),
fence AS (SELECT *, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 AS open FROM ln),
sec AS (SELECT *, sum((regexp_matches(line, '^#{1,4} ') AND open = 0)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM fence),
first_sec AS (SELECT doc_id, min(s) AS s0 FROM sec GROUP BY doc_id),
sections AS (SELECT doc_id, s - s0 AS section_no, string_agg(line, chr(10) ORDER BY n) AS section FROM sec JOIN first_sec USING (doc_id) GROUP BY ALL)"""
S_SECTIONS = S_MARKDOWN + S_LINES


@register("chunk_sections", f"WITH {S_SECTIONS} SELECT doc_id, section_no::BIGINT AS section_no, section FROM sections")
def _(spark, sf):
    return _markdown(spark, sf).select("doc_id", F.posexplode_outer(tx.sections(F.col("text"))).alias("n", "section")).select(
        "doc_id", F.col("n").cast("long").alias("section_no"), "section")


# Packing as a recursion over paragraphs; an oversize paragraph is cut by a recursion of its own.
S_PIECES = """,
whole AS (SELECT doc_id, section_no, section FROM sections WHERE length(section) <= 2048),
paras AS (SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY i) AS i, p FROM (
    SELECT doc_id, section_no, i, regexp_replace(regexp_replace(p, '^\\s+', ''), '\\s+$', '') AS p FROM (
      SELECT doc_id, section_no, unnest(regexp_split_to_array(section, '\\n\\s*\\n')) AS p, generate_subscripts(regexp_split_to_array(section, '\\n\\s*\\n'), 1) AS i
      FROM sections WHERE length(section) > 2048)) WHERE p <> ''),
costs AS (SELECT *, greatest(1, length(p) // 4) AS cost FROM paras),
pack AS (SELECT doc_id, section_no, i, cost, CASE WHEN cost > 512 THEN 0 ELSE cost END AS used, 1 AS grp, cost > 512 AS big FROM costs WHERE i = 1
  UNION ALL SELECT c.doc_id, c.section_no, c.i, c.cost,
    CASE WHEN c.cost > 512 THEN 0 WHEN k.big OR k.used + c.cost > 512 THEN c.cost ELSE k.used + c.cost END,
    CASE WHEN c.cost > 512 OR k.big OR k.used + c.cost > 512 THEN k.grp + 1 ELSE k.grp END, c.cost > 512
  FROM pack k JOIN costs c ON c.doc_id = k.doc_id AND c.section_no = k.section_no AND c.i = k.i + 1),
small AS (SELECT doc_id, section_no, grp, 0 AS piece_no, string_agg(p, chr(10) || chr(10) ORDER BY i) AS piece FROM pack JOIN costs USING (doc_id, section_no, i) WHERE NOT big GROUP BY ALL),
cut AS (SELECT doc_id, section_no, grp, 0 AS piece_no, NULL::VARCHAR AS piece, p AS rest FROM pack JOIN costs USING (doc_id, section_no, i) WHERE big
  UNION ALL SELECT doc_id, section_no, grp, piece_no + 1, left(rest, at_char::BIGINT), ltrim(substring(rest, at_char::BIGINT + 1), chr(10)) FROM (
    SELECT *, CASE WHEN length(rest) <= 2048 THEN length(rest) WHEN nl < 2048 AND 2048 - nl - 1 > 0 THEN 2048 - nl - 1 ELSE 2048 END AS at_char
    FROM (SELECT *, CASE WHEN contains(left(rest, 2048), chr(10)) THEN instr(reverse(left(rest, 2048)), chr(10)) - 1 ELSE 2048 END AS nl FROM cut WHERE rest <> ''))),
pieces AS (SELECT doc_id, section_no, 0 AS grp, 0 AS piece_no, section AS piece FROM whole UNION ALL SELECT * FROM small
  UNION ALL SELECT doc_id, section_no, grp, piece_no, piece FROM cut WHERE piece IS NOT NULL),
packed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, grp, piece_no) - 1 AS chunk_no, piece AS text FROM pieces)"""
S_PACK = f"WITH RECURSIVE {S_SECTIONS}{S_PIECES} SELECT doc_id, chunk_no, text FROM packed"


@register("chunk_pack", S_PACK)
def _(spark, sf):
    return _markdown(spark, sf).select("doc_id", F.posexplode_outer(tx.chunk_text(F.col("text"))).alias("n", "text")).select(
        "doc_id", F.col("n").cast("long").alias("chunk_no"), "text")


@register("section_title", f"""WITH {S_MARKDOWN}, h AS (SELECT doc_id, list_filter(string_split(text, chr(10))[1:3], lambda x: regexp_matches(x, '^#{{1,4}}\\s+')) AS heads FROM md)
  SELECT doc_id, coalesce(left(trim(regexp_replace(heads[1], '^#{{1,4}}\\s+', '')), 80), '') AS section_title FROM h""")
def _(spark, sf):
    return _markdown(spark, sf).select("doc_id", tx.section_title(F.col("text")).alias("section_title"))


@register("page_title", f"WITH {S_MARKDOWN} SELECT doc_id, left(regexp_replace(string_split(text, chr(10))[1], '^#+\\s*', ''), 80) AS title FROM md")
def _(spark, sf):
    return _markdown(spark, sf).select("doc_id", tx.page_title(F.col("text")).alias("title"))


@register("tokens_est", "SELECT doc_id, length(text) // 4 AS tokens, greatest(1, length(text) // 4) AS chunk_tokens FROM documents")
def _(spark, sf):
    text = F.col("text")
    return tb.read(spark, sf, "documents").select("doc_id", tx.tokens_est(text).alias("tokens"), tx.tokens_est(text, 1).alias("chunk_tokens"))


# CRC-32 by table: each entry is eight shifts of its number with the reflected polynomial.
S_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
S_SIMHASH = f"""crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: {S_CRC_STEP}) AS v FROM range(256) r(i))),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]{{3,}}')) AS w FROM documents),
vocab AS (SELECT DISTINCT w FROM words),
hashed AS (SELECT w, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(w, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS lo,
    xor(4294967295, list_reduce([4294967295] || list_transform(string_split('s' || w, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS hi FROM vocab, crc_table),
bits AS (SELECT i FROM range(32) r(i)),
votes AS (SELECT doc_id, i, sum((lo >> i) & 1) AS low_votes, sum((hi >> i) & 1) AS high_votes, count(*) AS n FROM words JOIN hashed USING (w), bits GROUP BY doc_id, i),
words_of AS (SELECT doc_id, sum(CASE WHEN 2 * low_votes > n THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS lo, sum(CASE WHEN 2 * high_votes > n THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS hi FROM votes GROUP BY doc_id),
sim AS (SELECT doc_id, source, text, coalesce((CASE WHEN hi >= 2147483648 THEN hi - 4294967296 ELSE hi END)::BIGINT * 4294967296 + lo, 0)::BIGINT AS simhash FROM documents LEFT JOIN words_of USING (doc_id))"""


@register("simhash64", f"WITH {S_SIMHASH} SELECT doc_id, simhash FROM sim")
def _(spark, sf):
    return hashing.add_simhash(spread(tb.read(spark, sf, "documents").select("doc_id", "text")), "doc_id")


# Greedy removal as a recursion over each library's texts in order, carrying the kept fingerprints.
S_GREEDY = f"""WITH RECURSIVE {S_SIMHASH},
cand AS (SELECT doc_id, source, simhash, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM sim WHERE length(text) >= 300 AND simhash <> 0),
walk AS (SELECT source, n, doc_id, [simhash] AS kept, true AS stays FROM cand WHERE n = 1
  UNION ALL SELECT source, n, doc_id, CASE WHEN far THEN list_append(kept, simhash) ELSE kept END, far FROM (
    SELECT c.source, c.n, c.doc_id, c.simhash, k.kept, len(list_filter(k.kept, lambda h: bit_count(xor(h, c.simhash)) <= 6)) = 0 AS far
    FROM walk k JOIN cand c ON c.source = k.source AND c.n = k.n + 1))
SELECT doc_id, source AS lib_id FROM sim WHERE length(text) < 300 OR simhash = 0 UNION ALL SELECT doc_id, source FROM walk WHERE stays"""


def _survivors(spark: SparkSession, sf: str, finish_rows: int = neardup.FINISH_ROWS) -> DataFrame:
    docs = spread(tb.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("lib_id"), "text"))
    return neardup.survivors(docs, finish_rows=finish_rows).select(F.col("chunk_id").alias("doc_id"), "lib_id")


@register("near_dup_greedy", S_GREEDY)
def _(spark, sf):
    return _survivors(spark, sf)


@register("near_dup_rounds", S_GREEDY)
def _(spark, sf):
    """The same by rounds alone, the way a set beyond the finishing bound is settled."""
    return _survivors(spark, sf, finish_rows=0)


# ---------------------------------------------------------------- writes

@register("prune_semi", f"""WITH {S_CHUNKS}, keep AS (SELECT DISTINCT lib_id, {s_norm_path('path')} AS page FROM chunks WHERE text LIKE '%the%')
  SELECT chunk_id, lib_id FROM chunks c WHERE lib_id LIKE 'src1%' AND EXISTS (SELECT 1 FROM keep k WHERE k.lib_id = c.lib_id AND k.page = {s_norm_path('c.path')})
  UNION ALL SELECT chunk_id, lib_id FROM chunks WHERE lib_id NOT LIKE 'src1%'""")
def _(spark, sf):
    docs = tb.chunks(spark, sf)
    keep = docs.filter(F.contains("text", F.lit("the"))).select("lib_id", "path")
    done = docs.select("lib_id").distinct().filter(F.startswith("lib_id", F.lit("src1")))
    return upsert.prune_chunks(docs.select("chunk_id", "lib_id", "path"), keep, done).select("chunk_id", "lib_id")


@register("replace_pages", f"""WITH {S_CHUNKS}, inc AS (SELECT DISTINCT source AS lib_id, regexp_replace(regexp_replace(path, '/+$', ''), '\\.html$', '') AS base FROM documents JOIN chunks ON chunk_id = doc_id WHERE lang = 'en'),
  gone AS (SELECT lib_id, unnest([base, base || '.html', base || '/']) AS path FROM inc)
  SELECT chunk_id, lib_id, path, 'old' AS origin FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lib_id = c.lib_id AND g.path = c.path)
  UNION ALL SELECT chunk_id + 1000000000, lib_id, path, 'new' FROM chunks JOIN documents ON doc_id = chunk_id WHERE lang = 'en'""")
def _(spark, sf):
    docs = tb.chunks(spark, sf).select("chunk_id", "lib_id", "path")
    english = tb.read(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    incoming = docs.join(english, "chunk_id").select((F.col("chunk_id") + 1_000_000_000).alias("chunk_id"), "lib_id", "path", F.lit("new").alias("origin"))
    return upsert.replace_pages(docs.withColumn("origin", F.lit("old")), incoming)


# The stored fingerprints start the walk; pages that the same write brings anew are not among them.
# A page is replaced only by a text that stays: a dropped copy leaves the stored page as it is.
S_ADDED = f"""WITH RECURSIVE {S_SIMHASH}, {S_CHUNKS},
inc AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN path ELSE 'copy/' || doc_id END AS path FROM documents JOIN chunks ON chunk_id = doc_id WHERE lang IN ('en', 'de')),
gone AS (SELECT DISTINCT source, unnest([base, base || '.html', base || '/']) AS path FROM (SELECT source, regexp_replace(regexp_replace(path, '/+$', ''), '\\.html$', '') AS base FROM inc)),
standing AS (SELECT c.* FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.source = c.lib_id AND g.path = c.path)),
held AS (SELECT source, list(simhash) AS kept FROM sim JOIN standing ON doc_id = chunk_id WHERE length(sim.text) >= 300 AND simhash <> 0 GROUP BY source),
cand AS (SELECT doc_id, source, simhash, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM sim SEMI JOIN inc USING (doc_id) WHERE length(text) >= 300 AND simhash <> 0),
walk AS (SELECT source, 0::BIGINT AS n, -1::BIGINT AS doc_id, coalesce(kept, []::BIGINT[]) AS kept, false AS stays FROM (SELECT DISTINCT source FROM cand) LEFT JOIN held USING (source)
  UNION ALL SELECT source, n, doc_id, CASE WHEN far THEN list_append(kept, simhash) ELSE kept END, far FROM (
    SELECT c.source, c.n, c.doc_id, c.simhash, k.kept, len(list_filter(k.kept, lambda h: bit_count(xor(h, c.simhash)) <= 6)) = 0 AS far
    FROM walk k JOIN cand c ON c.source = k.source AND c.n = k.n + 1)),
fresh AS (SELECT doc_id FROM sim SEMI JOIN inc USING (doc_id) WHERE length(text) < 300 OR simhash = 0 UNION ALL SELECT doc_id FROM walk WHERE stays),
wrote AS (SELECT doc_id, source, path, regexp_replace(regexp_replace(path, '/+$', ''), '\\.html$', '') AS base FROM fresh JOIN inc USING (doc_id)),
lost AS (SELECT DISTINCT source, unnest([base, base || '.html', base || '/']) AS path FROM wrote)
SELECT lib_id, path, md5(text) AS digest, false AS is_new FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.source = c.lib_id AND l.path = c.path)
UNION ALL SELECT inc.source, inc.path, md5(text), true FROM fresh JOIN inc USING (doc_id) JOIN sim USING (doc_id)"""


@register("add_chunks_stored", S_ADDED)
def _(spark, sf):
    """English pages are written again, German ones once more under another path, into a store that holds all."""
    docs = stored(tb.chunks(spark, sf).join(hashing.add_simhash(spread(tb.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")), "chunk_id"), "chunk_id"))
    mark = F.when((F.length("text") >= 300) & (F.col("simhash") != 0), F.col("simhash"))
    existing = docs.withColumn("simhash", mark).withColumn("fetched_at", F.lit(_NOW).cast("timestamp"))
    lang = tb.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    path = F.when(F.col("lang") == "en", F.col("path")).otherwise(F.concat(F.lit("copy/"), F.col("chunk_id").cast("string")))
    incoming = docs.drop("simhash").join(lang.filter("lang IN ('en', 'de')"), "chunk_id").select(
        "lib_id", "ver", path.alias("path"), "title", "text", F.lit(_NOW).cast("timestamp").alias("fetched_at"), F.col("chunk_id").alias("ord"))
    last = docs.agg(F.max("chunk_id")).first()[0] or 0
    out = upsert.add_chunks(existing, incoming, last)
    return out.select("lib_id", "path", F.md5("text").alias("digest"), (F.col("chunk_id") > last).alias("is_new"))


@register("store_upsert_search", "WITH documents AS (SELECT * FROM main.documents WHERE lang <> 'fr'), " + S_RANKED.removeprefix("WITH ") + s_hits("", 10) + S_HIT_COLUMNS)
def _(spark, sf):
    """A store of all but the German documents takes these, then loses the French ones, and is asked."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", n_buckets=8)
    lang = tb.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    chunks, vectors = tb.chunks_of_languages(spark, sf), tb.chunk_vectors(spark, sf).join(lang, "chunk_id")
    everything = list(range(store.n_buckets))
    store.write("chunks", chunks.filter("lang <> 'de'"))
    store.write("chunk_vec", vectors.filter("lang <> 'de'"))
    store.build_index()
    store.write_chunks(chunks, everything)
    store.append("chunk_vec", vectors.filter("lang = 'de'"))
    store.write_chunks(chunks.filter("lang <> 'fr'"), everything)
    return store.search(tb.queries(spark, sf), k=10).drop("text")


S_LIBS = """libs AS (SELECT 's' || s_suppkey AS id, s_name AS name, 'own/' || s_suppkey AS repo, 'https://docs' || (s_suppkey % 40) || '.dev' AS docs_url, s_acctbal AS trust,
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '1.' || s_nationkey END AS latest_ver, s_suppkey % 2 = 0 AS "full", s_suppkey % 5 AS stable FROM supplier)"""


def _libs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as stored libraries."""
    key = F.col("s_suppkey")
    latest = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("1."), F.col("s_nationkey").cast("string")))
    none = F.array().cast("array<string>")
    return tb.read(spark, sf, "supplier").select(
        F.concat(F.lit("s"), key.cast("string")).alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("own/"), key.cast("string")).alias("repo"),
        F.concat(F.lit("https://docs"), (key % 40).cast("string"), F.lit(".dev")).alias("docs_url"), F.col("s_acctbal").alias("trust"),
        latest.alias("latest_ver"), F.when(latest == "", none).otherwise(F.array(latest)).alias("versions"),
        (key % 2 == 0).alias("full"), (key % 5).cast("int").alias("stable"))


def _lib_rows(libs: DataFrame) -> DataFrame:
    return libs.select("id", "name", "repo", "docs_url", F.round("trust", 6).alias("trust"), "latest_ver", "full", F.col("stable").cast("long").alias("stable"))


@register("upsert_merge", f"""WITH {S_LIBS}, inc AS (SELECT 's' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'new/' || c_custkey END AS repo, '' AS docs_url, c_acctbal AS trust,
    CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '2.0' END AS latest_ver FROM customer)
  SELECT id, coalesce(nullif(i.name, ''), l.name) AS name, coalesce(nullif(i.repo, ''), l.repo) AS repo, l.docs_url, round(coalesce(i.trust, l.trust), 6) AS trust,
    coalesce(nullif(i.latest_ver, ''), l.latest_ver) AS latest_ver, l."full", l.stable FROM libs l FULL OUTER JOIN inc i USING (id)""")
def _(spark, sf):
    key = F.col("c_custkey")
    ver = F.when(key % 4 == 0, "").otherwise("2.0")
    incoming = tb.read(spark, sf, "customer").select(
        F.concat(F.lit("s"), key.cast("string")).alias("id"), F.col("c_name").alias("name"),
        F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("new/"), key.cast("string"))).alias("repo"), F.lit("").alias("docs_url"),
        F.col("c_acctbal").alias("trust"), ver.alias("latest_ver"), F.array(ver).alias("versions"))
    return _lib_rows(upsert.merge_libs(_libs(spark, sf), incoming))


@register("cascade_delete", f"WITH {S_CHUNKS} SELECT lib_id, count(*) AS n FROM chunks WHERE lib_id NOT IN (SELECT DISTINCT 'src' || n_regionkey FROM nation) GROUP BY lib_id")
def _(spark, sf):
    gone = tb.read(spark, sf, "nation").select(F.concat(F.lit("src"), F.col("n_regionkey").cast("string")).alias("id"))
    return upsert.drop_libs(tb.chunks(spark, sf), gone).groupBy("lib_id").agg(F.count("*").alias("n"))


@register("flags_update", f"""WITH {S_LIBS}, ch AS (SELECT 's' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN false END AS "full", CASE WHEN c_custkey % 2 = 0 THEN 9 END AS stable FROM customer)
  SELECT id, name, repo, docs_url, round(trust, 6) AS trust, latest_ver, coalesce(ch."full", libs."full") AS "full", coalesce(ch.stable, libs.stable) AS stable FROM libs LEFT JOIN ch USING (id)""")
def _(spark, sf):
    key = F.col("c_custkey")
    changes = tb.read(spark, sf, "customer").select(
        F.concat(F.lit("s"), key.cast("string")).alias("id"), F.when(key % 3 == 0, False).alias("full"), F.when(key % 2 == 0, 9).alias("stable"))
    return _lib_rows(upsert.set_flags(_libs(spark, sf), changes))


@register("lib_stats", f"WITH {S_CHUNKS} SELECT lib_id, count(*) AS n_chunks, count(DISTINCT path) AS n_paths FROM chunks GROUP BY lib_id")
def _(spark, sf):
    return lib_stats(tb.chunks(spark, sf).withColumn("fetched_at", F.lit(None).cast("timestamp"))).select("lib_id", "n_chunks", "n_paths")


# ---------------------------------------------------------------- registry

S_FOUND = """found AS (
  SELECT 'lib' || (c_custkey // 3) AS name, c_custkey * 3 AS src_ord, CASE WHEN c_custkey % 5 < 2 THEN '' ELSE 'own' || (c_custkey % 2) || '/lib' || (c_custkey // 3) END AS repo,
    CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://github.com/own/lib' || (c_custkey // 3) ELSE 'https://' || lower(c_mktsegment) || '.dev/' END AS docs_url,
    round(log10(greatest(c_acctbal, 1)), 4) AS trust, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '1.' || (c_custkey % 10) END AS latest_ver FROM customer
  UNION ALL SELECT 'lib' || (p_partkey // 4), p_partkey * 3 + 1, CASE WHEN p_partkey % 7 < 3 THEN '' ELSE 'own' || (p_partkey % 2) || '/lib' || (p_partkey // 4) END,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'https://' || lower(p_type) || '.dev//' END, round(log10(p_retailprice), 4), CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '2.' || p_size END FROM part
  UNION ALL SELECT 'lib' || s_suppkey, s_suppkey * 3 + 2, 'own1/lib' || s_suppkey, '', 0, '3.' || s_nationkey FROM supplier)"""
S_NORM = f"""{S_FOUND}, cand AS (SELECT name, src_ord, name AS id, repo, regexp_replace(docs_url, '/+$', '') AS docs_url, trust, latest_ver FROM found),
keyed AS (SELECT *, CASE WHEN repo <> '' THEN repo ELSE docs_url END AS key, docs_url <> '' AND NOT regexp_matches(docs_url, '^https?://(github\\.com|raw\\.githubusercontent\\.com)/') AS site FROM cand)"""


def _found(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, parts and suppliers as answers of three sources."""
    none = F.array().cast("array<string>")
    s = lambda c: c.cast("string")
    ck, pk, sk = F.col("c_custkey"), F.col("p_partkey"), F.col("s_suppkey")
    cn, pn = F.concat(F.lit("lib"), s(F.floor(ck / 3))), F.concat(F.lit("lib"), s(F.floor(pk / 4)))
    customers = tb.read(spark, sf, "customer").select(
        cn.alias("name"), (ck * 3).alias("src_ord"), F.when(ck % 5 < 2, "").otherwise(F.concat(F.lit("own"), s(ck % 2), F.lit("/"), cn)).alias("repo"),
        F.when(ck % 4 == 0, "").when(ck % 4 == 1, F.concat(F.lit("https://github.com/own/"), cn)).otherwise(F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".dev/"))).alias("docs_url"),
        F.round(F.log10(F.greatest("c_acctbal", F.lit(1.0))), 4).alias("trust"), F.when(ck % 3 == 0, "").otherwise(F.concat(F.lit("1."), s(ck % 10))).alias("latest_ver"))
    parts = tb.read(spark, sf, "part").select(
        pn.alias("name"), (pk * 3 + 1).alias("src_ord"), F.when(pk % 7 < 3, "").otherwise(F.concat(F.lit("own"), s(pk % 2), F.lit("/"), pn)).alias("repo"),
        F.when(pk % 3 == 0, "").otherwise(F.concat(F.lit("https://"), F.lower("p_type"), F.lit(".dev//"))).alias("docs_url"),
        F.round(F.log10("p_retailprice"), 4).alias("trust"), F.when(pk % 2 == 0, "").otherwise(F.concat(F.lit("2."), s(F.col("p_size")))).alias("latest_ver"))
    sn = F.concat(F.lit("lib"), s(sk))
    suppliers = tb.read(spark, sf, "supplier").select(
        sn.alias("name"), (sk * 3 + 2).alias("src_ord"), F.concat(F.lit("own1/"), sn).alias("repo"), F.lit("").alias("docs_url"), F.lit(0.0).alias("trust"),
        F.concat(F.lit("3."), s(F.col("s_nationkey"))).alias("latest_ver"))
    rows = customers.unionByName(parts).unionByName(suppliers)
    return rows.withColumn("id", F.lit(None).cast("string")).withColumn("versions", none)


@register("candidate_normalize", f"WITH {S_NORM} SELECT name, src_ord, id, repo, docs_url, trust, latest_ver, latest_ver AS versions FROM cand")
def _(spark, sf):
    df = cd.normalize(_found(spark, sf))
    return df.select("name", "src_ord", "id", "repo", "docs_url", "trust", "latest_ver", F.array_join("versions", ",").alias("versions"))


S_MERGED = f"""{S_NORM}, ordered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY trust DESC, src_ord) AS o FROM keyed),
whole AS (SELECT name, key, arg_min(src_ord, o) AS src_ord, any_value(id) AS id, coalesce(arg_min(repo, o) FILTER (repo <> ''), '') AS repo,
    coalesce(arg_min(docs_url, o) FILTER (site), arg_min(docs_url, o) FILTER (docs_url <> ''), '') AS docs_url, max(trust) AS trust,
    coalesce(arg_min(latest_ver, o) FILTER (latest_ver <> ''), '') AS latest_ver FROM ordered WHERE key <> '' GROUP BY name, key),
bare AS (SELECT name, id, arg_min(latest_ver, o) FILTER (latest_ver <> '') AS ver FROM ordered WHERE key = '' GROUP BY ALL),
merged AS (SELECT w.name, w.src_ord, w.id, repo, docs_url, trust, CASE WHEN latest_ver <> '' THEN latest_ver ELSE coalesce(ver, '') END AS latest_ver FROM whole w LEFT JOIN bare b ON b.name = w.name AND b.id = w.id)"""


@register("candidate_merge", f"WITH {S_MERGED} SELECT name, src_ord, id, repo, docs_url, trust, latest_ver, latest_ver AS versions FROM merged")
def _(spark, sf):
    df = cd.merge(cd.normalize(_found(spark, sf)))
    return df.select("name", "src_ord", "id", "repo", "docs_url", "trust", "latest_ver", F.array_join("versions", ",").alias("versions"))


S_TRUSTED = f"""{S_MERGED}, stars AS (SELECT 'own1/lib' || p_partkey AS repo, p_size * 1000 AS stars FROM part), idx AS (SELECT DISTINCT 'https://' || lower(c_mktsegment) || '.dev' AS docs_url FROM customer WHERE c_mktsegment < 'G'),
scored AS (SELECT m.name, m.src_ord, m.id, m.repo, m.docs_url, m.latest_ver, greatest(0, round(greatest(trust, log10(greatest(coalesce(stars, 0), 1))) + CASE WHEN idx.docs_url IS NULL THEN 0 ELSE 2 END
    - CASE WHEN m.repo <> '' AND regexp_replace(lower(string_split(m.repo, '/')[-1]), '[._-]+', '', 'g') <> regexp_replace(lower(m.name), '[._-]+', '', 'g') THEN 2 ELSE 0 END
    - CASE WHEN contains(m.docs_url, 'github.com') THEN 1 ELSE 0 END, 2)) AS trust FROM merged m LEFT JOIN stars USING (repo) LEFT JOIN idx ON idx.docs_url = m.docs_url),
trusted AS (SELECT * FROM scored WHERE trust >= 0.5)"""


def _trusted(spark: SparkSession, sf: str) -> DataFrame:
    merged = cd.merge(cd.normalize(_found(spark, sf)))
    stars = tb.read(spark, sf, "part").select(F.concat(F.lit("own1/lib"), F.col("p_partkey").cast("string")).alias("repo"), (F.col("p_size") * 1000).alias("stars"))
    indexes = tb.read(spark, sf, "customer").filter("c_mktsegment < 'G'").select(F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".dev")).alias("docs_url"))
    return cd.enrich(merged, stars, indexes)


@register("trust_score", f"WITH {S_TRUSTED} SELECT name, id, repo, docs_url, trust, latest_ver FROM trusted")
def _(spark, sf):
    return _trusted(spark, sf).select("name", "id", "repo", "docs_url", "trust", "latest_ver")


@register("query_boost", f"""WITH {S_TRUSTED}, b AS (SELECT *, trust + CASE WHEN regexp_matches(lower(id || ' ' || repo || ' ' || docs_url), 'own1|household') THEN 0.5 ELSE 0 END AS boosted FROM trusted)
  SELECT name, id, repo, round(boosted, 2) AS trust, row_number() OVER (PARTITION BY name ORDER BY boosted DESC, src_ord, id) AS rank FROM b""")
def _(spark, sf):
    terms = cd.query_terms(F.lit("the OWN1 household"))
    df = _trusted(spark, sf).withColumn("trust", cd.boost(F.col("trust"), terms, F.col("id"), F.col("repo"), F.col("docs_url")))
    return cd.rank(df).select("name", "id", "repo", F.round("trust", 2).alias("trust"), F.col("rank").cast("long").alias("rank"))


S_HISTORY = """line AS (SELECT 'lib' || (l_orderkey // 8) AS name, l_orderkey % 5 AS src_ord, (l_suppkey % 4) || '.' || (l_linenumber) || '.' || (l_quantity::INT % 12) ||
    CASE l_partkey % 9 WHEN 0 THEN 'rc1' WHEN 1 THEN '.dev2' WHEN 2 THEN '.post1' WHEN 3 THEN '-beta' ELSE '' END AS version FROM lineitem),
stable AS (SELECT DISTINCT name, src_ord, version, list_transform(string_split(version, '.'), lambda x: x::INT) AS parts FROM line WHERE regexp_matches(version, '^[0-9.]+$'))"""


def _releases(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as releases of packages in five ecosystems."""
    s = lambda c: c.cast("string")
    tail = F.coalesce(F.get(F.array(*map(F.lit, ("rc1", ".dev2", ".post1", "-beta"))), (F.col("l_partkey") % 9).cast("int")), F.lit(""))
    version = F.concat(s(F.col("l_suppkey") % 4), F.lit("."), s(F.col("l_linenumber")), F.lit("."), s(F.col("l_quantity").cast("int") % 12), tail)
    return tb.read(spark, sf, "lineitem").select(
        F.concat(F.lit("lib"), s(F.floor(F.col("l_orderkey") / 8))).alias("name"), (F.col("l_orderkey") % 5).cast("int").alias("src_ord"), version.alias("version"))


@register("stable_versions", f"WITH {S_HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY name, src_ord ORDER BY parts DESC) AS n FROM stable) SELECT name, src_ord::BIGINT AS src_ord, string_agg(version, ',' ORDER BY n) AS versions FROM r WHERE n <= 20 GROUP BY ALL")
def _(spark, sf):
    df = cd.stable_releases(_releases(spark, sf))
    return df.select("name", F.col("src_ord").cast("long").alias("src_ord"), F.array_join("versions", ",").alias("versions"))


@register("versions_argmax", f"""WITH {S_HISTORY}, sizes AS (SELECT name, src_ord, count(*) AS n FROM stable GROUP BY ALL), best AS (SELECT name, src_ord FROM sizes QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, src_ord) = 1),
  r AS (SELECT s.*, row_number() OVER (PARTITION BY name ORDER BY parts DESC) AS n FROM stable s JOIN best USING (name, src_ord)) SELECT name, string_agg(version, ',' ORDER BY n) AS versions FROM r WHERE n <= 20 GROUP BY name""")
def _(spark, sf):
    return cd.versions_argmax(cd.stable_releases(_releases(spark, sf))).select("name", F.array_join("versions", ",").alias("versions"))


@register("version_history", f"""WITH {S_HISTORY}, sizes AS (SELECT name, src_ord, count(*) AS n FROM stable GROUP BY ALL), best AS (SELECT name, src_ord FROM sizes QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, src_ord) = 1),
  r AS (SELECT s.*, row_number() OVER (PARTITION BY name ORDER BY parts DESC) AS n FROM stable s JOIN best USING (name, src_ord)),
  eco AS (SELECT name, string_agg(version, ',' ORDER BY n) AS eco FROM r WHERE n <= 20 GROUP BY name),
  found AS (SELECT 'lib' || c_custkey AS name, CASE WHEN c_nationkey % 2 = 0 THEN '9.' || c_nationkey || ',8.0' END AS found FROM customer),
  old AS (SELECT 'lib' || s_suppkey AS name, CASE WHEN s_suppkey % 3 > 0 THEN '1.' || s_nationkey END AS old FROM supplier)
  SELECT name, coalesce(found, eco, old, '') AS versions FROM found FULL JOIN eco USING (name) FULL JOIN old USING (name)""")
def _(spark, sf):
    lib = lambda c: F.concat(F.lit("lib"), F.col(c).cast("string"))
    newest = F.concat(F.lit("9."), F.col("c_nationkey").cast("string"))
    found = tb.read(spark, sf, "customer").select(
        lib("c_custkey").alias("name"), F.lit(1).alias("rank"),
        F.when(F.col("c_nationkey") % 2 == 0, F.array(newest, F.lit("8.0"))).otherwise(F.array(newest)).alias("versions"))
    eco = cd.versions_argmax(cd.stable_releases(_releases(spark, sf)))
    known = tb.read(spark, sf, "supplier").select(lib("s_suppkey").alias("id"), "s_suppkey").join(_libs(spark, sf).select(
        F.substring("id", 2, 20).cast("long").alias("s_suppkey"), "versions"), "s_suppkey")
    return resolve.version_history(found, eco, known).select("name", F.array_join("versions", ",").alias("versions"))


@register("docs_url_dup", f"""WITH {S_LIBS}, c AS (SELECT 's' || c_custkey AS id, 'https://docs' || (c_custkey % 60) || '.dev' AS docs_url FROM customer)
  SELECT c.id, c.docs_url, coalesce((SELECT min(l.id) FROM libs l WHERE l.docs_url = c.docs_url AND l.id <> c.id), c.id) AS use_id FROM c""")
def _(spark, sf):
    key = F.col("c_custkey")
    asked = tb.read(spark, sf, "customer").select(
        F.concat(F.lit("s"), key.cast("string")).alias("id"), F.concat(F.lit("https://docs"), (key % 60).cast("string"), F.lit(".dev")).alias("docs_url"))
    return freshness.same_docs(asked, _libs(spark, sf))


@register("metadata_backfill", f"""WITH {S_LIBS}, c AS (SELECT 's' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '9.' || c_nationkey END AS latest_ver FROM customer)
  SELECT c.id, CASE WHEN c.latest_ver <> '' THEN c.latest_ver ELSE coalesce(l.latest_ver, '') END AS latest_ver, coalesce(l.latest_ver, '') AS versions FROM c LEFT JOIN libs l USING (id)""")
def _(spark, sf):
    key = F.col("c_custkey")
    latest = F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("9."), F.col("c_nationkey").cast("string")))
    asked = tb.read(spark, sf, "customer").select(F.concat(F.lit("s"), key.cast("string")).alias("id"), latest.alias("latest_ver"), F.array().cast("array<string>").alias("versions"))
    return cd.backfill(asked, _libs(spark, sf)).select("id", "latest_ver", F.array_join("versions", ",").alias("versions"))


@register("alias_lookup", """SELECT c_name AS name, lower(regexp_replace(c_name, '[^A-Za-z0-9-]', '-', 'g')) AS id, 'own/' || n_name AS repo FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    nation = tb.read(spark, sf, "nation")
    both = tb.read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    known = both.select(F.upper("c_name").alias("alias"), F.concat(F.lit("own/"), "n_name").alias("repo"), F.lit("").alias("docs_url"), F.lit(95.0).alias("trust"), F.lit("").alias("latest_ver"))
    asked = tb.read(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("").alias("query"))
    return cd.curated(asked, known).select("name", "id", "repo")


@register("standard_modules", """WITH m AS (SELECT p_partkey AS k, lower(p_name) AS module, p_size % 2 = 0 AS node FROM part), pages AS (SELECT module, bool_or(node) AS node, bool_or(NOT node) AS py FROM m GROUP BY module),
  a AS (SELECT k, module, CASE k % 3 WHEN 0 THEN 'py:' WHEN 1 THEN 'node:' ELSE '' END AS pre, k % 4 = 0 AS speaks FROM m)
  SELECT k, CASE WHEN py AND (NOT node OR pre = 'py:' OR (speaks AND pre <> 'node:')) THEN 'py:' ELSE 'node:' END || module AS id FROM a JOIN pages USING (module)""")
def _(spark, sf):
    part = tb.read(spark, sf, "part").withColumn("module", F.lower("p_name"))
    known = part.select(F.when(F.col("p_size") % 2 == 0, "node").otherwise("python").alias("lang"), "module", F.concat("module", F.lit(".html")).alias("page")).distinct()
    key = F.col("p_partkey")
    pre = F.when(key % 3 == 0, "py:").when(key % 3 == 1, "node:").otherwise("")
    asked = part.select(F.concat(pre, "module").alias("name"), F.concat(F.when(key % 4 == 0, "in Python ").otherwise("how "), key.cast("string")).alias("query"))
    return cd.standard_modules(asked, known).select(F.regexp_extract("query", r"(\d+)\z", 1).cast("long").alias("k"), "id")


# ---------------------------------------------------------------- freshness and admission

_NOW = "2024-02-01 00:00:00"


@register("recrawl_due", f"""WITH u AS (SELECT user_id, max(ts) AS fetched, max(ts) FILTER (event_type = 'click') AS crawled FROM events GROUP BY user_id),
  a AS (SELECT user_id, epoch(TIMESTAMP '{_NOW}')::BIGINT - floor(epoch(fetched))::BIGINT AS age, epoch(TIMESTAMP '{_NOW}')::BIGINT - floor(epoch(crawled))::BIGINT AS since FROM u)
  SELECT user_id, NOT coalesce(since < 3600, false) AND age > 604800 AS due, NOT coalesce(since < 3600, false) AS forced FROM a""")
def _(spark, sf):
    now = F.lit(_NOW).cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    u = tb.read(spark, sf, "events").groupBy("user_id").agg(F.max(ts).alias("fetched"), F.max(F.when(F.col("event_type") == "click", ts)).alias("crawled"))
    return u.select("user_id", freshness.recrawl_allowed(F.col("crawled"), F.col("fetched"), now).alias("due"), freshness.recrawl_allowed(F.col("crawled"), F.col("fetched"), now, True).alias("forced"))


@register("lookup_unexpired", f"SELECT event_id FROM events WHERE epoch(TIMESTAMP '{_NOW}')::BIGINT - floor(epoch(ts))::BIGINT < 604800")
def _(spark, sf):
    cache = tb.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return freshness.unexpired(cache, F.lit(_NOW).cast("timestamp"), 604_800, "ts").select("event_id")


@register("refresh_due", f"""SELECT event_id, epoch(TIMESTAMP '{_NOW}')::BIGINT - floor(epoch(ts))::BIGINT >= least(CASE WHEN value > 5 THEN 86400 ELSE 604800 END * power(2, least(user_id % 6, 3)), 604800) AS due FROM events""")
def _(spark, sf):
    now = F.lit(_NOW).cast("timestamp")
    return tb.read(spark, sf, "events").select("event_id", freshness.refresh_due(F.col("ts").cast("timestamp"), F.col("value"), F.col("user_id") % 6, now).alias("due"))


@register("ingest_decision", f"""WITH {S_LIBS}, n AS (SELECT 's' || (doc_id % 150) AS id, count(*) AS n FROM documents GROUP BY ALL)
  SELECT id, coalesce(n, 0) AS n_chunks, coalesce(n, 0) = 0 OR NOT "full" OR stable = 4 AS ingest, "full" AND coalesce(n, 0) >= 3 AS is_full FROM libs LEFT JOIN n USING (id)""")
def _(spark, sf):
    counts = tb.read(spark, sf, "documents").groupBy(F.concat(F.lit("s"), (F.col("doc_id") % 150).cast("string")).alias("id")).agg(F.count("*").alias("n"))
    df = _libs(spark, sf).join(counts, "id", "left").withColumn("n_chunks", F.coalesce("n", F.lit(0).cast("long")))
    return df.select("id", "n_chunks", freshness.needs_ingest(F.col("n_chunks"), F.col("full"), F.col("stable") == 4, F.lit("")).alias("ingest"),
                     guards.is_full(F.col("full"), F.col("n_chunks")).alias("is_full"))


@register("guidance_filter", """WITH q AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN ' docs ' WHEN 2 THEN left(text, 2) WHEN 3 THEN 'Examples' ELSE text END AS query FROM conversations)
  SELECT conv_id, turn, trim(query) = '' AS empty, length(trim(query)) < 3 OR regexp_matches(trim(query), '(?i)^(docs?|api|usage|documentation|guide|how|what|why|help|overview|library|package|install|example)s?$') AS vague FROM q""")
def _(spark, sf):
    turn = F.col("turn")
    query = F.when(turn % 5 == 0, "").when(turn % 5 == 1, " docs ").when(turn % 5 == 2, F.left("text", F.lit(2))).when(turn % 5 == 3, "Examples").otherwise(F.col("text"))
    return tb.read(spark, sf, "conversations").select("conv_id", "turn", guards.empty_query(query).alias("empty"), guards.needs_guidance(query).alias("vague"))


@register("source_cascade", """WITH p AS (SELECT page_id, url, contains(html, '<nav>') AND length(html) % 2 = 0 AS has_list, len(regexp_extract_all(html, 'href="/[A-Z]')) AS n_links,
    CASE WHEN starts_with(url, 'https') THEN len(regexp_extract_all(html, '<b>[A-S]')) ELSE 0 END AS n_locs, contains(url, '?') AS has_readme,
    len(regexp_extract_all(html, '<p>The ')) AS n_crawled, length(html) > 3000 AS crawl_done FROM pages)
  SELECT page_id, CASE WHEN has_list THEN CASE WHEN n_links = 0 THEN 'list-as-page' ELSE 'list+sitemap' END WHEN n_locs > 0 THEN 'sitemap' WHEN has_readme THEN 'readme'
    WHEN n_crawled > 0 OR NOT crawl_done THEN 'crawl' ELSE 'single-page' END AS branch FROM p""")
def _(spark, sf):
    """What a probe of each page would find, read from its address and markup."""
    html = F.col("html")
    probes = tb.read(spark, sf, "pages").select(
        "page_id", F.col("url").alias("docs_url"), (F.contains(html, F.lit("<nav>")) & (F.length(html) % 2 == 0)).alias("has_list"),
        F.regexp_count(html, F.lit('href="/[A-Z]')).alias("n_links"), F.when(F.startswith("url", F.lit("https")), F.regexp_count(html, F.lit("<b>[A-S]"))).otherwise(0).alias("n_locs"),
        F.contains("url", F.lit("?")).alias("has_readme"), F.regexp_count(html, F.lit("<p>The ")).alias("n_crawled"), (F.length(html) > 3000).alias("crawl_done"))
    return ingest.choose_source(probes).select("page_id", "branch")


S_CHECKS = f"""{S_LIBS}, held AS (SELECT *, CASE WHEN substr(id, 2)::BIGINT % 4 = 0 THEN '' ELSE 'e' || length(name || docs_url) % 2 END AS etag FROM libs),
  checks AS (SELECT 's' || c_custkey AS id, CASE WHEN c_acctbal < 5000 THEN '' ELSE '1.' || c_nationkey END AS ver, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'e' || c_nationkey % 2 END AS tag FROM customer WHERE c_custkey % 7 <> 0),
  j AS (SELECT held.*, ver, tag, checks.id IS NOT NULL AS seen, coalesce(ver <> '' AND ver <> latest_ver, false) AS moved FROM held LEFT JOIN checks USING (id)),
  k AS (SELECT *, CASE WHEN moved THEN 'moved' WHEN tag IS NULL THEN 'none' WHEN tag = etag THEN 'same' WHEN etag = '' THEN 'first' ELSE 'changed' END AS kind FROM j)"""


@register("apply_check", f"""WITH {S_CHECKS} SELECT id, CASE WHEN moved THEN ver ELSE latest_ver END AS latest_ver, CASE WHEN moved THEN ver ELSE latest_ver END AS versions,
  "full" AND kind NOT IN ('moved', 'changed') AS "full", CASE WHEN kind IN ('moved', 'changed') THEN 0 WHEN kind = 'same' THEN stable + 1 ELSE stable END AS stable,
  CASE WHEN kind IN ('first', 'changed') THEN tag ELSE etag END AS etag, seen AS checked FROM k""")
def _(spark, sf):
    now, number = F.lit(_NOW).cast("timestamp"), F.substr("id", F.lit(2)).cast("long")
    libs = _libs(spark, sf).withColumn("last_check", F.lit(None).cast("timestamp")).withColumn("etag", F.when(number % 4 == 0, "").otherwise(
        F.concat(F.lit("e"), (F.length(F.concat("name", "docs_url")) % 2).cast("string"))))
    ver = F.when(F.col("c_acctbal") < 5000, "").otherwise(F.concat(F.lit("1."), F.col("c_nationkey").cast("string")))
    checks = tb.read(spark, sf, "customer").filter("c_custkey % 7 <> 0").select(
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id"), ver.alias("latest_ver"), F.array(ver).alias("versions"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("e"), (F.col("c_nationkey") % 2).cast("string"))).alias("etag"))
    out = freshness.apply_check(libs, checks, now)
    return out.select("id", "latest_ver", F.array_join("versions", ",").alias("versions"), "full", F.col("stable").cast("long").alias("stable"), "etag",
                      F.col("last_check").eqNullSafe(now).alias("checked"))


@register("docs_moved", f"""WITH {S_LIBS}, r AS (SELECT 's' || c_custkey AS id, CASE WHEN c_acctbal < 2000 THEN 'https://own/' || c_custkey WHEN c_acctbal < 6000 THEN 'https://docs' || (c_custkey % 40) || '.dev'
    ELSE 'https://' || lower(c_mktsegment) || '.dev' END AS url FROM customer WHERE c_custkey % 7 <> 0)
  SELECT id, CASE WHEN url <> docs_url THEN url ELSE docs_url END AS docs_url, "full" AND NOT coalesce(url <> docs_url, false) AS "full" FROM libs LEFT JOIN r USING (id)""")
def _(spark, sf):
    key = F.col("c_custkey")
    url = F.when(F.col("c_acctbal") < 2000, "").when(F.col("c_acctbal") < 6000, F.concat(F.lit("https://docs"), (key % 40).cast("string"), F.lit(".dev"))).otherwise(
        F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".dev")))
    resolved = tb.read(spark, sf, "customer").filter("c_custkey % 7 <> 0").select(
        F.concat(F.lit("s"), key.cast("string")).alias("id"), url.alias("docs_url"), F.concat(F.lit("own/"), key.cast("string")).alias("repo"))
    return freshness.docs_moved(_libs(spark, sf), resolved).select("id", "docs_url", "full")


@register("gate", """SELECT count(*) FILTER (quality = 1) AS hits, count(*) AS total, round(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS pct, 100.0 * count(*) FILTER (quality = 1) / count(*) >= 40 AS passed FROM labels WHERE toxic = 0""")
def _(spark, sf):
    outcome = F.when(F.col("toxic") == 1, "n/a").when(F.col("quality") == 1, "@1").otherwise("miss")
    return metrics.gate(tb.read(spark, sf, "labels").select(outcome.alias("outcome"))).withColumn("pct", F.round("pct", 6))


# ---------------------------------------------------------------- whole flows

# Every page with its library, address, canonical address and extracted text, one per library and canonical address.
S_SITES = f"""whole_html AS ({_sql_html()}),
site AS (SELECT {s_netloc('url')} AS lib_id, url, {s_norm_url('url')} AS path, h.text FROM pages JOIN whole_html h USING (page_id))"""
S_INGESTED = f"""WITH RECURSIVE {S_SITES},
one AS (SELECT lib_id, path, arg_min(text, url || chr(1) || text) AS text FROM site
  WHERE text <> '' AND NOT regexp_matches(text, '(?i)ignore (all )?previous instructions|</system>|do not (follow|obey) (any )?(instructions|previous|the above)') GROUP BY ALL),
md AS (SELECT row_number() OVER (ORDER BY lib_id, path) AS doc_id, lib_id AS source, path, text FROM one){S_LINES}{S_PIECES},
placed AS (SELECT row_number() OVER (ORDER BY source, path, chunk_no) AS doc_id, source, path, left(regexp_replace(string_split(md.text, chr(10))[1], '^#+\\s*', ''), 80) AS title, chunk_no, packed.text
  FROM packed JOIN md USING (doc_id)),
documents AS (SELECT doc_id, source, text FROM placed), {S_GREEDY.removeprefix('WITH RECURSIVE ').rsplit(chr(10) + 'SELECT', 1)[0]},
stay AS (SELECT doc_id FROM sim WHERE length(text) < 300 OR simhash = 0 UNION ALL SELECT doc_id FROM walk WHERE stays)
SELECT source AS lib_id, path, title, chunk_no, text FROM placed WHERE doc_id IN (SELECT doc_id FROM stay)"""


@register("ingest_chunks", S_INGESTED)
def ingest_chunks(spark, sf):
    """Raw pages to chunks without near-duplicates."""
    raw = _page_list(spark, sf).select("lib_id", "url", "html")
    pages = ingest.one_per_path(ingest.extracted(spread(raw), "url"))
    found = stored(ingest.numbered(ingest.page_chunks(pages), "chunk_id"))
    return neardup.survivors(found).select("lib_id", "path", "title", F.col("chunk_no").cast("long").alias("chunk_no"), "text")


# The pages of a host by address are a tree: page n links to pages 2n and 2n + 1; the crawl starts at page 1.
S_TREE = f"""{S_SITES},
tree AS (SELECT *, row_number() OVER (PARTITION BY lib_id ORDER BY path) AS n FROM (SELECT lib_id, path, arg_min(text, url) AS text FROM site GROUP BY ALL)),
reached AS (SELECT lib_id, n, path, text FROM tree WHERE n = 1
  UNION ALL SELECT t.lib_id, t.n, t.path, t.text FROM reached r JOIN tree t ON t.lib_id = r.lib_id AND t.n // 2 = r.n
  WHERE {s_allowed('t.path', 'r.path')} AND NOT regexp_matches(t.path, '_static|_sources|genindex|search\\.html|404|whatsnew/|release/'))"""


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """lib_id, url, text, html, n: the pages of a host as a tree of links."""
    pages = spread(_page_list(spark, sf).select("lib_id", "url", "html")).withColumn("page", paths.norm_url(F.col("url")))
    one = pages.groupBy("lib_id", "page").agg(F.min_by("html", "url").alias("html"))
    placed = stored(running(one, ["lib_id"], [F.col("page").asc()], out="n"))
    below = placed.groupBy("lib_id", F.floor(F.col("n") / 2).alias("n")).agg(F.sort_array(F.collect_list("page")).alias("below"))  # two at most
    hrefs = F.array_join(F.transform("below", lambda p: F.concat(F.lit('<a href="'), p, F.lit('">next</a>'))), "")
    texts = spread(placed).select("lib_id", "page", "n", hx.extract(F.col("html")).alias("text"))
    return stored(texts.join(below, ["lib_id", "n"], "left").select(
        "lib_id", F.col("page").alias("url"), "n", "text", F.coalesce(hrefs, F.lit("")).alias("html")))


@register("crawl_rounds", f"""WITH RECURSIVE {S_TREE},
  md AS (SELECT row_number() OVER (ORDER BY lib_id, path) AS doc_id, lib_id AS source, path, text FROM reached WHERE text <> ''){S_LINES}{S_PIECES},
  sizes AS (SELECT source AS lib_id, path, count(*) AS n_chunks FROM packed JOIN md USING (doc_id) GROUP BY ALL)
  SELECT lib_id, path, coalesce(n_chunks, 0) AS n_chunks, true AS complete FROM reached LEFT JOIN sizes USING (lib_id, path)""")
def crawl_rounds(spark, sf):
    """Every host crawled from one page along its links, the pages table standing in for the network."""
    saved = _tree(spark, sf)
    root = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)
    seeds = saved.filter("n = 1").select("lib_id", root.alias("docs_url"), "url", F.lit("queued").alias("status"), F.lit(0).cast("long").alias("seq"))

    def fetch(batch: DataFrame) -> DataFrame:
        return batch.join(saved.select("lib_id", "url", "text", "html"), ["lib_id", "url"], "left")

    chunks, frontier = crawl.crawl(seeds, fetch, F.lit("guide"))
    sizes = chunks.groupBy("lib_id", "path").agg(F.count("*").alias("n_chunks"))
    seen = frontier.filter("status = 'seen'").select("lib_id", F.col("page").alias("path")).join(sizes, ["lib_id", "path"], "left")
    return seen.join(crawl.completed(frontier), "lib_id").select("lib_id", "path", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "complete")


# Curated entries answer alone, then standard modules, then the merged answers with their trust and the query's half point.
S_RESOLVED = f"""WITH {S_MERGED}, {S_LIBS}, {S_HISTORY},
  sizes AS (SELECT name, src_ord, count(*) AS n FROM stable GROUP BY ALL), best AS (SELECT name, src_ord FROM sizes QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, src_ord) = 1),
  r AS (SELECT s.*, row_number() OVER (PARTITION BY name ORDER BY parts DESC) AS n FROM stable s JOIN best USING (name, src_ord)),
  hist AS (SELECT name, string_agg(version, ',' ORDER BY n) AS versions FROM r WHERE n <= 20 GROUP BY name),
  asked AS (SELECT DISTINCT name FROM found),
  known AS (SELECT a.name, 0 AS src_ord, a.name AS id, 'own/' || n_nationkey AS repo, 'https://a.dev' AS docs_url, 95.0 AS trust, coalesce(string_split(versions, ',')[1], '') AS latest_ver, coalesce(versions, '') AS versions
    FROM asked a JOIN nation ON a.name = 'lib' || n_nationkey LEFT JOIN hist h ON h.name = a.name),
  modules AS (SELECT a.name, 0 AS src_ord, 'node:' || a.name AS id, 'nodejs/node' AS repo, '{cd.NODE_DOCS}x.md' AS docs_url, {cd.NODE_TRUST} AS trust, '' AS latest_ver, '' AS versions
    FROM asked a JOIN region ON a.name = 'lib' || (r_regionkey + 30) WHERE a.name NOT IN (SELECT name FROM known)),
  stars AS (SELECT 'own1/lib' || p_partkey AS repo, p_size * 1000 AS stars FROM part), idx AS (SELECT DISTINCT 'https://' || lower(c_mktsegment) || '.dev' AS docs_url FROM customer),
  scored AS (SELECT m.name, m.src_ord, m.id, m.repo, m.docs_url, greatest(0, round(greatest(trust, log10(greatest(coalesce(stars, 0), 1))) + CASE WHEN idx.docs_url IS NULL THEN 0 ELSE 2 END
    - CASE WHEN m.repo <> '' AND regexp_replace(lower(string_split(m.repo, '/')[-1]), '[._-]+', '', 'g') <> regexp_replace(lower(m.name), '[._-]+', '', 'g') THEN 2 ELSE 0 END
    - CASE WHEN contains(m.docs_url, 'github.com') THEN 1 ELSE 0 END, 2)) AS trust, m.latest_ver FROM merged m LEFT JOIN stars USING (repo) LEFT JOIN idx ON idx.docs_url = m.docs_url
    WHERE m.name NOT IN (SELECT name FROM known UNION ALL SELECT name FROM modules)),
  every AS (SELECT * FROM known UNION ALL SELECT * FROM modules
    UNION ALL SELECT name, src_ord, id, repo, docs_url, trust + CASE WHEN regexp_matches(lower(id || ' ' || repo || ' ' || docs_url), 'own1') THEN 0.5 ELSE 0 END, latest_ver, latest_ver FROM scored WHERE trust >= 0.5)
  SELECT e.name, row_number() OVER (PARTITION BY e.name ORDER BY e.trust DESC, src_ord, e.id, e.repo, e.docs_url) AS rank, e.id, e.repo, e.docs_url, round(e.trust, 2)::DOUBLE AS trust,
    CASE WHEN e.latest_ver <> '' THEN e.latest_ver ELSE coalesce(l.latest_ver, '') END AS latest_ver, CASE WHEN e.versions <> '' THEN e.versions ELSE coalesce(l.latest_ver, '') END AS versions
  FROM every e LEFT JOIN libs l ON l.id = e.id AND l.latest_ver <> ''"""


@register("resolve_names", S_RESOLVED)
def resolve_names(spark, sf):
    """The whole chain: curated entries, standard modules, merged registry answers."""
    found = _found(spark, sf)
    names = found.select("name").distinct().withColumn("query", F.lit("own1 usage"))
    key = F.col("n_nationkey").cast("string")
    nation = tb.read(spark, sf, "nation")
    aliases = nation.select(F.concat(F.lit("LIB"), key).alias("alias"), F.concat(F.lit("own/"), key).alias("repo"), F.lit("https://a.dev/").alias("docs_url"), F.lit(95.0).alias("trust"), F.lit("").alias("latest_ver"))
    modules = tb.read(spark, sf, "region").select(F.lit("node").alias("lang"), F.concat(F.lit("lib"), (F.col("r_regionkey") + 30).cast("string")).alias("module"), F.lit("x.md").alias("page"))
    stars = tb.read(spark, sf, "part").select(F.concat(F.lit("own1/lib"), F.col("p_partkey").cast("string")).alias("repo"), (F.col("p_size") * 1000).alias("stars"))
    indexes = tb.read(spark, sf, "customer").select(F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".dev")).alias("docs_url"))
    out = resolve.resolve(names, aliases, modules, found, cd.versions_argmax(cd.stable_releases(_releases(spark, sf))), stars, indexes, _libs(spark, sf))
    return out.select("name", "rank", "id", "repo", "docs_url", F.round("trust", 2).alias("trust"), "latest_ver", F.array_join("versions", ",").alias("versions"))


# Stored answers of every registry: customers, parts, suppliers and nations as its packages.
S_ANSWERS = """answers AS (
  SELECT 'lib' || c_custkey AS name, 0 AS src_ord, '' AS repo, 'https://' || lower(c_mktsegment) || '.dev/docs' AS docs_url, 0.0 AS trust, '' AS latest_ver, '' AS versions FROM customer WHERE c_custkey % 5 > 0 AND length(repeat(c_name, 6)) > 100
  UNION ALL SELECT 'lib' || c_custkey, 1, 'own/lib' || c_custkey, 'https://' || lower(c_mktsegment) || '.dev', log10(greatest(floor(c_acctbal), 1)), '1.' || c_nationkey || '.0', '1.' || c_nationkey || '.0,0.9.0' FROM customer WHERE c_nationkey % 4 > 0
  UNION ALL SELECT 'lib' || p_partkey, 2, 'own/lib' || p_partkey, 'https://part' || p_size || '.dev', 0, '2.' || p_size, '2.' || p_size || ',2.0,1.0' FROM part
  UNION ALL SELECT 'lib' || s_suppkey, 3, '', '', 0, '3.' || s_nationkey, '3.' || s_nationkey || ',0.1' FROM supplier
  UNION ALL SELECT 'lib' || n_nationkey, 4, '', 'https://gem' || n_nationkey || '.dev', 0, '4.' || n_nationkey, '4.' || n_nationkey || ',3.9' FROM nation
  UNION ALL SELECT 'lib' || p_partkey, 5, 'stars/lib' || p_partkey, 'https://github.com/stars/lib' || p_partkey, log10(greatest(p_size * 100, 1)), '', '' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'lib' || s_suppkey, 6, '', '', 0, 'v1.' || s_nationkey || '.0', 'v1.' || s_nationkey || '.0' FROM supplier)"""


def _answers(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The same as bodies the registries would send: name, query, status, body and what a source needs besides."""
    def rows(table: str, key: str, **more) -> DataFrame:
        return tb.read(spark, sf, table).select(F.concat(F.lit("lib"), F.col(key).cast("string")).alias("name"), F.lit("").alias("query"), *[c.alias(n) for n, c in more.items()])

    def say(pattern: str, *columns) -> Column:
        return F.format_string(pattern, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])

    site, ok = F.lower("c_mktsegment"), F.lit(200)
    npm = say('{"repository": {"url": "git+https://github.com/own/lib%s.git"}, "homepage": "https://%s.dev/", "dist-tags": {"latest": "1.%s.0"}, "versions": {"0.9.0": {}, "1.%s.0": {}, "9.0.0-beta": {}}}',
              "c_custkey", site, "c_nationkey", "c_nationkey")
    pypi = say('{"info": {"version": "2.%s", "project_urls": {"Source": "https://github.com/own/lib%s", "Documentation": "https://part%s.dev/"}}, "releases": {"1.0": [], "2.0": [], "2.%s": [], "3.0rc1": []}}',
               "p_size", "p_partkey", "p_size", "p_size")
    search = say('{"items": [{"name": "other", "full_name": "x/other", "html_url": "https://github.com/x/other", "stargazers_count": 1}, '
                 '{"name": "lib%s", "full_name": "stars/lib%s", "html_url": "https://github.com/stars/lib%s", "stargazers_count": %s}]}', "p_partkey", "p_partkey", "p_partkey", F.col("p_size") * 100)
    return {
        "directory": rows("customer", "c_custkey", status=F.when(F.col("c_custkey") % 5 > 0, 200).otherwise(404), body=F.repeat("c_name", F.lit(6)), url=F.concat(F.lit("https://"), site, F.lit(".dev/docs/llms.txt"))),
        "npm": rows("customer", "c_custkey", status=F.when(F.col("c_nationkey") % 4 > 0, 200).otherwise(500), body=npm, extra=say('{"downloads": %s}', F.floor("c_acctbal"))),
        "pypi": rows("part", "p_partkey", status=ok, body=pypi),
        "crates": rows("supplier", "s_suppkey", status=ok, body=say('{"crate": {"max_version": "3.%s"}, "versions": [{"num": "0.1", "yanked": false}, {"num": "3.%s", "yanked": false}, {"num": "8.0", "yanked": true}]}', "s_nationkey", "s_nationkey")),
        "rubygems": rows("nation", "n_nationkey", status=ok, body=say('{"version": "4.%s", "documentation_uri": "https://gem%s.dev/"}', "n_nationkey", "n_nationkey"),
                         extra=say('[{"number": "3.9"}, {"number": "4.%s"}, {"number": "7.0", "prerelease": true}]', "n_nationkey")),
        "github": rows("part", "p_partkey", form=F.lit(0), status=F.when(F.col("p_partkey") % 3 == 0, 200).otherwise(403), body=search),
        "go": rows("supplier", "s_suppkey", status=ok, body=say('{"Version": "v1.%s.0"}', "s_nationkey"), extra=say("v1.%s.0", "s_nationkey")),
    }


@register("registry_answers", f"""WITH {S_ANSWERS} SELECT name, src_ord::BIGINT AS src_ord, repo, regexp_replace(docs_url, '/+$', '') AS docs_url, round(trust, 6)::DOUBLE AS trust, latest_ver, versions FROM answers""")
def _(spark, sf):
    """The stored answers of seven registries read into candidates."""
    found, _ = resolve.from_answers(_answers(spark, sf))
    return found.select("name", F.col("src_ord").cast("long").alias("src_ord"), "repo", paths.strip_slashes(F.col("docs_url")).alias("docs_url"), F.round("trust", 6).alias("trust"),
                        "latest_ver", F.array_join("versions", ",").alias("versions"))
