"""Registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import (
    chat, decontaminate, language, licences, line_dedup, mixing, near_dup, negatives, personal, tokens, vector_dup, warc, whitening)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", fixed), (-1, 1, "assistant", fixed)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.formatted(turns))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(chat.loss_text(F.col("turns"))).cast("long").alias("loss_chars"),
        F.sha2(chat.loss_text(F.col("turns")), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"), licences.fit(licences.labelled_table(spark)))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    return near_dup.near_duplicates(docs).withColumnRenamed("id", "doc_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(_table(spark, sf_dir, "documents").select("text", F.col("lang").alias("language")))
    found = language.identify(language.evidence_of_pages(_table(spark, sf_dir, "pages")), model)
    return found.withColumnRenamed("id", "page_id")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = personal.fit(personal.labelled_table(spark))
    return personal.personal_data(_table(spark, sf_dir, "documents"), model).drop("redacted")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.with_revisits(_table(spark, sf_dir, "pages")), path)
    back = warc.read(spark, path, payload="false", verify="true").where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as long)")
    return back.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), label.alias("label"), "embedding", (F.col("vec_id") % 50 == 0).alias("anchor")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_shared_lines(docs, line_dedup.keep_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f for f in (
        op1_decontaminate, op2_token_counts, op3_personal_data, op4_vector_duplicates, op5_chat_format, op6_mix_sources, op7_licences, op8_near_duplicates, op9_language, op10_warc,
        op11_hard_negatives, op12_line_dedup, op13_whitening)
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _shingles(table: str, key: str) -> str:
    return f"""
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM (SELECT {key}, {_WORDS} AS w FROM {table})"""


ORACLES = {
    "op1_decontaminate": f"""
WITH d AS ({_shingles('documents', 'doc_id')}), b AS ({_shingles('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM b JOIN d USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared FROM p JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item
""",
    "op5_chat_format": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(replace(text, '<|', '<||'))
    + CASE WHEN before = role THEN length('<|next|>')
      ELSE length('<|role:|><|end|>') + length(replace(replace(role, '%', '%25'), '|', '%7C')) END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
""",
    "op6_mix_sources": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
q AS (SELECT *, 2 * source_size AS cap, (sum(2 * source_size) OVER o)::BIGINT AS caps, (sum(w) OVER o)::BIGINT AS ws
  FROM s WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST)),
v AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(lag(caps) OVER o, 0)::DOUBLE)
    / ((SELECT sum(w) FROM s) - coalesce(lag(ws) OVER o, 0))::DOUBLE AS level
  FROM q WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST)),
l AS (SELECT min(level) AS level FROM (SELECT level FROM v WHERE level * w < cap ORDER BY cap / w LIMIT 1)),
s2 AS (SELECT *, 2 * source_size AS cap FROM s),
t AS (SELECT source, source_size, CASE WHEN cap <= l.level * w THEN cap::DOUBLE ELSE l.level * w END AS target FROM s2, l),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
    ('0x' || substr(md5('mix' || coalesce(d.source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296 AS start,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(k * each + start) - floor((k - 1) * each + start)))::BIGINT AS taken FROM p
""",
    "op10_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM f
""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
g AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT g.a AS anchor_id, g.b AS positive_id, p.b AS negative_id, g.s AS positive_score, p.s AS negative_score
  FROM g JOIN p ON p.a = g.a AND NOT p.same AND 50 * g.s <= 100 * p.s AND 100 * p.s <= 95 * g.s)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INT AS rank,
  negative_id, positive_score, negative_score FROM n
QUALIFY rank <= 3
""",
    "op12_line_dedup": """
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, pos, line, last IS NULL OR last = doc_id AS stays FROM k LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op8_near_duplicates": f"""
WITH RECURSIVE d AS MATERIALIZED ({_shingles('documents', 'doc_id')}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM d a JOIN d b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
}
