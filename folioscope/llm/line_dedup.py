"""Lines that many documents share, dropped from all but the last document that holds them.

DataFrame functions only. Every line becomes a 128-bit hash of its key with the document and the
position. The hashes are range-partitioned, ordered inside their partition by hash, document and
position, and one pass over each run meets the first document of the order, which keeps its lines,
and counts the documents behind it. What comes back is not text but, for each document that loses
lines, a compressed bitmap of the lines it keeps.

A hash that a large share of all lines has is cut into pieces before the shuffle, so that no task
receives it whole: a bounded sketch of frequent items proposes such hashes, and the first documents
of their pieces are merged afterwards. The sketch decides about the layout only, never about results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept, unused

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shorter keys are never dropped.
LEAST_LENGTH = 20
#: A key must stand in so many documents.
LEAST_DOCS = 3
#: Pieces of a frequent hash hold at most about this part of the mean rows of a task.
PART = 4
#: Frequent hashes that are cut, and items that the sketch follows.
FREQUENT, FOLLOWED = 4_096, 16_384
WORD = 64


def lines(text: Column) -> Column:
    """Pieces of the text between newlines; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z in lower case."""
    bare = F.trim(line, F.lit(SPACES))
    # the general lower-case function touches other letters too, but a text of single bytes has none
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _text_hash(text: Column) -> Column:
    """Tells rows of one document id apart; equal texts lose the same lines."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _hashed(docs: DataFrame, least_length: int) -> DataFrame:
    """``h1, h2, doc, text_hash, pos`` of every line whose key is long enough."""
    each = docs.select(
        F.col("doc_id").cast("long").alias("doc"), _text_hash(F.col("text")).alias("text_hash"),
        F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    keyed = each.select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_length)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "text_hash", "pos")


def _pieces(held: DataFrame) -> DataFrame:
    """``held`` with the piece of each row: 0 for hashes that are not cut."""
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = held.agg(F.count("*").alias("n"), F.call_function("approx_top_k", F.col("h1"), F.lit(FREQUENT), F.lit(FOLLOWED)).alias("top"))
    share = F.greatest(F.col("n") / F.lit(PART * tasks), F.lit(1.0))
    frequent = seen.select(share.alias("share"), F.explode("top").alias("top")).select(
        F.col("top.item").alias("h1"), F.ceil(F.col("top.count") / F.col("share")).cast("int").alias("pieces")).where("pieces > 1")
    # at most FREQUENT rows
    cut = held.join(F.broadcast(frequent), "h1", "left")
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc", "text_hash", "pos"), F.col("pieces")) + 1)
    return cut.select("h1", "h2", F.coalesce(piece, F.lit(0)).cast("int").alias("piece"), "doc", "text_hash", "pos")


def _dropped(docs: DataFrame, least_length: int, least_docs: int) -> DataFrame:
    """``doc, text_hash, pos`` of the lines that go."""
    held = _pieces(kept(_hashed(docs, least_length)))
    run = ("h1", "h2", "piece")
    falling = F.col("doc").desc_nulls_last()
    laid = held.repartitionByRange(*run).sortWithinPartitions(*run, falling, "pos")
    stream = Window.partitionBy(*run)
    # the order of the partitions serves both windows: nothing is shuffled or sorted again
    met = laid.withColumn("nth", F.dense_rank().over(stream.orderBy(falling))).withColumn(
        "docs", F.max("nth").over(stream)).withColumn("first", F.max("doc").over(stream))
    later = ~F.col("doc").eqNullSafe(F.col("first"))
    open_ = F.col("piece") > 0
    found = kept(met.where(open_ | ((F.col("docs") >= least_docs) & later)).select("h1", "h2", "piece", "nth", "doc", "text_hash", "pos"))
    # of each piece its first documents are enough to know the first one of all and whether there are enough
    firsts = found.where(open_ & (F.col("nth") <= least_docs)).select("h1", "h2", "doc").distinct()
    whole = firsts.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("first")).where(F.col("docs") >= least_docs)
    split = found.where(open_).join(F.broadcast(whole.drop("docs")), ["h1", "h2"]).where(later)  # at most FREQUENT rows
    columns = ("doc", "text_hash", "pos")
    return found.where(~open_).select(*columns).unionByName(split.select(*columns))


def keep_bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc_id, text_hash, n_dropped, keep`` for every document of ``docs (doc_id, text)`` that loses lines.

    ``keep`` is ``array<struct<word int, bits long>>``: bit ``i`` of word ``w`` says that line
    ``64 * w + i`` stays; words that are not listed keep all their lines.

    Lines whose key has ``least_length`` code points or more and stands in ``least_docs`` documents
    or more go from all documents except the one with the largest id. Rows of one id are one
    document for this count, however often the id is repeated, and so are all rows without an id,
    which come after every other. A key that stands several times in the document that keeps it
    stays there each time. Null and empty texts hold one empty line, which stays. Other columns are
    not read. No rows: no result.
    """
    word = F.floor(F.col("pos") / WORD).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % WORD)
    words = _dropped(docs, least_length, least_docs).groupBy("doc", "text_hash", word.alias("word")).agg(F.bit_or(bit).alias("gone"))
    return words.groupBy("doc", "text_hash").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
    ).withColumnRenamed("doc", "doc_id")


def kept_lines(all_lines: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps; null keeps all."""
    gone = F.flatten(F.transform(keep, lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(w["bits"], i) == 0),
        lambda i: w["word"] * WORD + i)))
    stays = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone)
    return F.when(keep.isNull(), all_lines).otherwise(F.transform(stays, lambda i: F.get(all_lines, i)))


def without_shared_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with all their columns, ``n_lines``, ``n_dropped`` and ``kept_text``; one row per row.

    A column of ``docs`` with one of these three names is replaced. Every document is joined with
    its own bitmap, so no key is frequent.
    """
    mine = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    id_, hash_, keep = (unused(docs.columns, c) for c in ("__doc", "__hash", "__keep"))
    gone, split = unused(docs.columns, "__gone"), unused(docs.columns, "__lines")
    marks = bitmaps.select(
        F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("keep").alias(keep), F.col("n_dropped").alias(gone))
    joined = docs.join(marks, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (_text_hash(F.col("text")) == F.col(hash_)), "left")
    # a column of its own: inside a lambda the text would be split again for every line
    joined = joined.withColumn(split, lines(F.col("text")))
    all_lines = F.col(split)
    left = F.array_join(kept_lines(all_lines, F.col(keep)), "\n")
    return joined.select(
        *[F.col(f"`{c}`") for c in mine], F.size(all_lines).cast("long").alias("n_lines"),
        F.coalesce(F.col(gone), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col(keep).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(left).alias("kept_text"))
