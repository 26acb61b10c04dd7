"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source is expected ``target / source size`` times, between 0 and 2. Expected
copies are summed along the documents in order of size, one random offset per source is added, and
a document is emitted once per integer boundary that its stretch of the sum crosses. Because the
order is by size, small and large documents are drawn evenly and the words taken stay close to the
target; a document comes twice at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import kept, positions, unused

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words.
TOTAL = 1.5
#: Most copies of a source.
MOST = 2
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null: places where a word starts."""
    spaces = "\x20\x09\x0a\x0b\x0c\x0d"
    # every byte that is white space becomes a blank, and a word starts at each blank before a letter
    flat = F.translate(F.coalesce(text, F.lit("")), spaces, " " * len(spaces))
    return F.size(F.filter(F.split(flat, " "), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, n, target`` of ``sizes (source, size)``, one row per source.

    The total is shared by weight; sources above twice their size keep that, and what they leave
    is shared again among the others, until none is above. Each turn of the loop reads three sums.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = positions(sources, F.col("source").isNull(), F.col("source"), out="rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    table = kept(ranked.withColumn("weight", weight.cast("long")).withColumn("cap", MOST * F.col("source_size")))
    total = TOTAL * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, F.lit(False)
    while True:
        weights, caps = table.agg(
            F.sum(F.when(~full, F.col("weight"))), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0))).first()
        if not weights:
            break
        step = (total - caps) / weights
        if step <= level:
            break
        level = step
        full = F.col("cap") <= level * F.col("weight")
    return table.select(
        "source", "source_size", "n",
        F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def offset(source: Column) -> Column:
    """The random offset of a source, in [0, 1), the same in each run."""
    digits = F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(source, F.lit("\x00")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**32)


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, source, row`` for every row of
    ``docs (doc_id, source, text)``.

    Null texts have no words and add nothing, rows without a source form the last source, repeated
    rows and ids are rows of their own, null ids come first. Ties of size and id are placed by a hash of the row, so
    that reruns agree; what still ties is equal. Other columns are not read. No rows: no result.
    """
    sized = kept(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        _row().alias("row")))
    goal = kept(targets(sized))
    placed = positions(sized, F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id"), F.col("row"))
    first = placed.groupBy("source").agg(F.min("pos").alias("first")).withColumnRenamed("source", "s")
    goal = goal.join(first, goal["source"].eqNullSafe(first["s"])).drop("s").withColumn(
        "each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goal = goal.select(F.col("source").alias("s"), "source_size", "target", "first", "each", offset(F.col("source")).alias("start"))
    k = F.col("pos") - F.col("first")
    copies = (F.floor((k + 1) * F.col("each") + F.col("start")) - F.floor(k * F.col("each") + F.col("start"))).cast("long")
    return placed.join(goal, placed["source"].eqNullSafe(goal["s"])).select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "row")


def _row() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def emitted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all their columns), each as often as the mix takes it.

    Rows of equal id, source and text are emitted together, with the least of their other columns.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row, copies, alike, all_ = (unused(docs.columns, c) for c in ("__row", "__copies", "__alike", "__all"))
    taken = mixed(docs).groupBy(F.col("row").alias(row)).agg(F.sum("copies").alias(copies), F.count("*").alias(alike))
    taken = kept(taken.where(F.col(copies) > 0))
    keyed = docs.withColumn(row, _row())
    single = keyed.join(taken.where(F.col(alike) == 1), row).select(*columns, copies)
    several = keyed.join(taken.where(F.col(alike) > 1), row).groupBy(row, copies).agg(
        F.min(F.struct(*columns)).alias(all_)).select(f"{all_}.*", copies)
    return single.unionByName(several).withColumn(
        alike, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*columns)
