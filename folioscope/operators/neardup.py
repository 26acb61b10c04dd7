"""Order-dependent near-duplicate removal within a library.

A text stays if no earlier kept text (and no stored one) of its library lies within six bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..session import cut

#: Up to this many undecided fingerprints are settled in one pass per library; a checked bound.
FINISH_ROWS = 20_000


def fingerprints(chunks: DataFrame) -> DataFrame:
    """chunk_id, simhash: null for texts too short to compare and for texts without words."""
    eligible = chunks.filter(F.length("text") >= hashing.MIN_CHARS).select("chunk_id", "text")
    hashes = hashing.add_simhash(eligible, "chunk_id")
    return hashes.select("chunk_id", F.nullif("simhash", F.lit(0).cast("long")).alias("simhash"))


def block_plan(rows: int) -> tuple[int, int]:
    """(blocks, equal): into how many blocks 64 bits are cut, and how many must agree.

    With at most six differing bits, ``blocks - 6`` of the blocks agree, so any choice is exact.
    More agreeing blocks make longer keys: fewer chance meetings for more copies of each row.
    """
    for limit, blocks in ((2_000, 7), (2_000_000, 8), (500_000_000, 9)):
        if rows <= limit:
            return blocks, blocks - hashing.MAX_DISTANCE
    return 10, 4


def _largest(rows: DataFrame) -> int:
    """Rows of the largest library; only rows of one library ever meet."""
    return rows.groupBy("lib_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def block_keys(simhash: Column, blocks: int, equal: int) -> Column:
    """Keys two fingerprints share whenever they differ in at most six bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]

    def part(i: int) -> Column:
        mask = (1 << (edges[i + 1] - edges[i])) - 1
        return F.shiftrightunsigned(simhash, edges[i]).bitwiseAND(F.lit(mask))

    keys = []
    for number, chosen in enumerate(combinations(range(blocks), equal)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(part(i))
        keys.append(key)
    return F.array(*keys)


def _keyed(df: DataFrame, plan: tuple[int, int]) -> DataFrame:
    return df.withColumn("key", F.explode_outer(block_keys(F.col("simhash"), *plan)))


def _close_to(rows: DataFrame, leaders: DataFrame, plan: tuple[int, int]) -> DataFrame:
    """lib_id, simhash of rows with a leader within reach; stops at the first one found."""
    left = _keyed(rows.select("lib_id", "simhash"), plan).alias("r")
    right = _keyed(leaders.select("lib_id", "simhash"), plan).alias("l")
    near = hashing.hamming(F.col("r.simhash"), F.col("l.simhash")) <= hashing.MAX_DISTANCE
    same = (F.col("r.lib_id") == F.col("l.lib_id")) & (F.col("r.key") == F.col("l.key"))
    return left.join(right, same & near, "left_semi").select("lib_id", "simhash").distinct()


def _preceded(rows: DataFrame, plan: tuple[int, int]) -> DataFrame:
    """lib_id, simhash of rows with an earlier one within reach; stops at the first one found.

    The left side of this join may be split, so a block that many rows share is dealt over tasks
    by skew handling; the plan keeps chance meetings to a few rows of a block.
    """
    left = _keyed(rows, plan).alias("r")
    right = _keyed(rows, plan).alias("l")
    near = hashing.hamming(F.col("r.simhash"), F.col("l.simhash")) <= hashing.MAX_DISTANCE
    same = (F.col("r.lib_id") == F.col("l.lib_id")) & (F.col("r.key") == F.col("l.key"))
    earlier = F.col("l.ord") < F.col("r.ord")
    return left.join(right, same & earlier & near, "left_semi").select("lib_id", "simhash").distinct()


def _finisher(reach: int):
    """Greedy pass over one library's remaining fingerprints (their total is bounded)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord", kind="stable")
        hashes = group["simhash"].to_numpy(dtype=np.int64).view(np.uint64)
        kept = np.empty(len(hashes), dtype=np.uint64)
        n, flags = 0, np.zeros(len(hashes), dtype=bool)
        for i, value in enumerate(hashes):
            if n == 0 or np.bitwise_count(kept[:n] ^ value).min() > reach:
                kept[n], flags[i], n = value, True, n + 1
        return pd.DataFrame({"lib_id": group["lib_id"], "simhash": group["simhash"], "kept": flags})

    return run


def keep_leaders(hashes: DataFrame, stored: DataFrame | None = None, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """lib_id, simhash of the fingerprints that stay.

    ``hashes``: lib_id, simhash, ord. Equal fingerprints share one fate, so they are merged
    first: a million exact copies are one row here. Then rounds run until little is left. In
    a round, a fingerprint with no earlier undecided one within reach stays; whatever lies near
    it leaves. So the rounds follow the length of chains of near copies, not the number of rows.
    ``finish_rows`` only chooses how the last rows are settled; the rows that stay are the same.
    """
    rows = hashes.filter("simhash IS NOT NULL").groupBy("lib_id", "simhash").agg(F.min("ord").alias("ord"))
    rows = cut(rows)
    left = rows.count()
    plan = block_plan(_largest(rows))
    if stored is not None:
        known = stored.filter("simhash IS NOT NULL").join(rows.select("lib_id").distinct(), "lib_id", "left_semi")
        known = cut(known.select("lib_id", "simhash").distinct())
        plan = block_plan(_largest(rows.select("lib_id").unionByName(known.select("lib_id"))))
        rows = cut(rows.join(_close_to(rows, known, plan), ["lib_id", "simhash"], "left_anti"))
        left = rows.count()
    kept = rows.select("lib_id", "simhash").limit(0)
    while left > finish_rows:
        leaders = cut(rows.join(_preceded(rows, plan), ["lib_id", "simhash"], "left_anti").select("lib_id", "simhash"))
        kept = kept.unionByName(leaders)
        # a leader is within reach of itself, so it leaves the undecided with its neighbours
        rows = cut(rows.join(_close_to(rows, leaders, plan), ["lib_id", "simhash"], "left_anti"))
        left = rows.count()
    if left:
        done = rows.groupBy("lib_id").applyInPandas(_finisher(hashing.MAX_DISTANCE), "lib_id string, simhash long, kept boolean")
        kept = kept.unionByName(done.filter("kept").select("lib_id", "simhash"))
    return kept


def survivors(chunks: DataFrame, stored: DataFrame | None = None, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """``chunks`` (chunk_id, lib_id, text, in order of ``chunk_id``) without near-duplicates.

    Adds ``simhash``. Short texts are never dropped. ``stored``: lib_id, simhash.
    """
    marks = cut(fingerprints(chunks).join(chunks.select("chunk_id", "lib_id"), "chunk_id"))
    leaders = keep_leaders(marks.withColumnRenamed("chunk_id", "ord"), stored, finish_rows)
    firsts = marks.filter("simhash IS NOT NULL").groupBy("lib_id", "simhash").agg(F.min("chunk_id").alias("chunk_id"))
    keep = firsts.join(leaders, ["lib_id", "simhash"]).select("chunk_id", F.lit(True).alias("__lead"))
    tagged = chunks.join(marks.select("chunk_id", "simhash"), "chunk_id", "left").join(keep, "chunk_id", "left")
    return tagged.filter("simhash IS NULL OR __lead").drop("__lead")


