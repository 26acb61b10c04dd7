"""64-bit similarity fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHARS = 300
MAX_DISTANCE = 6
_PAIR = 0x0000000100000001  # bit 0 of the low and of the high word


def word_hash(word: Column) -> Column:
    """CRC-32 of the word below, CRC-32 of ``s`` + word above."""
    low = F.crc32(word.cast("binary"))
    high = F.crc32(F.concat(F.lit("s"), word).cast("binary"))
    return low.bitwiseOR(F.shiftleft(high, 32))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def add_simhash(df: DataFrame, key: str, text: str = "text", out: str = "simhash") -> DataFrame:
    """``key``, ``out``: the fingerprint of every row, 0 for text without words.

    Each word votes on 64 bits. Two votes share one long (bit i and bit i + 32), so 32 sums hold
    all of them; they are summed map-side, and only one narrow row per text is shuffled.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[A-Za-z0-9_]{3,}"), F.lit(0))
    votes = df.select(key, F.explode_outer(words).alias("__w")).select(key, word_hash(F.col("__w")).alias("__h"))
    sums = votes.groupBy(key).agg(
        F.count("__h").alias("__n"),
        *[F.sum(F.shiftrightunsigned("__h", i).bitwiseAND(F.lit(_PAIR))).alias(f"__v{i}") for i in range(32)],
    )
    tallies = F.array(*[F.col(f"__v{i}") for i in range(32)])
    bits = F.expr(
        "aggregate(transform(__votes, (v, i) -> shiftleft(if(2 * (v & 4294967295L) > __n, 1L, 0L), i)"
        " | shiftleft(if(2 * shiftrightunsigned(v, 32) > __n, 1L, 0L), i + 32)), 0L, (a, b) -> a | b)"
    )
    return sums.select(key, "__n", tallies.alias("__votes")).select(key, bits.alias(out))
