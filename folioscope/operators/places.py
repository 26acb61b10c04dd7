"""Words of texts with their places, counted over whole batches of rows at a time.

The rules are those of :func:`functions.text.doc_tokens`. What lower case, folding and the class of index letters make of
a character is asked of these expressions once, for every character there is, so both readings agree by construction.
Texts whose reading is not settled character by character (a capital sigma depends on its neighbours, broken UTF-8)
are left to the expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import local

#: Bytes of text whose words are held at once.
AT_ONCE = 4 << 20
_CODES = 0x110000
_APART, _DELETED, _ELSEWHERE = 0, -1, -2
_SIGMA = "Σ"
_tables: dict[str, tuple] = {}


def _read(spark: SparkSession, characters: list[list[str]], by) -> list:
    """What ``by`` makes of the characters, which stand on lines of their own, a few thousand to a row."""
    kind = T.StructType([T.StructField("c", T.StringType())])
    rows = local(spark, kind, [("\n".join(c),) for c in characters])
    return [r["r"] for r in rows.select(by(F.col("c")).alias("r")).collect()]


def table(spark: SparkSession) -> np.ndarray:
    """For each code point the letter it stands for in an index word, or one of the marks above."""
    codes = [c for c in range(1, _CODES) if c != 10 and not 0xD800 <= c < 0xE000]
    rows = [[chr(c) for c in codes[i : i + 8192]] for i in range(0, len(codes), 8192)]
    folded = dict(zip(codes, (x for row in _read(spark, rows, tx.fold) for x in row.split("\n")), strict=True))
    out = np.full(_CODES, _APART, np.int32)
    out[[c for c, f in folded.items() if f == ""]] = _DELETED
    out[[ord(_SIGMA), *(c for c, f in folded.items() if len(f) > 1)]] = _ELSEWHERE
    single = [[c for c in row if len(folded[ord(c)]) == 1] for row in rows]
    for row, words in zip(single, _read(spark, single, tx.doc_tokens), strict=True):
        rest = iter(words)
        word = next(rest, None)
        for c in row:  # a character that is no letter of a word equals none
            if folded[ord(c)] == word:
                out[ord(c)] = _ELSEWHERE if c == _SIGMA else ord(word)
                word = next(rest, None)
        if word is not None:
            raise ValueError(f"the word {word!r} belongs to no character")
    return out


def _of_session(spark: SparkSession):
    """The table as a broadcast and the characters that need the expressions; made once a session."""
    key = spark.sparkContext.applicationId
    if key not in _tables:
        found = table(spark)
        _tables.clear()
        _tables[key] = spark.sparkContext.broadcast(found), [chr(c) for c in np.flatnonzero(found == _ELSEWHERE)]
    return _tables[key]


def settled(text: Column, spark: SparkSession) -> Column:
    """True for texts that :func:`places` reads; never null."""
    fine = F.is_valid_utf8(text)
    special = "".join(_of_session(spark)[1])
    return F.coalesce(fine & (F.translate(text, special, "") == text if len(special) > 1 else ~F.contains(text, F.lit(special))), F.lit(False))


def _slices(texts: pa.Array):
    """Neighbouring rows of about ``AT_ONCE`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
        yield start, stop - start
        start = stop


def _words(texts: list[str], letters: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Index words of the texts in their order, and the number of each one's text."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    value = letters[codes]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    where = None
    if (value == _DELETED).any():
        where = np.flatnonzero(value != _DELETED)
        value = value[where]
    inside = value > 0
    edge = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    starts = np.concatenate([[0], edge]) if len(inside) and inside[0] else edge
    text_of = np.searchsorted(begins, starts if where is None else where[starts], "right") - 1
    kept = value[inside]
    width = 1 + (kept > 0x7F).astype(np.int64) + (kept > 0x7FF) + (kept > 0xFFFF)
    byte = np.concatenate([[0], np.cumsum(width)])
    offsets = np.concatenate([byte[(np.cumsum(inside) - 1)[starts]], byte[-1:]]).astype(np.int32)
    data = kept.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), text_of


def _counted(ids: pa.Array, libs: pa.Array, texts: list[str], letters: np.ndarray, mark: str, positions: bool) -> pa.RecordBatch:
    words, text_of = _words(texts, letters)
    encoded = words.dictionary_encode()
    terms = pa.concat_arrays([encoded.dictionary, pa.array([mark], pa.string())])
    dl = np.bincount(text_of, minlength=len(texts))
    place = np.arange(len(words)) - (np.cumsum(dl) - dl)[text_of]
    # the mark stands once behind the words of each text
    term = np.concatenate([encoded.indices.to_numpy(), np.full(len(texts), len(terms) - 1, np.int32)])
    text_of, place = np.concatenate([text_of, np.arange(len(texts))]), np.concatenate([place, dl])
    # equal words side by side: they are found as runs, and what is shuffled compresses better
    order = np.sort((term.astype(np.int64) << 32) | np.arange(len(term))) & 0xFFFFFFFF
    term, text_of = term[order], text_of[order]
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (text_of[1:] != text_of[:-1])]))
    own = pa.array(text_of[first])
    columns = {"chunk_id": ids.take(own), "lib_id": libs.take(own), "dl": pa.array(dl[text_of[first]], pa.int64()), "term": terms.take(pa.array(term[first])),
               "tf": pa.array(np.diff(np.append(first, len(term))), pa.int64())}
    if positions:
        bounds = pa.array(np.append(first, len(term)), pa.int32())
        columns["positions"] = pa.ListArray.from_arrays(bounds, pa.array(place[order], pa.int32()))
    return pa.record_batch(columns)


def places(texts: DataFrame, mark: str, positions: bool) -> DataFrame:
    """chunk_id, lib_id, dl, term, tf [, positions] of each distinct word of a row, and of ``mark``.

    ``texts``: chunk_id, lib_id, text, all of them :func:`settled`.
    """
    letters = _of_session(texts.sparkSession)[0]

    def run(batches):
        for batch in batches:
            for start, n in _slices(batch.column("text")):
                part = batch.slice(start, n)
                yield _counted(part.column("chunk_id"), part.column("lib_id"), part.column("text").to_pylist(), letters.value, mark, positions)

    kind = [texts.schema["chunk_id"], texts.schema["lib_id"], T.StructField("dl", T.LongType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]
    if positions:
        kind.append(T.StructField("positions", T.ArrayType(T.IntegerType())))
    return texts.select("chunk_id", "lib_id", "text").mapInArrow(run, T.StructType(kind))
