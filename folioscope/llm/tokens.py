"""Token counts of whole texts by a public byte-level BPE vocabulary.

The vocabulary's pre-tokenizer never joins what stands on both sides of a single space between two
characters that are not white space, so a text is split there and its count is the sum over the
pieces, each piece keeping the space before it. Pieces repeat; each task encodes a piece once, in
batches of even byte size, and keeps its length only. Where white space comes in runs a text is not
split inside the run. Lengths are exactly those of the text encoded whole.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of pieces given to the encoder at once.
BATCH_BYTES = 256 << 10
#: Lengths a task remembers; the memory is emptied when full, results do not change.
REMEMBERED = 500_000
LIMIT = 1024

#: A space beside more white space: no safe boundary.
_RUN = re.compile(r" \s|\s ")


def pieces_of(text: str) -> list[str]:
    """``text`` cut before each single space between two characters that are not white space."""
    if _RUN.search(text) is None:
        head, *rest = text.split(" ")
        return [head, *(" " + r for r in rest)]
    cuts = [m.start() for m in re.finditer(r"(?<=\S) (?=\S)", text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


def balanced(pieces: list[str], most: int = BATCH_BYTES) -> list[list[str]]:
    """Pieces in batches of at most ``most`` bytes; a larger piece is a batch of its own."""
    out, size = [[]], 0
    for piece in pieces:
        n = 4 * len(piece)
        if out[-1] and size + n > most:
            out.append([])
            size = 0
        out[-1].append(piece)
        size += n
    return out


def _counter(path: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        encoder.no_truncation()
        encoder.no_padding()
        lengths: dict[str, int] = {"": 0}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            cut = [pieces_of(t) for t in texts]
            counts = []
            for pieces in cut:
                unknown = set(pieces).difference(lengths)
                if unknown:
                    if len(lengths) + len(unknown) > REMEMBERED:
                        lengths = {"": 0}
                        unknown = set(pieces) - {""}
                    for some in balanced(sorted(unknown)):
                        lengths.update(zip(some, map(len, encoder.encode_batch_fast(some, add_special_tokens=False))))
                counts.append(sum(map(lengths.__getitem__, pieces)))
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                "over_limit": pa.array([c > LIMIT for c in counts])})

    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs (doc_id, text)``.

    ``vocabulary`` names a tokenizer file that every executor can open. Null texts count as empty,
    repeated rows are counted each, other columns are not read. Nothing is shuffled.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        _counter(vocabulary), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
