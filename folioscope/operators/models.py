"""Models as Arrow functions: loaded once per Python worker, fed in batches.

No model is fetched inside a task; ship the files (``--files``, a shared path) and pass the folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEN = 512


def _session(folder: str, threads: int):
    import onnxruntime
    from tokenizers import BertWordPieceTokenizer

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads, options.inter_op_num_threads = threads, 1
    model = onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"), options, providers=["CPUExecutionProvider"])
    tokenizer = BertWordPieceTokenizer(os.path.join(folder, "vocab.txt"))
    tokenizer.enable_truncation(max_length=MAX_LEN)
    return model, tokenizer


def _feed(model, encoded) -> np.ndarray:
    width = max(len(e.ids) for e in encoded)

    def padded(pick):
        return np.array([list(pick(e)) + [0] * (width - len(e.ids)) for e in encoded], dtype=np.int64)

    values = {"input_ids": padded(lambda e: e.ids), "attention_mask": padded(lambda e: [1] * len(e.ids)), "token_type_ids": padded(lambda e: e.type_ids)}
    wanted = {i.name for i in model.get_inputs()}
    return model.run(None, {k: v for k, v in values.items() if k in wanted})[0]


def cross_encoder(folder: str, threads: int = 2, batch: int = 16):
    """A scorer for :func:`operators.hits.rerank` from a cross-encoder's folder."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model, tokenizer = _session(folder, threads)
        for queries, texts in parts:
            pairs = list(zip(queries, texts))
            out: list[float] = []
            for i in range(0, len(pairs), batch):
                encoded = [tokenizer.encode(q or "", t or "") for q, t in pairs[i:i + batch]]
                out.extend(float(row[0]) for row in _feed(model, encoded))
            yield pd.Series(out, dtype="float64")

    return score


def text_encoder(folder: str, threads: int = 2, batch: int = 8):
    """Unit-length embeddings (first token) from a sentence encoder's folder."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, tokenizer = _session(folder, threads)
        for texts in parts:
            rows: list = []
            for i in range(0, len(texts), batch):
                encoded = [tokenizer.encode(t or "") for t in texts.iloc[i:i + batch]]
                first = _feed(model, encoded)[:, 0, :]
                rows.extend((first / np.linalg.norm(first, axis=1, keepdims=True)).astype(np.float32).tolist())
            yield pd.Series(rows)

    return embed


def or_default(folder: str | None, default):
    """The model's scorer if its files are there, else ``default`` and a reason to log."""
    if folder and os.path.exists(os.path.join(folder, "model.onnx")):
        return cross_encoder(folder), None
    return default, f"no model in {folder!r}"


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """Stand-in encoder without a model: signed counts of hashed tokens, scaled to unit length."""
    slots = F.transform(tokens, lambda t: F.struct(
        F.pmod(F.xxhash64(t), F.lit(size)).alias("slot"),
        F.when(F.pmod(F.xxhash64(t, F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.aggregate(F.filter(slots, lambda s: s["slot"] == i), F.lit(0.0), lambda a, s: a + s["sign"]))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(sums, lambda v: F.when(norm > 0, v / norm).otherwise(0.0).cast("float"))
