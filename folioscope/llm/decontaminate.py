"""Benchmark decontamination: size-partitioned MinHash containment search.

A MinHash signature of a long document says nothing about a short passage inside it. Items are
therefore partitioned by size, [2^c, 2^(c+1)) shingles, and for each size class documents are read
as windows of 2 * 2^(c+1) shingles that start every 2^(c+1): every stretch as long as an item of
the class lies whole in one of them. An item of which a share of 0.75 is contained has at least
0.17 Jaccard similarity with that window, 0.25 if it is contained whole. A window and an item that
agree in one of 48 MinHash values are a candidate: 0.9999 of the pairs at 0.17. Candidates are
confirmed by exact containment in the whole document.

Items are a query set: they are read in blocks of bounded size, and each block is sent to the
tasks that stream over the documents. Documents are not shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept, positions, unused
from .words import MinHash, WordHashes, shingle_row, words_of

ORDERS = 48
#: Least share of an item's distinct shingles that a document must contain, in percent.
SHARE = 75
#: Bytes of item texts that are sent to the tasks at once; more items are more rounds.
BLOCK_BYTES = 16 << 20

#: Shingles that are searched at once.
CHUNK = 1 << 16

OUT = "doc_id long, item_id long, n_item long, n_shared long"


def _index(items: list) -> tuple[list, dict]:
    """Shingle sets of the items, and per size class a table from MinHash values to items."""
    hashes, orders = WordHashes(), MinHash(ORDERS, seed=1)
    sets, classes = [], {}
    for item_id, text in items:
        shingles = np.unique(shingle_row(words_of(text), hashes))
        if not len(shingles):
            continue
        least = orders.of_rows(shingles, np.array([0]))[0]
        size = len(shingles).bit_length() - 1
        values, owners = classes.setdefault(size, ([[] for _ in range(ORDERS)], [[] for _ in range(ORDERS)]))
        for j in range(ORDERS):
            values[j].append(least[j])
            owners[j].append(len(sets))
        sets.append((item_id, shingles))
    tables = {}
    for size, (values, owners) in classes.items():
        per_order = []
        for j in range(ORDERS):
            order = np.argsort(np.array(values[j], dtype=np.uint64), kind="stable")
            sorted_values = np.array(values[j], dtype=np.uint64)[order]
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[sorted_values & np.uint64(0xFFFF)] = True
            per_order.append((sorted_values, np.array(owners[j])[order], maybe))
        tables[size] = per_order
    return sets, tables


class _Windows:
    """Windows of each size class over the shingles of several documents, laid end to end."""

    def __init__(self, lengths: np.ndarray, sizes: list[int]):
        self.sizes, self.levels = sizes, {}
        ends = np.cumsum(lengths)
        step = 2 << sizes[0]
        self.starts, owner = self._every(ends - lengths, lengths, step)
        for size in range(sizes[0], sizes[-1] + 1):
            if size == sizes[0]:
                merge = None
            else:  # a step of this class is two of the one before
                counts = np.bincount(owner, minlength=len(lengths))
                merge, owner = self._every(np.cumsum(counts) - counts, counts, 2)
            self.levels[size] = merge, owner, owner[1:] == owner[:-1]

    @staticmethod
    def _every(begins: np.ndarray, lengths: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Each ``step``-th place of each stretch, and the stretch it belongs to."""
        counts = -(-lengths // step)
        owner = np.repeat(np.arange(len(lengths)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        return begins[owner] + within * step, owner

    def minima(self, values: np.ndarray):
        """Per size class the least value of each window of two steps, and its document."""
        blocks = np.minimum.reduceat(values, self.starts)
        for size, (merge, owner, joined) in self.levels.items():
            if merge is not None:
                blocks = np.minimum.reduceat(blocks, merge)
            if size in self.sizes:
                least = blocks.copy()
                np.minimum(blocks[:-1], blocks[1:], out=least[:-1], where=joined)
                yield size, least, owner


def _chunks(rows: list[np.ndarray]):
    """Documents in runs of about ``CHUNK`` shingles; those without a shingle are left out."""
    some, size = [], 0
    for i, row in enumerate(rows):
        if len(row):
            some.append(i)
            size += len(row)
        if some and size >= CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def _search(index):
    orders = MinHash(ORDERS, seed=1)

    def run(batches):
        sets, tables = index.value
        hashes, sizes = WordHashes(), sorted(tables)
        for batch in batches:
            found = []
            ids = batch.column("doc_id").to_pylist()
            rows = [shingle_row(words_of(t), hashes) for t in batch.column("text").to_pylist()] if sizes else []
            for some in _chunks(rows):
                every = np.concatenate([rows[i] for i in some])
                windows = _Windows(np.array([len(rows[i]) for i in some]), sizes)
                values, hits = np.empty_like(every), set()
                for j in range(ORDERS):
                    np.multiply(every, orders.a[j], out=values)
                    np.add(values, orders.b[j], out=values)
                    for size, least, owner in windows.minima(values):
                        sorted_values, owners, maybe = tables[size][j]
                        at = np.flatnonzero(maybe[least.astype(np.uint16)])
                        lo = np.searchsorted(sorted_values, least[at], "left")
                        hi = np.searchsorted(sorted_values, least[at], "right")
                        for k in np.flatnonzero(hi > lo):
                            hits.update((int(owner[at[k]]), int(o)) for o in owners[lo[k] : hi[k]])
                last, whole = None, None
                for doc, item in sorted(hits):
                    if doc != last:
                        last, whole = doc, np.unique(rows[some[doc]])
                    item_id, shingles = sets[item]
                    place = np.minimum(np.searchsorted(whole, shingles), len(whole) - 1)
                    shared = int((whole[place] == shingles).sum())
                    if 100 * shared >= SHARE * len(shingles):
                        found.append((ids[some[doc]], item_id, len(shingles), shared))
            columns = list(zip(*found)) or [[], [], [], []]
            yield pa.record_batch({
                name: pa.array(column, pa.int64())
                for name, column in zip(("doc_id", "item_id", "n_item", "n_shared"), columns)})

    return run


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a document of ``docs (doc_id, text)`` and an item of ``items (item_id, text)``
    of which it contains 75 % of the distinct five-word shingles or more.

    Returns ``doc_id, item_id, n_item, n_shared`` (shingles of the item, and those contained), once
    per pair of input rows: repeated rows repeat their pairs. Null and empty texts on either side
    match nothing. A text of fewer than five words is one shingle, its whole word sequence, and so
    matches only a text of the same words. Null ids are returned as they are. Other columns are
    not read. Without items the result is empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > BLOCK_BYTES:
        numbered = kept(positions(items, F.col("item_id"), F.xxhash64("text")))
        rows = numbered.count()
        blocks = -(-total // BLOCK_BYTES)
        # even runs of items; an item is a short passage, so runs are about even in bytes, too
        parts = [numbered.where((F.col("pos") * blocks / rows).cast("long") == b) for b in range(blocks)]
    else:
        parts = [items]
    out = None
    for part in parts:
        index = _index([(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()])
        found = docs.mapInArrow(_search(spark.sparkContext.broadcast(index)), OUT)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` (any columns) whose document contains no item; rows without an id by text.

    Repeated rows go or stay together: if one row of an id holds an item, all rows of that id go.
    Null and empty texts hold nothing and stay, unless another row of their id goes.
    """
    row = unused(docs.columns, "__row")
    keyed = docs.withColumn(row, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    leaks = contained(keyed.select(F.col(row).alias("doc_id"), "text"), items)
    return keyed.join(leaks.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
