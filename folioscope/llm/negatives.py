"""Hard negatives by a secondary sort.

Scores of all rows against the anchors are integer inner products, computed block by block as matrix
products: blocks of rows meet blocks of anchors, both of bounded size, and a task keeps only the best
few of each anchor. A first pass finds the positives, a second one knows the windows that they open
and keeps the best rows in each window. What is left is packed into keys of anchor, descending score
and id, shuffled by anchor and sorted inside the partitions. An iterator then streams over the sorted
pairs: a positive opens its window, and a negative is handed to every open window that still wants
rows. No anchor's pairs are ever held together.

Pruning is exact: the best rows of a window are among the best of that window in each task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .tables import kept
from .vectors import finite_rows, packed, unpacked

#: Rows and anchors of a block.
BLOCK, ANCHORS = 4096, 1024
#: Anchor blocks of a partition, which bound what a task remembers.
BLOCKS_PER_TASK = 16
_TOP = 1 << 63

_KEY = np.dtype([("anchor", ">u8"), ("anchor_row", ">u8"), ("falling", ">u8"), ("negative", "u1"), ("id", ">u8"), ("row", ">u8")])
_ANCHOR_BYTES = 16


def _scaled(scale: int):
    def run(batches):
        for batch in batches:
            for at, x in finite_rows(batch.column("embedding")):
                # beyond a long there is no whole number to give; the nearest one stands for it
                whole = np.floor(np.clip(x * scale, -(2.0**62), 2.0**62)).astype(np.int64)
                rows = batch.take(pa.array(at))
                yield pa.record_batch({
                    "id": rows.column("id"), "label": rows.column("label"), "anchor": rows.column("anchor"),
                    "width": pa.array(np.full(len(at), x.shape[1]), pa.int32()), "x": pa.array(packed(whole), pa.binary())})

    return run


def _blocks(size: int):
    """Rows sorted by label as blocks of at most ``size`` rows of one length."""

    def block(rows: pa.Table, width: int) -> pa.RecordBatch:
        labels = rows.column("label").to_numpy()
        as_bytes = lambda name: np.ascontiguousarray(rows.column(name).to_numpy(), dtype="<i8").tobytes()
        return pa.record_batch({
            "width": pa.array([width], pa.int32()), "low": pa.array([labels.min()], pa.int64()), "high": pa.array([labels.max()], pa.int64()),
            "ids": [as_bytes("id")], "rows": [as_bytes("row")], "labels": [as_bytes("label")],
            "x": [np.ascontiguousarray(unpacked(rows.column("x").to_pylist(), width), dtype="<i8").tobytes()]}
            | ({"windows": [b"".join(rows.column("windows").to_pylist())]} if "windows" in rows.column_names else {}))

    def run(batches):
        waiting: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                waiting.setdefault(width, []).append(batch.filter(pa.array(widths == width)))
                rows = pa.Table.from_batches(waiting[width])
                while rows.num_rows >= size:
                    yield block(rows.slice(0, size), width)
                    rows = rows.slice(size)
                waiting[width] = rows.to_batches()
        for width, left in waiting.items():
            if left and sum(map(len, left)):
                yield block(pa.Table.from_batches(left), width)

    return run


_BLOCK_COLUMNS = "width int, low long, high long, ids binary, rows binary, labels binary, x binary"


def _scores(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products, exact; beyond a long the nearest long."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(r).max(initial=0)) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ r.T.astype(np.float64)).astype(np.int64)
    if bound < _TOP:
        return a @ r.T
    exact = a.astype(object) @ r.T.astype(object)
    return np.clip(exact, -_TOP, _TOP - 1).astype(np.int64) if exact.size else exact.astype(np.int64)


def _best(score: np.ndarray, ok: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of up to ``k`` allowed entries of each row: highest score first, ties by least ``order``."""
    rows = np.flatnonzero(ok.any(axis=1))
    n = score.shape[1]
    if not len(rows):
        return rows, rows
    score, ok = score[rows], ok[rows]
    if np.abs(score).max() < 1 << 39 and n <= BLOCK:  # score and order fit one exact number
        both = np.where(ok, score * float(BLOCK) + (BLOCK - 1 - order), -np.inf)
        picked = np.argpartition(both, n - k, axis=1)[:, n - k:] if n > k else np.tile(np.arange(n), (len(rows), 1))
        i, j = np.nonzero(np.take_along_axis(ok, picked, axis=1))
        return rows[i], picked[i, j]
    found = [(np.full(min(k, int(o.sum())), i), (c := np.flatnonzero(o))[np.lexsort((order[c], ~s[c]))[:k]]) for i, s, o in zip(rows, score, ok)]
    return tuple(np.concatenate(x) for x in zip(*found))


class _Kept:
    """The best few of each anchor (and window) of one anchor block, over all row blocks of a task."""

    def __init__(self, k: int):
        self.k, self.held = k, None

    def add(self, group, score, id_, row) -> None:
        fresh = np.stack([group, score, id_, row])
        both = fresh if self.held is None else np.concatenate([self.held, fresh], axis=1)
        both = both[:, np.lexsort((both[3], both[2], ~both[1], both[0]))]
        starts = np.flatnonzero(np.r_[True, both[0, 1:] != both[0, :-1]])
        nth = np.arange(both.shape[1]) - np.repeat(starts, np.diff(np.r_[starts, both.shape[1]]))
        self.held = both[:, nth < self.k]


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8")


def _pairs(batches, a_of, work):
    """Call ``work`` for each pair of blocks of one length, then hand out what it kept per anchor block."""
    seen: dict[bytes, object] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["width"] == row["a_width"]:
                key = row["a_rows"][:8]  # the first row names the block
                if key not in seen:
                    seen[key] = a_of(row)
                work(seen[key], row)
    yield from seen.values()


def _matrix(row: dict, prefix: str = "") -> np.ndarray:
    return _numbers(row[f"{prefix}x"]).reshape(len(row[f"{prefix}ids"]) // 8, row["width"])


def _order(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), dtype=np.int64)
    out[np.lexsort((rows, ids))] = np.arange(len(ids))
    return out


def _positives(k: int):
    def start(row):
        return {"ids": _numbers(row["a_ids"]), "rows": _numbers(row["a_rows"]), "labels": _numbers(row["a_labels"]), "x": _matrix(row, "a_"), "best": _Kept(k)}

    def work(a, row):
        ids, rows, labels = _numbers(row["ids"]), _numbers(row["rows"]), _numbers(row["labels"])
        ok = (a["labels"][:, None] == labels[None]) & (a["rows"][:, None] != rows[None])
        if ok.any():
            score = _scores(a["x"], _matrix(row))
            i, j = _best(score, ok, _order(ids, rows), k)
            a["best"].add(i, score[i, j], ids[j], rows[j])

    def run(batches):
        for a in _pairs(batches, start, work):
            if a["best"].held is not None:
                i, score, id_, row = a["best"].held
                yield pa.record_batch({"anchor_row": a["rows"][i], "score": score, "id": id_, "row": row})

    return run


def _keys(anchor, anchor_row, score, negative: int, id_, row) -> pa.Array:
    """Bytes whose order is anchor, then falling score, positives first, then id."""
    keys = np.empty(len(id_), dtype=_KEY)
    unsigned = lambda x: x.astype(np.int64).view(np.uint64) ^ np.uint64(_TOP)
    keys["anchor"], keys["anchor_row"] = unsigned(anchor), unsigned(anchor_row)
    keys["falling"], keys["negative"] = ~unsigned(score), negative
    keys["id"], keys["row"] = unsigned(id_), unsigned(row)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def _negatives(k: int, windows: int):
    def start(row):
        a = {"ids": _numbers(row["a_ids"]), "rows": _numbers(row["a_rows"]), "labels": _numbers(row["a_labels"]), "x": _matrix(row, "a_")}
        # lowest and highest score of each window; one that is empty lets nothing in
        return a | {"windows": _numbers(row["a_windows"]).reshape(len(a["ids"]), windows, 2), "best": [_Kept(k) for _ in range(windows)]}

    def work(a, row):
        ids, rows, labels = _numbers(row["ids"]), _numbers(row["rows"]), _numbers(row["labels"])
        other = a["labels"][:, None] != labels[None]
        if not other.any():
            return
        score, order = _scores(a["x"], _matrix(row)), _order(ids, rows)
        for w in range(windows):
            low, high = a["windows"][:, w, 0], a["windows"][:, w, 1]
            i, j = _best(score, other & (score >= low[:, None]) & (score <= high[:, None]), order, k)
            if len(i):
                a["best"][w].add(i, score[i, j], ids[j], rows[j])

    def run(batches):
        for a in _pairs(batches, start, work):
            held = [b.held for b in a["best"] if b.held is not None]
            if held:
                # a row that several windows of an anchor want is sent once
                i, score, id_, row = np.unique(np.concatenate(held, axis=1)[[0, 3, 1, 2]], axis=1)[[0, 2, 3, 1]]
                yield pa.record_batch({"key": _keys(a["ids"][i], a["rows"][i], score, 1, id_, row)})

    return run


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    return -(-low * score // 100), high * score // 100


def _stream(k: int, low: int, high: int):
    """Sorted keys to rows: positives open windows, negatives go to the open windows that want them."""

    def run(keys):
        now, open_ = None, []
        for key, _ in keys:
            anchor, anchor_row, falling, negative, id_, _row = np.frombuffer(key, dtype=_KEY)[0].tolist()
            anchor, id_, score = anchor - _TOP, id_ - _TOP, _TOP - 1 - falling
            if (anchor, anchor_row) != now:
                now, open_ = (anchor, anchor_row), []
            if not negative:
                open_.append([id_, score, *_window(score, low, high), 0])
                continue
            for window in open_:
                if window[4] < k and window[2] <= score <= window[3]:
                    window[4] += 1
                    yield anchor, window[0], window[4], id_, window[1], score
            # windows that are full, or begin above this score, are closed
            open_ = [w for w in open_ if w[4] < k and w[2] <= score]

    return run


def hard_negatives(
    items: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``items``: ``id, label, embedding, anchor`` (whether the row is an anchor); other columns are not
    read. Components are floored after multiplication with ``scale``; the score of a row is its
    integer inner product with the anchor, higher first, ties by smaller id. An anchor's positives
    are its best ``positives`` other rows of the same label. For each, the best ``negatives`` rows
    of another label whose score lies between ``low`` and ``high`` percent of the positive's.

    Rows with a null id, label or vector or with null or non-finite components take no part, and a
    null ``anchor`` is no anchor. A repeated row is another row, and another anchor; which of two
    rows equal in id and score comes first shows only if their other columns differ, and is then
    settled by label and vector. Vectors of different length have no score. An empty vector has
    score 0 with others. Scores beyond a long are given as the nearest long. No anchors: no rows.
    """
    spark = items.sparkSession
    ready = items.select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.coalesce(F.col("anchor").cast("boolean"), F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding"),
    ).where("id is not null and label is not null and embedding is not null")
    ready = kept(ready.mapInArrow(_scaled(scale), "id long, label long, anchor boolean, width int, x binary"))
    # by label, so that most blocks hold one label; by id inside, so that a large label is many blocks
    order = ("label", "id", "x")
    rows = kept(ready.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))
    blocks = kept(rows.select("id", "label", "row", "width", "x").mapInArrow(_blocks(BLOCK), _BLOCK_COLUMNS))
    anchors = kept(rows.where("anchor").select("id", "label", "row", "width", "x"))
    parts = math.ceil(max(1, anchors.count()) / (ANCHORS * BLOCKS_PER_TASK))

    def met(side: DataFrame, on) -> DataFrame:
        # a stated set of queries against all rows, in blocks: the join sees blocks, never rows
        right = side.repartition(parts).select(*[F.col(c).alias(f"a_{c}") for c in side.columns])
        return spread(blocks).join(right, on)

    ours = kept(anchors.mapInArrow(_blocks(ANCHORS), _BLOCK_COLUMNS))
    touching = (F.col("low") <= F.col("a_high")) & (F.col("high") >= F.col("a_low"))
    near = met(ours, touching).mapInArrow(_positives(positives), "anchor_row long, score long, id long, row long")
    place = Window.partitionBy("anchor_row").orderBy(F.col("score").desc(), "id", "row")
    near = kept(near.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= positives))

    at_most, at_least = F.expr(f"floor({high} * cast(score as decimal(20,0)) / 100)"), F.expr(f"ceil({low} * cast(score as decimal(20,0)) / 100)")
    opened = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct(at_least.cast("long").alias("l"), at_most.cast("long").alias("h")))).alias("w"))

    def windowed(batches):
        for batch in batches:
            data = []
            for each in batch.column("w").to_pylist():
                bounds = [(w["l"], w["h"]) for w in each] + [(1, 0)] * (positives - len(each))
                data.append(np.array(bounds, dtype="<i8").tobytes())
            yield pa.record_batch({n: batch.column(n) for n in ("id", "label", "row", "width", "x")} | {"windows": pa.array(data, pa.binary())})

    wanting = anchors.join(opened.withColumnRenamed("anchor_row", "row"), "row").sortWithinPartitions("label", "id")
    wanting = wanting.mapInArrow(windowed, "id long, label long, row long, width int, x binary, windows binary")
    wanting = kept(wanting.mapInArrow(_blocks(ANCHORS), _BLOCK_COLUMNS + ", windows binary"))
    some_other = (F.col("low") != F.col("a_high")) | (F.col("high") != F.col("a_low"))
    far = met(wanting, some_other).mapInArrow(_negatives(negatives, positives), "key binary")

    def positive_keys(batches):
        for batch in batches:
            cols = {n: batch.column(n).to_numpy() for n in ("anchor_id", "anchor_row", "score", "id", "row")}
            yield pa.record_batch({"key": _keys(cols["anchor_id"], cols["anchor_row"], cols["score"], 0, cols["id"], cols["row"])})

    named = near.join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    both = named.select("anchor_id", "anchor_row", "score", "id", "row").mapInArrow(positive_keys, "key binary").unionByName(far)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # secondary sort: dealt by anchor, ordered by the whole key
    pairs = both.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(
        tasks, lambda key: xxhash.xxh3_64_intdigest(key[:_ANCHOR_BYTES]))
    return spark.createDataFrame(
        pairs.mapPartitions(_stream(negatives, low, high)),
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)
