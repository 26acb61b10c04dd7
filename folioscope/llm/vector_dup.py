"""Near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes, writes on which side of each a vector lies as a string of bits,
and orders all vectors by label and that string. A vector meets its neighbours in a window of the
order, and whoever shares its first ``prefix`` bits: a window holds a bounded number of rows, and a
run of vectors with one prefix, such as a group of copies, may be longer than a window and is met
whole, piece by piece, so that no partner is cut off. Pairs are verified in double precision.

A pair that several passes find is counted in the first of them only: each vector carries its
places in all passes, so a later pass sees that an earlier one has had the pair. Links leave a piece
as a number per vector and as a spanning forest of the piece, never as a list of all pairs.

Vectors with the same components are one row with a multiplicity.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import forget, kept, positions

COSINE = 0.93
#: Rows on either side that a vector meets in each pass.
WINDOW = 96
#: Rows of a piece; a task compares two pieces at most.
PIECE = 512
BITS = 48
#: Chance that no pass finds a pair of cosine ``COSINE`` by its prefix; the windows find more.
MISS = 0.004
SEED = 4

_SEEN = np.dtype([("pos", np.int64), ("run", np.int64)])


def plan(rows: int) -> tuple[int, int]:
    """Prefix bits and passes for so many vectors: runs of unrelated vectors stay about a window
    long, and as many passes as it takes to find pairs at the bound."""
    prefix = min(BITS, max(1, round(math.log2(max(2, rows) / WINDOW))))
    agree = (1 - math.acos(COSINE) / math.pi) ** prefix
    return prefix, max(8, math.ceil(math.log(MISS) / math.log(1 - agree)))


def _planes(p: int, width: int) -> np.ndarray:
    return np.random.default_rng([SEED, p, width]).standard_normal((width, BITS))


def _read(batches):
    """Vectors as bytes; null for those that link with nothing."""
    for batch in batches:
        out = []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding")):
            x = None
            if label is not None and v.is_valid and len(v.values) and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if not np.isfinite(x).all() or not x.any():
                    x = None
            out.append(None if x is None else x.tobytes())
        yield pa.record_batch({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "vector": pa.array(out, pa.binary())})


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(d) for d in data])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _coded(passes: int):
    powers = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches):
        planes: dict[int, list] = {}
        for batch in batches:
            data = batch.column("vector").to_pylist()
            codes = np.empty((len(data), passes), dtype=np.int64)
            for width in {len(d) for d in data}:
                at = [i for i, d in enumerate(data) if len(d) == width]
                unit = _unit([data[i] for i in at])
                if width not in planes:
                    planes[width] = [_planes(p, width // 8) for p in range(passes)]
                for p in range(passes):
                    codes[at, p] = (unit @ planes[width][p] > 0) @ powers
            yield pa.record_batch({"id": batch.column("id"), "label": batch.column("label"), "width": batch.column("width"),
                                   "codes": pa.array(list(codes), pa.list_(pa.int64()))})

    return run


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the rows of one piece or of two."""
    p, lo, hi = int(group["pass"].iloc[0]), int(group["i"].iloc[0]), int(group["j"].iloc[0])
    mine = group["piece"].to_numpy()
    seen = np.stack([np.frombuffer(s, dtype=_SEEN) for s in group["seen"]])
    left = np.flatnonzero(mine == lo)
    right = np.flatnonzero(mine == hi)
    empty = pd.DataFrame({"kind": [], "a": [], "b": []}).astype({"kind": "int32", "a": "int64", "b": "int64"})
    if not len(left) or not len(right):
        return empty
    kinds = group[["label", "width"]].to_numpy()
    ok = (kinds[left, 0][:, None] == kinds[right, 0][None]) & (kinds[left, 1][:, None] == kinds[right, 1][None])
    if lo == hi:
        ok &= left[:, None] < right[None]
    pos, run = seen["pos"][:, p], seen["run"][:, p]
    ok &= (np.abs(pos[left][:, None] - pos[right][None]) <= WINDOW) | (run[left][:, None] == run[right][None])
    if not ok.any():
        return empty
    data = group["vector"].tolist()
    cosine = np.full(ok.shape, -1.0)
    for width in set(kinds[:, 1]):
        x, y = np.flatnonzero(kinds[left, 1] == width), np.flatnonzero(kinds[right, 1] == width)
        if len(x) and len(y):
            cosine[np.ix_(x, y)] = _unit([data[i] for i in left[x]]) @ _unit([data[i] for i in right[y]]).T
    a, b = np.nonzero(ok & (cosine >= COSINE))
    a, b = left[a], right[b]
    new = np.ones(len(a), dtype=bool)
    for q in range(p):  # an earlier pass has counted the pair
        new &= (np.abs(seen["pos"][a, q] - seen["pos"][b, q]) > WINDOW) & (seen["run"][a, q] != seen["run"][b, q])
    a, b = a[new], b[new]
    if not len(a):
        return empty
    ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
    n = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    # least row that each row reaches, by repeated minima over the links
    best = np.arange(len(ids))
    while True:
        low = np.minimum(best[a], best[b])
        after = best.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == best).all():
            break
        best = after
    has, hung = np.flatnonzero(n), np.flatnonzero(best != np.arange(len(ids)))
    return pd.DataFrame({
        "kind": np.repeat([0, 1], [len(has), len(hung)]).astype(np.int32),
        "a": np.concatenate([ids[has], ids[hung]]), "b": np.concatenate([n[has].astype(np.int64), ids[best[hung]]])})


def near_duplicate_vectors(vectors: DataFrame) -> DataFrame:
    """Links of each row of ``vectors (vec_id, embedding, label)``.

    Two vectors link when their labels are equal and not null, they have the same number of
    components, and their cosine is ``COSINE`` or more. Null, empty or zero vectors and those with
    null or non-finite components link with nothing, nor do rows without an id. Returns ``vec_id, n_links, component_id, kept``, one
    row per input row; a repeated row is another vector and links with its like. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    read = kept(rows.mapInArrow(_read, "vec_id long, label long, vector binary").withColumn(
        "width", F.octet_length("vector")).withColumn("sha", F.when(F.col("vec_id").isNotNull(), F.sha1("vector"))))
    distinct = read.where("sha is not null").groupBy("label", "width", "sha").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = kept(positions(distinct, *map(F.col, ("label", "width", "sha")), out="id"))
    n = classes.count()
    prefix, passes = plan(n)
    coded = classes.select("id", "label", "width", "vector").mapInArrow(
        _coded(passes), "id long, label long, width int, codes array<long>")
    coded = coded.select("id", "label", "width", F.posexplode("codes").alias("pass", "code"))
    placed = positions(coded, *map(F.col, ("pass", "label", "width", "code", "id")))
    run = F.shiftright("code", BITS - prefix)
    placed = kept(placed.withColumn("bits", run))
    runs = placed.groupBy("pass", "label", "width", "bits").agg(F.min("pos").alias("run"), F.max("pos").alias("end"))
    placed = kept(placed.join(runs, ["pass", "label", "width", "bits"]).select("id", "pass", "pos", "run", "end"))
    places = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pass", "pos", "run", "end"))).alias("places"))

    def packed(batches):
        for batch in batches:
            seen = []
            for row in batch.column("places").to_pylist():
                seen.append(np.array([(x["pos"], x["run"]) for x in row], dtype=_SEEN).tobytes())
            yield pa.record_batch({"id": batch.column("id"), "places": batch.column("places"), "seen": pa.array(seen, pa.binary())})

    carried = places.mapInArrow(packed, f"id long, places {places.schema['places'].dataType.simpleString()}, seen binary")
    carried = carried.join(classes.select("id", "label", "width", "vector", "copies"), "id")
    each = carried.withColumn("at", F.explode("places")).drop("places")
    piece = lambda c: F.floor(c / PIECE).cast("long")
    first = F.least(piece(F.col("at.run")), piece(F.greatest(F.col("at.pos") - WINDOW, F.lit(0))))
    last = F.greatest(piece(F.col("at.end")), piece(F.col("at.pos") + WINDOW))
    each = each.withColumn("piece", piece(F.col("at.pos"))).withColumn("meets", F.explode(F.sequence(first, last))).select(
        F.col("at.pass").alias("pass"), F.least("piece", "meets").alias("i"), F.greatest("piece", "meets").alias("j"),
        "piece", "id", "label", "width", "copies", "vector", "seen")
    found = kept(each.groupBy("pass", "i", "j").applyInPandas(_compare, "kind int, a long, b long"))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("others"))
    parts = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    # components are of classes; their least vector names them
    named = classes.select("id", "label", "width", "sha", "low", "copies").join(
        parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").join(counts, "id", "left").select(
        "label", "width", "sha", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    forget(placed)
    return read.join(named, ["label", "width", "sha"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
