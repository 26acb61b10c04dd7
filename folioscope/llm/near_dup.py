"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures.

A signature is 24 MinHash values of 16 bits. Two texts of Jaccard similarity 0.75 differ in six of
them on average. The 24 places are split into chunks of 5, 5, 5, 5 and 4; by pigeonhole, signatures
that differ in at most 13 places differ in at most 2, 2, 2, 2 or 1 places of some chunk (more in
each would sum to 14). Enumerating the places that may differ leaves 4 x 10 + 4 = 44 keys of three
agreeing values, so every pair within distance 13 shares a key. At similarity 0.75 exactly, a pair
shares no key with a probability of 3e-5, and less above it. Pairs that share a key are compared up to
distance 17; a pair of that similarity lies beyond with a probability of 4e-7.

Pairs that share a key are confirmed on full shingle sets. Texts with one shingle set are one row
here. In a bucket, all rows meet its least row first; only where a bucket still holds several
components do the pairs across components follow, in blocks and within distance 17; those are
confirmed where they meet, and only a spanning forest of the links leaves a block. So a group of
copies costs one comparison per row, no list of all its pairs is made, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import Forest, forget, groups, kept
from .words import MinHash, WordHashes, shingle_set

PLACES = 24
#: Places of each chunk, and how many of them must agree.
CHUNKS = ((range(0, 5), 3), (range(5, 10), 3), (range(10, 15), 3), (range(15, 20), 3), (range(20, 24), 3))
#: Signature distance up to which every pair is found.
DISTANCE = sum(len(places) - agree + 1 for places, agree in CHUNKS) - 1
#: Signature distance up to which pairs that share a key are compared: at similarity 0.75 a pair is
#: farther apart with a probability of 4e-7.
FAR = 17
#: Chunk and agreeing places of each key.
KEYS = [(c, chosen) for c, (places, agree) in enumerate(CHUNKS) for chosen in combinations(places, agree)]
#: Link where 100 * intersection >= SHARE * union.
SHARE = 75
#: Rows of a bucket that one task compares with one another.
BLOCK = 512


def _signed(batches):
    hashes, orders = WordHashes(), MinHash(PLACES, seed=8)
    for batch in batches:
        sets = [shingle_set(t, hashes) for t in batch.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        full = np.flatnonzero(sizes)
        signs: list = [None] * len(sets)
        digests: list = [None] * len(sets)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            least = orders.of_rows(np.concatenate([sets[i] for i in full]), starts)
            short = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32)
            for row, i in enumerate(full):
                signs[i] = short[row]
                digests[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
        yield pa.record_batch({
            "id": batch.column("id"), "n_shingles": pa.array(sizes),
            "digest": pa.array(digests, pa.binary()), "signature": pa.array(signs, pa.list_(pa.int32())),
        })


def signatures(docs: DataFrame) -> DataFrame:
    """``(id, n_shingles, digest, signature)`` of ``docs (id, text)``; no digest without words."""
    return docs.select("id", "text").mapInArrow(
        _signed, "id long, n_shingles long, digest binary, signature array<int>")


def _keys(rows: DataFrame) -> DataFrame:
    sign = F.col("signature")
    keys = [F.xxhash64(F.lit(kid), *[sign[p] for p in chosen]) for kid, (_, chosen) in enumerate(KEYS)]
    return rows.select("*", F.posexplode(F.array(*keys)).alias("kid", "key"))


def _distance(a: str, b: str):
    differ = F.lit(0)
    for p in range(PLACES):
        differ = differ + (F.col(a)[p] != F.col(b)[p]).cast("int")
    return differ


def _confirmed(batches):
    hashes, last, last_set = WordHashes(), object(), None
    for batch in batches:
        keep = []
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        texts = batch.column("text_b").to_pylist()
        firsts = batch.column("text_a")
        for i, text in enumerate(texts):
            if a[i] != last:
                last, last_set = a[i], shingle_set(firsts[i].as_py(), hashes)
            other = shingle_set(text, hashes)
            both = len(np.intersect1d(last_set, other, assume_unique=True))
            if 100 * both >= SHARE * (len(last_set) + len(other) - both):
                keep.append(i)
        yield pa.record_batch({"u": pa.array([a[i] for i in keep], pa.int64()), "v": pa.array([b[i] for i in keep], pa.int64())})


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose full shingle sets confirm the link."""
    one = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    other = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(one, "b").join(other, "a").select("a", "text_a", "b", "text_b").mapInArrow(_confirmed, "u long, v long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of two blocks of a bucket next to one another: at most two blocks of rows in a group."""
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "mine", "id")


def _candidates(group: pa.Table) -> np.ndarray:
    """Places ``(row, row)`` of the pairs to confirm: other component, within the distance, and
    this key is the first that the two share, so that a pair comes up in one group only."""
    kid, mine = group.column("kid")[0].as_py(), group.column("mine").to_numpy()
    lo, hi = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left = np.arange(len(mine)) if lo == hi else np.flatnonzero(mine == lo)
    right = left if lo == hi else np.flatnonzero(mine == hi)
    if not len(left) or not len(right):
        return np.empty((0, 2), dtype=np.int64)
    part = group.column("component").to_numpy()
    sign = group.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, PLACES)
    chunk, chosen = KEYS[kid]
    fine = part[left][:, None] != part[right][None, :]
    if lo == hi:
        fine &= left[:, None] < right[None, :]
    agree = np.zeros(fine.shape, dtype=np.int8)
    for at, (places, least) in enumerate(CHUNKS):
        here = np.zeros(fine.shape, dtype=np.int8)
        for p in places:
            same = sign[left, p][:, None] == sign[right, p][None, :]
            here += same
            if at == chunk and p < chosen[-1] and p not in chosen:
                fine &= ~same
        if at < chunk:
            fine &= here < least
        agree += here
    fine &= PLACES - agree <= FAR
    x, y = np.nonzero(fine)
    return np.stack([left[x], right[y]], axis=1)


def _with_candidates(batches):
    """Rows that have a pair to confirm in their group."""
    for group in groups(batches, ["key", "i", "j"]):
        if len(found := np.unique(_candidates(group))):
            yield from group.take(pa.array(found)).to_batches()


def _crossed(batches):
    """Confirmed links of each group, as few as hold its rows together."""
    hashes = WordHashes()
    for group in groups(batches, ["key", "i", "j"]):
        pairs = _candidates(group)
        sets = [shingle_set(t, hashes) for t in group.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        small, large = sizes[pairs].min(axis=1), sizes[pairs].max(axis=1)
        pairs = pairs[100 * small >= SHARE * large]
        if not len(pairs):
            continue
        places = np.searchsorted(vocabulary := np.unique(np.concatenate(sets)), np.concatenate(sets))
        ends = np.cumsum(sizes)
        rows = [places[e - n : e] for e, n in zip(ends, sizes)]
        marked, ids, tree = np.zeros(len(vocabulary), dtype=np.int64), group.column("id").to_pylist(), Forest()
        u, v = [], []
        for first in np.unique(pairs[:, 0]):
            others = pairs[pairs[:, 0] == first, 1]
            marked[rows[first]] = 1
            both = np.array([marked[rows[o]].sum() for o in others])
            marked[rows[first]] = 0
            for o in others[100 * both >= SHARE * (sizes[first] + sizes[others] - both)]:
                if tree.join(int(first), int(o)):
                    u.append(ids[first])
                    v.append(ids[o])
        yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Component of each row of ``docs (id, text)``.

    Returns ``id, n_shingles, component_id, kept``, one row per input row; ``component_id`` is the
    least id reachable over links. Null and empty texts and rows without an id link with nothing;
    rows that repeat an id are one document, linked where any of its texts is.
    Ties need no rule: every id of a component gets the same answer. Other columns are not read.
    """
    signed = kept(signatures(docs))
    known = signed.where("id is not null and digest is not null")
    classes = kept(known.groupBy("digest").agg(
        F.min("id").alias("id"), F.min_by("signature", "id").alias("signature")))
    narrow = classes.select("id", "signature")
    keys = kept(_keys(narrow).select("key", "kid", "id"))
    buckets = kept(keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1"))
    shared = kept(keys.join(buckets, "key").select("key", "kid", "id", "a", "n"))
    forget(keys)
    first = narrow.select(F.col("id").alias("a"), F.col("signature").alias("sign_a"))
    second = narrow.select(F.col("id").alias("b"), F.col("signature").alias("sign_b"))
    stars = shared.where("id != a").select("a", F.col("id").alias("b")).distinct()
    stars = kept(stars.join(first, "a").join(second, "b").where(_distance("sign_a", "sign_b") <= FAR).select("a", "b").distinct())
    linked = kept(_links(stars, _texts(docs, stars)).unionByName(_repeated(known, classes)))
    labels = kept(components(linked))
    # what stands in one bucket but in several components meets across them
    placed = shared.join(labels, shared["id"] == labels["node"], "left").select(
        "key", "kid", "id", "n", F.coalesce("component", "id").alias("component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    rest = placed.join(open_.select("key"), "key").join(narrow, "id")
    pieces = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), pieces).cast("int")
    rest = rest.withColumn("mine", mine).withColumn("meets", F.explode(F.sequence(F.lit(0), pieces - 1))).select(
        "key", F.least("mine", "meets").alias("i"), F.greatest("mine", "meets").alias("j"),
        "kid", "mine", "id", "component", "signature")
    busy = kept(_dealt(rest).mapInArrow(_with_candidates, rest.schema))
    met = busy.join(_asked(docs, busy.select("id").distinct()), "id").select(*rest.columns, "text")
    later = _dealt(met).mapInArrow(_crossed, "u long, v long")
    final = kept(components(linked.unionByName(later)))
    answer = classes.join(final, classes["id"] == final["node"], "left").select(
        "digest", F.coalesce("component", "id").alias("component_id"))
    for table in (buckets, shared, labels):
        forget(table)
    found = signed.withColumn("joined", F.when(F.col("id").isNotNull(), F.col("digest"))).join(
        answer.withColumnRenamed("digest", "joined"), "joined", "left")
    return found.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _repeated(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges that hold together the classes of an id with several texts."""
    several = known.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo != hi")
    return known.join(several.select("id"), "id").select(F.col("id").alias("u"), "digest").join(
        classes.select("digest", F.col("id").alias("v")), "digest").select("u", "v")


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts of the documents that stand in a pair; the others are not moved."""
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return _asked(docs, asked)


def _asked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of some ids, by one and the same join at every size: the ids are a share of the corpus."""
    return docs.select("id", "text").join(ids.hint("merge"), "id", "left_semi")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and any columns) of which each near-duplicate group keeps one.

    The document of least id stays. Of rows that repeat an id, the least row stays. Rows without an
    id stay.
    """
    found = near_duplicates(docs.select(F.col("doc_id").cast("long").alias("id"), "text"))
    gone = found.where("not kept").select(F.col("id").alias("doc_id")).distinct()
    left = docs.join(gone.hint("merge"), "doc_id", "left_anti")
    twice = kept(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    least = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(least.select(*docs.columns))
