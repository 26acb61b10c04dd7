"""Whitening of vectors by an incremental eigendecomposition.

A task holds the spectrum of the scatter of the vectors it has met: their number, their mean, and
eigenvalues and eigenvectors of the sum of centred squares. Each further vector is a centred rank-one
update: the new eigenvalues are the roots of a secular equation, one between each two old ones, and
the new eigenvectors follow from them, with weights recomputed so that they stay orthogonal; equal
eigenvalues and directions without weight are deflated first. Spectra of tasks are combined the same
way, eigenpair by eigenpair plus one update for the distance of the means, in a tree of small groups.
The basis that comes out is refined once: the exact mean is known by then, the covariance is projected
on the basis by all tasks (Rayleigh-Ritz), and the small projected matrix is diagonalised.

What goes to the driver and back to the tasks is one mean and one square matrix of the vectors'
length, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept
from .vectors import finite_rows, packed, unpacked

#: Entries become ``floor(SCALE * c) + SHIFT``. The shift moves no eigenvector; it enters sums only.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Larger entries are not represented exactly and count as non-finite.
LARGEST = 2.0**52
#: Distinct vectors of a task, and spectra that a task combines.
TASK_ROWS, FAN = 65_536, 8
_EPS = np.finfo(np.float64).eps
_LIMB = 26


def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z2 / (d - x))`` and the differences ``d[j] - root[i]`` as ``[i, j]``.

    ``d`` rises strictly; root ``i`` lies between ``d[i]`` and ``d[i + 1]``. Each is found as a
    distance from the nearer of the two, so that small distances keep all their digits.
    """
    k = len(d)
    top = np.append(d[1:], d[-1] + rho * z2.sum())
    width = top - d
    own = np.arange(k)
    from_left = d[None, :] - d[:, None]
    value = 1 + rho * (z2 / (from_left - width[:, None] / 2)).sum(axis=1)
    right = (value < 0) & (own < k - 1)
    base = np.where(right[:, None], d[None, :] - top[:, None], from_left)
    low = np.where(right, -width / 2, np.where(value < 0, width / 2, 0.0))
    high = np.where(right, 0.0, np.where(value < 0, width, width / 2))
    mu = np.where(right, -width / 4, np.where(value < 0, 0.75 * width, width / 4))
    below = np.tri(k)
    after = np.minimum(own + 1, k - 1)
    last = own == k - 1
    for turn in range(200):
        delta = base - mu[:, None]
        parts = rho * z2 / delta
        f = 1 + parts.sum(axis=1)
        done = np.abs(f) <= 4 * _EPS * k * (1 + np.abs(parts).sum(axis=1))
        low, high = np.where(f < 0, mu, low), np.where(f < 0, high, mu)
        done |= high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        slopes = parts / delta
        left = (slopes * below).sum(axis=1)
        rest = slopes.sum(axis=1) - left
        near, far = delta[own, own], delta[own, after]
        with np.errstate(all="ignore"):
            # the rational function with the two nearest poles that agrees in value and slopes
            a = (near + far) * f - near * far * (left + rest)
            b, c = near * far * f, f - near * left - far * rest
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
            step = np.where(last, near + left * near * near / (f - near * left), step)
        trial = mu + step
        inside = np.isfinite(trial) & (trial > low) & (trial < high) & (turn % 8 != 7)
        mu = np.where(done, mu, np.where(inside, trial, (low + high) / 2))
    return np.where(right, top, d) + mu, base - mu[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``vectors diag(values) vectors' + rho * direction direction'``; rising values, ``rho >= 0``."""
    z = vectors.T @ direction
    length = np.sqrt(z @ z)
    if rho * length * length <= 0:
        return values, vectors
    z, rho = z / length, rho * length * length
    tiny = 8 * _EPS * max(values[-1], rho)
    close = np.diff(values) <= tiny
    if close.any():
        vectors = vectors.copy()
        start = 0
        while start < len(values) - 1:
            end = start + 1
            while end < len(values) and values[end] - values[start] <= tiny:
                end += 1
            if end - start > 1:  # reflect: one of the equal values takes the weight of all
                mirror = z[start:end].copy()
                weight = np.sqrt(mirror @ mirror)
                if weight > 0:
                    sign = -1.0 if mirror[-1] > 0 else 1.0
                    mirror[-1] -= sign * weight
                    mirror /= np.sqrt(mirror @ mirror)
                    part = vectors[:, start:end]
                    vectors[:, start:end] = part - 2 * np.outer(part @ mirror, mirror)
                    z[start:end] = 0
                    z[end - 1] = sign * weight
            start = end
    live = np.flatnonzero(rho * np.abs(z) > tiny)
    if not len(live):
        return values, vectors
    d, w = values[live], z[live]
    k = len(d)
    found, delta = _roots(d, w * w, rho)
    # weights for which the computed roots are exact keep the eigenvectors orthogonal
    ahead = np.arange(k)[:, None] < np.arange(k)[None, :]
    gaps = d[:, None] - d[None, :]
    following = np.vstack([d[1:, None] - d[None, :], np.ones((1, k))])
    ratio = -delta / np.where(ahead, gaps, following)
    ratio = np.abs(ratio)
    weights = np.sqrt(ratio.prod(axis=0)) * np.where(w < 0, -1.0, 1.0)
    turn = weights / delta
    turn /= np.sqrt((turn * turn).sum(axis=1, keepdims=True))
    out, basis = values.copy(), vectors.copy()
    out[live], basis[:, live] = found, vectors[:, live] @ turn.T
    order = np.argsort(out, kind="stable")
    return out[order], basis[:, order]


class Spectrum:
    """Number, mean and eigenpairs of the centred scatter of some vectors, and their exact sums."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)
        self.high, self.low = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)

    def add(self, rows: np.ndarray) -> None:
        self.high += (rows >> _LIMB).sum(axis=0)
        self.low += (rows & ((1 << _LIMB) - 1)).sum(axis=0)
        for row in rows.astype(np.float64):
            off = row - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n / (self.n + 1))
            self.n += 1
            self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        both = self.n + other.n
        if not other.n:
            return
        least = len(other.values) * _EPS * max(0.0, other.values[-1])
        for value, vector in zip(other.values, other.vectors.T):
            if value > least:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        off = other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n * other.n / both)
        self.mean, self.n = self.mean + off * (other.n / both), both
        self.high, self.low = self.high + other.high, self.low + other.low

    def sums(self) -> list[int]:
        return [(int(h) << _LIMB) + int(lo) for h, lo in zip(self.high, self.low)]

    COLUMNS = "part long, n long, mean binary, vals binary, vectors binary, high binary, low binary"

    def batch(self, part: int) -> pa.RecordBatch:
        as_bytes = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        return pa.record_batch({
            "part": pa.array([part], pa.int64()), "n": pa.array([self.n], pa.int64()), "mean": as_bytes(self.mean),
            "vals": as_bytes(self.values), "vectors": as_bytes(self.vectors), "high": as_bytes(self.high), "low": as_bytes(self.low)})

    @classmethod
    def read(cls, row: dict) -> Spectrum:
        mean = np.frombuffer(row["mean"])
        out = cls(len(mean))
        out.n, out.mean, out.values = row["n"], mean, np.frombuffer(row["vals"])
        out.vectors = np.frombuffer(row["vectors"]).reshape(len(mean), len(mean))
        out.high, out.low = np.frombuffer(row["high"], dtype=np.int64), np.frombuffer(row["low"], dtype=np.int64)
        return out


def _spectra(width: int):
    def run(batches):
        here = Spectrum(width)
        for batch in batches:
            here.add(unpacked(batch.column("x").to_pylist(), width))
        if here.n:
            yield here.batch(TaskContext.get().partitionId())

    return run


def _merged(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    out = Spectrum.read(rows[0])
    for row in rows[1:]:
        out.merge(Spectrum.read(row))
    return pa.Table.from_batches([out.batch(rows[0]["part"] // FAN)])


def _added(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total = sum(np.frombuffer(r["total"]) for r in rows)
    return pa.table({"part": pa.array([rows[0]["part"] // FAN], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})


def _folded(parts: DataFrame, n_parts: int, combine) -> DataFrame:
    """One row out of at most ``n_parts``, by groups of ``FAN``; ``combine`` divides ``part``."""
    while n_parts > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(combine, parts.schema)
        n_parts = -(-n_parts // FAN)
    return parts


def _matrices(rows, width: int, total):
    """Sum of ``total(matrix)`` over the rows of a task, as one row."""

    def run(batches):
        here = None
        for batch in batches:
            here = (0 if here is None else here) + total(unpacked(batch.column("x").to_pylist(), width))
        if here is not None:
            yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "total": pa.array([here.tobytes()], pa.binary())})

    return rows.mapInArrow(run, "part long, total binary")


def _whole(scale: int):
    def run(batches):
        for batch in batches:
            for at, x in finite_rows(batch.column("embedding")):
                x = np.floor(x * scale)
                good = (np.abs(x) <= LARGEST).all(axis=1)
                at, x = at[good], x[good].astype(np.int64)
                yield pa.record_batch({
                    "vec_id": batch.column("vec_id").take(pa.array(at)), "width": pa.array(np.full(len(at), x.shape[1]), pa.int32()),
                    "x": pa.array(packed(x), pa.binary())})

    return run


def _deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the entries of ``(n * x - S) ** 2``, exact; null beyond a long."""
    most = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))) * n + max((abs(int(s)) for s in sums), default=0)
    if most * most * rows.shape[1] < 1 << 63:
        off = rows * n - sums.astype(np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(row, sums)) for row in rows.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vectors (vec_id, embedding)``.

    Entries become whole numbers ``floor(scale * c) + shift``. The fit knows each distinct vector
    once: ``n`` vectors with sums ``S``. One row comes back for each vector and each of the first
    ``components`` eigenvectors of their covariance (divisor ``n``), by falling eigenvalue ``e``;
    the largest entry of an eigenvector is positive. ``deviation`` is the exact sum of
    ``(n * x - S) ** 2``, null where that is no long, ``explained`` is ``e`` over the trace, and
    ``identity_error`` the largest entry of the whitened covariance minus the identity.

    Null vectors and those with null, non-finite or very large entries (2^52 after scaling) are left
    out. Vectors of another length than the most frequent one (the longer of two) have no covariance with
    the rest and are left out too. Directions without variance have no whitened form: with ``m``
    of them fewer components come back, and none if all vectors are equal. Repeated rows and rows
    without an id come back as often as they stand. Other columns are not read. No rows: no result.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = kept(usable.where("embedding is not null").mapInArrow(_whole(scale), "vec_id long, width int, x binary"))
    widths = rows.groupBy("width").count().orderBy(F.col("count").desc(), F.col("width").desc()).first()
    if widths is None or not widths["width"]:
        return spark.createDataFrame([], _OUT)
    width = widths["width"]
    rows = rows.where(F.col("width") == width).select("vec_id", "x")
    # copies meet in the tasks that read them, before anything is shuffled
    fit = kept(rows.select("x").distinct())
    n = fit.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    dealt = fit.repartition(parts)

    spectrum = Spectrum.read(_folded(dealt.mapInArrow(_spectra(width), Spectrum.COLUMNS), parts, _merged).first().asDict())
    sums = np.array(spectrum.sums(), dtype=object)  # of the entries without their shift
    # whole part and rest of the mean, so that no digit is lost before the rows are centred
    mean_whole = np.array([int(s) // n for s in sums], dtype=np.int64)
    mean_rest = np.array([(int(s) % n) / n for s in sums])
    basis = np.linalg.qr(spectrum.vectors)[0]

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - mean_whole).astype(np.float64) - mean_rest

    def projected(x: np.ndarray) -> np.ndarray:
        y = centred(x) @ basis
        return y.T @ y

    total = _folded(_matrices(dealt, width, projected), parts, _added).first()["total"]
    covariance = np.frombuffer(total).reshape(width, width) / n
    values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(np.trace(covariance))
    used = int(min(components, (values > width * _EPS * max(values[0], 0)).sum()))
    if not used:
        return spark.createDataFrame([], _OUT)
    axes = axes[:, :used] * np.sign(axes[np.abs(axes[:, :used]).argmax(axis=0), np.arange(used)])
    turned = axes / np.sqrt(values[:used])
    explained = values[:used] / trace

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ turned
        return np.vstack([w.T @ w, w.sum(axis=0)])

    moment = np.frombuffer(_folded(_matrices(dealt, width, moments), parts, _added).first()["total"]).reshape(used + 1, used) / n
    error = float(np.abs(moment[:used] - np.outer(moment[used], moment[used]) - np.eye(used)).max())

    def out(batches):
        for batch in batches:
            data = batch.column("x").to_pylist()
            for start in range(0, len(data), 4096):
                x = unpacked(data[start: start + 4096], width)
                m = len(x)
                yield pa.record_batch({
                    "vec_id": batch.column("vec_id").slice(start, m).take(pa.array(np.repeat(np.arange(m), used))),
                    "component": pa.array(np.tile(np.arange(1, used + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * used, n, dtype=np.int64)),
                    "deviation": pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), used))),
                    "whitened": pa.array((centred(x) @ turned).ravel()),
                    "explained": pa.array(np.tile(explained, m)), "identity_error": pa.array(np.full(m * used, error))})

    return rows.mapInArrow(out, _OUT)
