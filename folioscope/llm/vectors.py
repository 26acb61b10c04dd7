"""Vectors in Arrow columns: usable rows as numpy matrices, and whole numbers packed as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte widths of packed numbers; the first byte of a packed vector is its width.
_SIZES = (1, 2, 4, 8)


def finite_rows(column: pa.Array):
    """``(rows, matrix)`` per length: the lists that are not null and hold finite numbers only."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for length in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == length)
        matrix = values[starts[at][:, None] + np.arange(length)]
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            yield at[good], matrix[good]


def packed(matrix: np.ndarray) -> list[bytes]:
    """Each row of whole numbers (int64) as bytes, in the least width that holds it: equal rows, equal bytes."""
    if not matrix.shape[1]:
        return [b"\x01"] * len(matrix)
    most = np.maximum(matrix.max(axis=1), ~matrix.min(axis=1))  # ~x = -x-1, so that -128 fits a byte
    sizes = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], _SIZES[:3], _SIZES[3])
    out: list[bytes] = [b""] * len(matrix)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        body = matrix[at].astype(f"<i{size}")
        for i, row in zip(at.tolist(), body):
            out[i] = bytes([size]) + row.tobytes()
    return out


def unpacked(data: list[bytes], length: int) -> np.ndarray:
    """Rows of ``length`` numbers from their bytes, as int64."""
    out = np.empty((len(data), length), dtype=np.int64)
    if not length:
        return out
    sizes = np.array([d[0] for d in data])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(data[i][1:] for i in at), dtype=f"<i{size}").reshape(len(at), length)
    return out
