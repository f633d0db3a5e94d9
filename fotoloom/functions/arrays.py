"""Arrow list columns as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable_matrix(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a usable vector (`dim` components, none null or NaN, not all zero), and those rows as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, bool), np.zeros((0, dim), np.float32)
    offsets = np.asarray(column.offsets)
    ok = np.diff(offsets) == dim
    if column.null_count:
        ok &= np.asarray(column.is_valid())
    flat = column.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # nulls become NaN
    if not ok.any():
        return ok, np.zeros((0, dim), np.float32)
    starts = offsets[:-1][ok]
    if ok.all() and starts[-1] - starts[0] == (n - 1) * dim:
        rows = values[starts[0] : starts[0] + n * dim].reshape(n, dim)
    else:
        rows = values[starts[:, None] + np.arange(dim)]
    good = np.isfinite(rows).all(1) & rows.any(1)
    if not good.all():
        ok[np.flatnonzero(ok)[~good]] = False
        rows = rows[good]
    return ok, rows


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; none may be zero."""
    rows = rows.astype(np.float64)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
