"""Reading vector columns inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batch: pa.RecordBatch, col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix)`` for each vector length of a batch; rows whose vector is null, empty or holds
    null or non-finite components are left out."""
    vec = batch.column(col)
    size = np.asarray(vec.value_lengths().fill_null(0))
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        flat = vec.take(pa.array(rows)).flatten().cast(pa.float64())
        flat = flat.fill_null(float("nan")) if flat.null_count else flat
        mat = np.asarray(flat, dtype=np.float64).reshape(len(rows), int(n))
        ok = np.isfinite(mat).all(axis=1)
        if ok.any():
            yield rows[ok], mat[ok]
