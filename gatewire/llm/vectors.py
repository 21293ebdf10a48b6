"""Integer vectors of a list column, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scaled components must be below this, so that sums of squares and products of a vector fit 64 bits.
LIMIT = 1 << 27
#: Most vectors in a block, and most components; a longer vector is a block of its own.
ROWS, COMPONENTS = 4096, 1 << 19


def scaled(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of every vector that can be used, and all components as floor(scale * x).

    Left out are NULL vectors and those with a component that is NULL, not finite, or reaches LIMIT when scaled.
    """
    lists = column.cast(pa.large_list(pa.float64()))
    bounds = lists.offsets.to_numpy()
    start, end = bounds[:-1], bounds[1:]
    values = np.floor(scale * lists.values.to_numpy(zero_copy_only=False).astype(np.float64))
    usable = np.abs(values) < LIMIT  # false for NaN, which NULL becomes
    unusable = np.concatenate(([0], np.cumsum(~usable)))
    rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (unusable[end] == unusable[start]))
    whole = np.where(usable, values, 0).astype(np.int64)
    return rows, start[rows], (end - start)[rows], whole


def matrices(batch: pa.RecordBatch, column: str, scale: int, width: int | None = None):
    """(rows of the batch, matrix of their vectors) in blocks of one length; with ``width`` only of that one."""
    rows, start, length, values = scaled(batch.column(column), scale)
    for size in [width] if width is not None else np.unique(length).tolist():
        here = np.flatnonzero(length == size)
        most = max(1, min(ROWS, COMPONENTS // max(size, 1)))
        for low in range(0, len(here), most):
            part = here[low : low + most]
            yield rows[part], values[start[part][:, None] + np.arange(size)]
