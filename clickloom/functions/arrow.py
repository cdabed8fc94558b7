"""Between Arrow list columns and numpy matrices, without a copy per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype=np.float64) -> np.ndarray:
    """A column of equally long lists as a ``rows x width`` matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a vector column has missing vectors")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width:
        raise ValueError(f"vectors of another length than {width}")
    return flat.astype(dtype, copy=False).reshape(len(column), width)


def lists(m: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m, dtype=np.float64).ravel()))
