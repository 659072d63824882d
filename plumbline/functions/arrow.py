"""Move vector columns between Arrow batches and NumPy matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, D) float64 matrix of a list column without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def lists(values: np.ndarray) -> pa.Array:
    """List column from the rows of a matrix."""
    rows, width = values.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows divided by (norm + 1e-12)."""
    return values / (np.linalg.norm(values, axis=1, keepdims=True) + 1e-12)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    """The batch with columns appended, or replaced where the name exists."""
    names = list(batch.schema.names)
    arrays = list(batch.columns)
    for name, value in new.items():
        value = value if isinstance(value, pa.Array) else pa.array(value)
        if name in names:
            arrays[names.index(name)] = value
        else:
            names.append(name)
            arrays.append(value)
    return pa.RecordBatch.from_arrays(arrays, names=names)
