"""Vectors of an array column as numpy matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows as float64, short ones filled with zeros, and which rows are whole: not null, no null or non-finite component."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    flat = column.flatten()
    values = np.asarray(pa.compute.fill_null(flat.cast(pa.float64()), float("nan")), np.float64)
    width = int(sizes.max()) if n else 0
    out = np.zeros((n, width))
    if n and (sizes == width).all():
        out = values.reshape(n, width).copy()
    elif n:
        out[np.repeat(np.arange(n), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out, column.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(out).all(axis=1)
