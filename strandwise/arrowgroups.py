"""Runs of equal keys in sorted Arrow batches.

`mapInArrow` over a partition that is sorted by its group keys sees each group
as one run of rows, which may span batches. These helpers find the runs without
a Python object per row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _codes(column: pa.Array) -> np.ndarray:
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    encoded = pc.dictionary_encode(column, null_encoding="encode")
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return encoded.indices.to_numpy(zero_copy_only=False)


def run_starts(columns: Sequence[pa.Array]) -> np.ndarray:
    """Row numbers at which a run of equal rows begins; nulls equal each other."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for column in columns:
        codes = _codes(column)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def group_ids(columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A dense group number per row, in any row order, and a row that stands for each group."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.zeros(n, np.int64)
    for column in columns:
        codes = _codes(column).astype(np.int64)
        _, ids = np.unique(ids * (int(codes.max()) + 1) + codes, return_inverse=True)
    _, first = np.unique(ids, return_index=True)
    return ids, first
