"""List columns of Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and where each row starts and the last ends."""
    at = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), at


def starts(lengths: np.ndarray) -> np.ndarray:
    """Where each of stretches one after another begins."""
    return np.cumsum(lengths) - lengths


def spread(first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ranges given by first and length, and which range each is of."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(len(of)) - starts(lengths)[of] + first[of], of


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out
