"""Arrow text columns as numpy arrays: bytes, word bounds, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes between words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A to Z become a to z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and where each row starts and the last ends; a null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def in_slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of text, or of one row that has more."""
    for batch in batches:
        at = utf8(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes without those between words; where each word starts there and the last ends;
    and the number of words before each row and in all."""
    kept = ~SPACE[data]
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    rows = at[:-1][at[:-1] < at[1:]]
    first[rows] = kept[rows]
    starts = np.flatnonzero(first)
    before = np.cumsum(kept) - kept
    return data[kept], np.append(before[starts], np.count_nonzero(kept)), np.searchsorted(starts, at)
