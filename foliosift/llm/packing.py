"""Bounded-space online packing of tokenized documents into fixed windows.

Each partition keeps a fixed number of open windows. A piece goes to the open
window with the least room that still holds it. When none does and no further
window may be opened, the fullest is emitted: a gap of at most ``slack`` tokens
stays as padding, a larger one is filled by cutting the piece. What is still
open at the end of a partition carries its ids along and is merged in rounds
over groups of ``fan_in`` partitions, so no task ever holds more than
``fan_in * open_windows`` windows.

Defined results: a null or empty text is the closing id alone; a null id is kept
as null; repeated rows are packed as separate documents; an empty table gives an
empty result; other columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliosift.llm.common import cut, table
from foliosift.llm.wordpieces import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long, held binary"
ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary()), ("part", pa.int64()), ("held", pa.binary())]
)
#: Sequence ids: the round in the highest bits, then the partition or group, then a counter.
ROUND_BITS, GROUP_BITS = 56, 30


class Packer:
    """Piece: (doc_id, start, ids as little-endian uint32 bytes, tokens of its document)."""

    def __init__(self, window: int, open_windows: int, slack: int, emit: Callable[[list[tuple]], None]):
        self.window, self.most, self.slack, self.emit = window, open_windows, slack, emit
        self.open: list[list] = []  # [tokens, pieces]

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        while ids:
            n = len(ids) // 4
            if n >= self.window:
                take = self.window
                self.emit([(doc_id, start, ids[: 4 * take], doc_tokens)])
            else:
                take = self._place(doc_id, start, ids, n, doc_tokens)
            start, ids = start + take, ids[4 * take :]

    def _place(self, doc_id, start: int, ids: bytes, n: int, doc_tokens: int) -> int:
        best = max((w for w in self.open if w[0] + n <= self.window), key=lambda w: w[0], default=None)
        if best is None and len(self.open) >= self.most:
            best = max(self.open, key=lambda w: w[0])
            if self.window - best[0] <= self.slack:
                self._close(best)
                best = None
            else:
                n = self.window - best[0]
        if best is None:
            best = [0, []]
            self.open.append(best)
        best[0] += n
        best[1].append((doc_id, start, ids[: 4 * n], doc_tokens))
        if best[0] == self.window:
            self._close(best)
        return n

    def _close(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.emit(window[1])


class Rows:
    """Collects rows of emitted windows; a batch is ready after so many bytes."""

    def __init__(self, first_id: int, part: int, with_ids: bool):
        self.next, self.part, self.with_ids = first_id, part, with_ids
        self.columns: list[list] = [[] for _ in ARROW.names]
        self.bytes = 0

    def window(self, pieces: list[tuple], held: bool = False) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            row = (doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, self.next, at, ids if self.with_ids and not held else None, self.part, ids if held else None)
            for column, value in zip(self.columns, row):
                column.append(value)
            at += len(ids) // 4
            self.bytes += 80 + len(ids) * (self.with_ids or held)
        self.next += 1

    def take(self) -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(self.columns, ARROW.types)], schema=ARROW)
        self.columns, self.bytes = [[] for _ in ARROW.names], 0
        return batch


def _pack_texts(path: str, window: int, open_windows: int, slack: int, eos_id: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, end = encoder(path), np.array([eos_id], "<u4").tobytes()
        rows = Rows(part << GROUP_BITS, part, with_ids)
        packer = Packer(window, open_windows, slack, rows.window)
        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                ids += end
                packer.add(doc_id, 0, ids, len(ids) // 4)
                if rows.bytes > 4 << 20:
                    yield rows.take()
        for _, pieces in packer.open:
            rows.window(pieces, held=True)
        yield rows.take()

    return run


def _merge(level: int, last: bool, window: int, open_windows: int, slack: int, with_ids: bool) -> Callable:
    def run(key: tuple, held: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = Rows((level << ROUND_BITS) + (group << GROUP_BITS), group, with_ids)
        packer = Packer(window, open_windows, slack, rows.window)
        pieces = list(zip(*(held.column(c).to_pylist() for c in ("doc_id", "start", "held", "doc_tokens", "sequence_id", "offset"))))
        for doc_id, start, ids, doc_tokens, *_ in sorted(pieces, key=lambda p: (-len(p[2]), p[4], p[5])):
            packer.add(doc_id, start, ids, doc_tokens)
        left = sorted(packer.open, key=lambda w: w[0])
        if last and left:
            # The open windows are poured into one another, so only one is padded.
            tail = Packer(window, 1, 0, rows.window)
            for piece in (p for w in reversed(left) for p in w[1]):
                tail.add(*piece)
            left = tail.open
        for _, pieces in left:
            rows.window(pieces, held=not last)
        return pa.Table.from_batches([rows.take()])

    return run


def pack(
    docs: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", window: int = 2048,
    open_windows: int = 16, slack: int = 16, eos_id: int = 1, fan_in: int = 64, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with ``with_ids`` the piece's ids as little-endian unsigned 32-bit bytes."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    first = cut(texts.mapInArrow(_pack_texts(tokenizer, window, open_windows, slack, eos_id, with_ids), SCHEMA), "packed")
    done, held = [first.where("held is null")], first.where("held is not null")
    parts, level = (first.agg(F.max("part")).first()[0] or 0) + 1, 1
    while True:
        parts = -(-parts // fan_in)
        last = parts == 1
        merged = (
            held.withColumn("part", F.expr(f"part div {fan_in}")).groupBy("part")
            .applyInArrow(_merge(level, last, window, open_windows, slack, with_ids), SCHEMA)
        )
        if last:
            done.append(merged)
            break
        merged = cut(merged, "merged")
        done.append(merged.where("held is null"))
        held, level = merged.where("held is not null"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "held") if with_ids else out.drop("part", "held", "ids")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
