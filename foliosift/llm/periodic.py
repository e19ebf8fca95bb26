"""Runs of repeated words, found by Lempel-Ziv blocks.

A run is a stretch of words with smallest period q and at least ``max(shortest, exponent * q)``
words that no neighbouring word extends. All texts of a batch are worked on together in numpy:

* A suffix array of each text by doubling: after round k the suffixes are in the order of their
  first 2**k words. Only suffixes still tied go on, and each round's names are kept: equal names
  are equal stretches, so they tell in steps of halves how far any two places agree, to either side.
* The common prefixes of neighbours in that order, from the same names.
* The longest previous factor of each place: of the nearest suffixes on either side that begin
  further left, the one that shares more; found by galloping over tables of block minima.
* Blocks: each is the longest stretch that began earlier, or one new word.
* Main's extensions: a run that touches a bound between blocks of a and b words has
  (exponent - 1) * q <= a + b for one such bound, so only these periods are tried there, each
  extended to both sides from the bound.
* All other runs lie inside a block and are copies of runs in its source: runs are kept in
  buckets by start, and a block copies from the buckets of its source what fits inside.

The work is some log(n) steps of numpy for each word whatever the text; memory is some
8 * log2(longest agreement) bytes a word of the slice, or of the one text that is longer than a slice.

Defined results: words are what lies between ASCII white space; a null, empty or blank text has no
runs and no words; a null id stays null; repeated rows and rows that share an id are separate
texts; texts of any length are taken whole; an empty table gives an empty result; only the id and
text columns are read, so no other name can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliosift.llm.buffers import in_slices, utf8, words
from foliosift.llm.common import table
from foliosift.packaged import ship

SHORTEST, EXPONENT = 6, 4
#: Bytes of text that are handled at once.
TOGETHER = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Suffixes:
    """Of texts one after another: ``order``, the places by suffix, text by text; ``common``, the
    words each shares with the one before it there; ``names``, by rounds."""

    def __init__(self, code: np.ndarray, at: np.ndarray):
        n, size = len(code), np.diff(at)
        self.n, text = n, np.repeat(np.arange(len(size)), size)
        end = np.repeat(at[1:], size)
        key = text * (int(code.max(initial=0)) + 1) + code
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.append(True, key[1:] != key[:-1])
        name = np.empty(n + 1, np.int32)
        name[order], name[n] = np.maximum.accumulate(np.where(first, np.arange(n), 0)), -1
        self.names, ties, step = [name], [np.flatnonzero(~first)], 1
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        while len(tied):
            place = order[tied]
            ahead = place + step
            key = name[place] * np.int64(n + 2) + np.where(ahead < end[place], name[np.minimum(ahead, n)], -1) + 1
            by = np.argsort(key, kind="stable")
            place, key = place[by], key[by]
            first = np.append(True, key[1:] != key[:-1])
            order[tied], name = place, name.copy()
            name[place] = np.maximum.accumulate(np.where(first, tied, 0))
            self.names.append(name)
            ties.append(tied[~first])
            tied, step = tied[~(first & np.append(first[1:], True))], 2 * step
        self.order, self.common = order, np.zeros(n, np.int32)
        for k in reversed(range(len(ties))):
            r = ties[k]
            shared = self.common[r]
            self.common[r] += (self.names[k][order[r] + shared] == self.names[k][order[r - 1] + shared]).astype(np.int32) << k

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on are those from j on; i < j in one text."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(self.names[0][i] == self.names[0][j])
        a, b = i[live], j[live]
        for k in reversed(range(len(self.names))):
            step = (self.names[k][a] == self.names[k][b]).astype(np.int64) << k
            out[live] += step
            a, b = a + step, b + step
        return out

    def agree_back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words back from i, with it, are those back from j; i < j in one text."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero((i >= 0) & (self.names[0][i] == self.names[0][j]))
        a, b = i[live], j[live]
        for k in reversed(range(len(self.names))):
            x, y = a - (1 << k) + 1, b - (1 << k) + 1
            step = ((x >= 0) & (self.names[k][np.maximum(x, 0)] == self.names[k][np.maximum(y, 0)])).astype(np.int64) << k
            out[live] += step
            a, b = a - step, b - step
        return out


def _nearest(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank: what it shares with the nearest rank before it whose place is further left,
    and that place."""
    length, source = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
    least, shared = [order.astype(np.int32)], [common]
    r = np.flatnonzero(common > 0)
    c, m = r - 1, common[r]
    stopped, k = [], 0
    while len(r):
        if k == len(least):
            half = 1 << (k - 1)
            for tables in (least, shared):
                t = tables[-1].copy()
                t[half:] = np.minimum(t[half:], tables[-1][:-half])
                t[: 2 * half - 1] = -1
                tables.append(t)
        over = least[k][c] > order[r]
        stopped.append((r[~over], c[~over], m[~over]))
        r, c, m = r[over], c[over], m[over]
        m, c, k = np.minimum(m, shared[k][c]), c - (1 << k), k + 1
        r, c, m = r[m > 0], c[m > 0], m[m > 0]
    none = np.zeros(0, np.int64)
    r, c, m = none, none, none.astype(np.int32)
    for k in reversed(range(-1, len(stopped) - 1)):
        r, c, m = (np.concatenate([x, y]) for x, y in zip((r, c, m), stopped[k + 1]))
        if k >= 0:
            over = least[k][c] > order[r]
            m = np.where(over, np.minimum(m, shared[k][c]), m)
            c = np.where(over, c - (1 << k), c)
            r, c, m = r[m > 0], c[m > 0], m[m > 0]
    length[r], source[r] = m, order[c]
    return length, source


def previous_factors(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each place the longest stretch from it that also begins further left in its text: its
    words, and where it begins."""
    order, common = suffixes.order, suffixes.common
    left, at_left = _nearest(order, common)
    right, at_right = (x[::-1] for x in _nearest(order[::-1].copy(), np.append(common[1:], 0)[::-1].astype(np.int32)))
    longest, source = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    longest[order], source[order] = np.maximum(left, right), np.where(left >= right, at_left, at_right)
    return longest, source


def _copied(runs: list[tuple[int, int, int]], blocks: list[tuple[int, int, int]], shortest: int) -> list[tuple[int, int, int]]:
    """Adds to the runs (start, length, period) of one text those inside blocks (start, words, source)."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, length, period in runs:
        buckets.setdefault(start, []).append((length, period))
    for begin, size, source in blocks:
        if size < shortest + 2:
            continue
        back = begin - source
        for start in range(begin + 1, begin + size - shortest):
            for length, period in buckets.get(start - back, ()):
                if start + length < begin + size:
                    found = buckets.setdefault(start, [])
                    if (length, period) not in found:
                        found.append((length, period))
    return sorted((start, *run) for start, found in buckets.items() for run in found)


def find_runs(code: np.ndarray, at: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and period. ``code`` has the words of
    all texts as numbers, ``at`` where each text starts and the last ends."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    if not len(code):
        return out
    suffixes = Suffixes(code, at)
    longest, source = previous_factors(suffixes)
    after, blocks, i = (np.arange(len(code)) + np.maximum(longest, 1)).tolist(), [], 0
    while i < len(code):
        blocks.append(i)
        i = after[i]
    bounds = np.array([*blocks, len(code)])
    size = np.diff(bounds, append=len(code))
    # a bound between texts ends one and begins another; as two bounds, neither sees the other's words
    start_of, end_of = (np.isin(bounds, x) for x in (at[:-1], at[1:]))
    ahead, behind = size, np.append(0, size[:-1])
    inner = np.where(start_of, 0, behind) + np.where(end_of & ~start_of, 0, ahead)
    bounds, reach = np.concatenate([bounds, bounds[end_of]]), np.concatenate([inner, behind[end_of]])
    # length - q words agree with those q further on; at least (exponent - 1) * q and shortest - q of them
    most = np.where(reach >= shortest - reach // max(1, exponent - 1), reach // max(1, exponent - 1), 0)
    b = np.repeat(bounds, most)
    q = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
    # the bound is the first word of a period inside the run, or the first after one
    c, q = np.concatenate([b, b - q]), np.tile(q, 2)
    near = (c >= 0) & (c + q <= len(code))
    c, q = c[near], q[near]
    right, left = suffixes.agree(c, c + q), suffixes.agree_back(c - 1, c + q - 1)
    found = (right + left >= (exponent - 1) * q) & (right + left + q >= shortest)
    c, q, right, left = c[found], q[found], right[found], left[found]
    start, length = c - left, right + left + q
    by = np.lexsort((q, length, start))
    start, length, q = start[by], length[by], q[by]
    # of one stretch's periods the smallest
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
    start, length, q = start[new], length[new], q[new]
    text = np.searchsorted(at, start, side="right") - 1
    places = np.array(blocks)
    for t in np.unique(text).tolist():
        low, own = int(at[t]), text == t
        those = places[np.searchsorted(places, low) : np.searchsorted(places, at[t + 1])]
        runs = list(zip((start[own] - low).tolist(), length[own].tolist(), q[own].tolist()))
        out[t] = _copied(runs, list(zip((those - low).tolist(), longest[those].tolist(), (source[those] - low).tolist())), shortest)
    return out


def _scanned(shortest: int, exponent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1, TOGETHER):
            data, starts, at = words(*utf8(batch.column(1)))
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
            code = texts.dictionary_encode().indices.to_numpy().astype(np.int64)
            runs = find_runs(code, at, shortest, exponent)
            change = np.zeros(len(code) + 1, np.int64)
            for low, found in zip(at.tolist(), runs):
                for start, length, period in found:
                    change[low + start + period] += 1
                    change[low + start + length] -= 1
            kept = np.cumsum(change[:-1]) == 0
            bounds = np.append(0, np.cumsum(kept))[at]
            lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), texts if kept.all() else texts.filter(pa.array(kept)))
            flat = [r for found in runs for r in found]
            fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            ends = np.cumsum([0, *map(len, runs)])
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUN))),
                 pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def collapse_runs(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, its runs by start and period, and ``collapsed``,
    its words joined by a space without those that a run repeats. ``exponent`` is 2 or more."""
    if exponent < 2 or shortest < 2:
        raise ValueError("a run repeats its period, so exponent and shortest are 2 at least")
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(_scanned(shortest, exponent), SCHEMA)


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the texts, by their ids, have been made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    drawn = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")).alias("words"))
    drawn = drawn.withColumn("n", F.size("words").cast("long")).withColumn("a", F.expr("if(n > 0, (h div 10) % n, 0)"))
    drawn = drawn.withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    periodic = F.expr("concat_ws(' ', transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))]))")
    return drawn.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period; of such the first, then that of least period.
    Quotients of numbers under 2**26 that differ do so as doubles."""
    return F.array_max(F.transform(runs, lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("length"))))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(with_periods(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
