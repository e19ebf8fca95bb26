"""Exact token counts of a byte-level BPE vocabulary.

Merges never cross the bounds of the vocabulary's own word pattern, so a text's count is the sum of its
words'. Each task merges a word once, however often and in however many texts it stands, and
keeps its count; when ``KEPT`` words or ``CHARS`` characters are known it begins anew, and a text's words come
one by one, so a worker's memory is bounded. So
the merging grows with the distinct words, and the rest is splitting and a sum.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliosift.packaged import ship

#: Words a worker remembers, and their characters.
KEPT, CHARS = 100_000, 1_000_000
#: Fixed value: the word pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD = regex.compile(PATTERN)


class Merger:
    """Counts a word's tokens: its bytes are joined pair by pair, the pair of least rank first."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.known: dict[str, int] = {}
        self.chars = 0

    def merged(self, word: str) -> int:
        parts = [bytes([b]) for b in word.encode("utf-8", "surrogatepass")]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts)

    def longer(self, word: str) -> int:
        """A word of many characters, such as a stretch of one sign: pairs of one rank are joined in one go."""
        parts = [bytes([b]) for b in word.encode("utf-8", "surrogatepass")]
        while len(parts) > 1:
            rank = min(self.ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:]))
            if rank == 1 << 30:
                break
            joined, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.ranks.get(parts[i] + parts[i + 1]) == rank:
                    joined.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return len(parts)

    def count(self, text: str) -> int:
        total, known = 0, self.known
        for found in WORD.finditer(text):
            word = found[0]
            n = known.get(word)
            if n is None:
                if len(known) >= KEPT or self.chars >= CHARS:
                    known.clear()
                    self.chars = 0
                n = self.merged(word) if len(word) < 100 else self.longer(word)
                if len(word) < 100:
                    known[word] = n
                    self.chars += len(word)
            total += n
        return total


_mergers: dict[str, Merger] = {}


def counted(rows: DataFrame, column: str, vocabulary: str, name: str = "tokens") -> DataFrame:
    """rows with the exact number of tokens of a text column. ``vocabulary`` is the path of a file of
    ranks (a line for each token: its bytes in base 64, its rank), the same on every machine. A null or empty text has none."""
    ship(rows.sparkSession)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merger = _mergers.setdefault(vocabulary, None) or Merger(vocabulary)
        _mergers[vocabulary] = merger
        for texts in batches:
            # one text at a time is a Python string
            yield pa.array((merger.count(t) if (t := text.as_py()) else 0 for text in texts), pa.int64())

    return rows.withColumn(name, F.arrow_udf(count, "long")(F.col(column)))
