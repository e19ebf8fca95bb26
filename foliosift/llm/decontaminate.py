"""Benchmark decontamination by spaced seeds.

A mask looks at some positions of a window of words and ignores the others, so
its hash survives a substitution at an ignored position. Every window of every
document is hashed under each mask and joined with the hashes of the benchmark's
windows. A hit fixes how the document and the item lie against each other; all of
the item's words are compared there, substitutions allowed, and an item counts as
contained when at least ``coverage`` of its words (and ``least`` words) agree.
Alignments of the same item that a deletion or an insertion shifted add up, where a
window of ``MASKS`` was hit.

Every single alignment with that coverage is found: the item is cut into tiles so
short that, with no more than two agreeing words in each, too few would agree. So
three words of a tile agree, and every three words of a tile are a seed; the documents'
windows are hashed under each shape that such a triple can have (``triples``).

All of it is DataFrame expressions. A seed is a hash, an item and a place, so some 40 bytes;
the benchmark's seeds, and its items' words beside them, are broadcast only after they were
counted. Above ``broadcast_rows`` seeds, or as many words, that side is shuffled by its key, and
the documents' words are fetched for the hits alone.

Defined results: words are lower-case runs of letters and digits; null and empty
texts, and documents or items below ``SHORT`` words, match nothing; items shorter
than a mask use windows of ``SHORT`` words in full; repeated rows are joined by
doc_id, so they count once; empty tables give an empty result; only the id and
text columns are read.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliosift.llm.common import table

#: The masks, each of 7 words in a window of 11 at most.
MASKS = ["11101100101", "11010011011", "1111111"]
SHORT = 5
SPAN = max(map(len, MASKS))
#: Places of a piece of a text.
PIECE = 1024


def tile_length(coverage: float, least: int) -> int:
    """The shortest tile so that an item with enough agreeing words has three of them in one."""
    if coverage <= 0:
        raise ValueError("coverage must be above 0")
    for tile in count(3):
        if coverage * tile > 2:
            # beyond this length the share alone decides
            last = math.ceil(2 * tile / (coverage * tile - 2)) + 1
            if all(2 * -(-n // tile) < max(math.ceil(coverage * n - 1e-9), min(least, n)) for n in range(SHORT, last + 1)):
                return tile


def triples(tile: int) -> list[str]:
    """The masks of all triples that fit in a tile."""
    return ["".join("1" if k in (0, i, j) else "0" for k in range(j + 1)) for i, j in combinations(range(1, tile), 2)]


def _words(text: str) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.transform(F.split(clean, " "), lambda w: F.xxhash64(w))


def _keys(words: str, at: str, masks: list[str]) -> Column:
    """The seed of each mask at a position; null where the window goes past the end."""
    keys = []
    for mask in masks:
        offsets = [i for i, c in enumerate(mask) if c == "1"]
        places = [F.get(F.col(words), F.col(at) + i) for i in offsets]
        # the mask is part of the hash; a window that ends too early has no seed
        keys.append(F.when(F.col(at) + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *places)))
    return F.array(*keys)


def _seeds(df: DataFrame, words: str, masks: list[str], *keep: str) -> DataFrame:
    windows = df.select(*keep, F.posexplode(words).alias("_at", "_w")).drop("_w")
    return windows.withColumn("_seed", F.explode(_keys(words, "_at", masks))).where("_seed IS NOT NULL")


def _pieces(words: DataFrame, reach: int) -> DataFrame:
    """Texts in pieces of ``PIECE`` places, each with as many words more on both sides as an item can
    reach, and the number of its first word: a place's row is bounded, whatever its text's length."""
    begins = f"transform(sequence(0, (size(words) - 1) div {PIECE}), p -> greatest(0, p * {PIECE} - {reach}))"
    pieces = F.expr(f"transform(zip_with({begins}, sequence(1, (size(words) - 1) div {PIECE} + 1), (start, p) -> struct(start, p)), x -> struct(x.start AS start, slice(words, x.start + 1, x.p * {PIECE} + {reach} - x.start) AS words))")
    return words.select("doc_id", F.explode(pieces).alias("p")).select("doc_id", F.col("p.start").alias("_start"), F.col("p.words").alias("words"))


def _tiled(items: DataFrame, tile: int) -> DataFrame:
    """Seeds of the items' triples that lie within one tile."""
    parts = [_seeds(items, "item", [m], "item_id", "item").where(F.col("_at") % tile + len(m) <= tile) for m in triples(tile)]
    return reduce(DataFrame.unionByName, parts)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", coverage: float = 0.5, least: int = 7, broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, at (the item's first word in
    the document's words, as the best alignment has it), matched, item_words, coverage."""
    items = benchmark.select(F.col(item_column).alias("item_id"), _words(item_text).alias("item")).where(f"size(item) >= {SHORT} AND item_id IS NOT NULL")
    short = items.where(f"size(item) < {SPAN}").limit(1).count() > 0
    masks = MASKS + (["1" * SHORT] if short else [])
    seeds = _seeds(items, "item", MASKS, "item_id", "item")
    if short:
        seeds = seeds.unionByName(_seeds(items.where(f"size(item) < {SPAN}"), "item", masks[-1:], "item_id", "item"))
    tile = tile_length(coverage, least)
    masks = masks + triples(tile)
    seeds = seeds.withColumn("dense", F.lit(1)).unionByName(_tiled(items, tile).withColumn("dense", F.lit(0))).withColumnRenamed("_at", "item_at").drop("item")
    total, reach = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0)), F.coalesce(F.max(F.size("item")), F.lit(0))).first()
    reach = max(reach, SPAN)
    words = docs.select(F.col(id_column).alias("doc_id"), _words(text_column).alias("words")).where(f"size(words) >= {SHORT} AND doc_id IS NOT NULL")
    if total <= broadcast_rows:
        items = F.broadcast(items)
    seen = _seeds(_pieces(words, reach), "words", masks, "doc_id", "_start", "words")
    shift = (F.col("_start") + F.col("_at") - F.col("item_at")).alias("shift")
    if seeds.count() <= broadcast_rows:
        hits = seen.join(F.broadcast(seeds), "_seed").join(items, "item_id").select("doc_id", "item_id", shift, "dense", "item", "words", "_start")
    else:
        near = seen.drop("words").join(seeds, "_seed").select("doc_id", "item_id", shift, "dense").groupBy("doc_id", "item_id", "shift").agg(F.max("dense").alias("dense"))
        hits = near.join(words.withColumn("_start", F.lit(0)), "doc_id").join(items, "item_id")
    there = "get(words, shift + j - _start)"
    agree = F.expr(f"aggregate(sequence(0, size(item) - 1), 0, (n, j) -> n + if({there} = get(item, j), 1, 0))")
    lain = (
        hits.select("doc_id", "item_id", "shift", "dense", F.size("item").alias("item_words"), agree.alias("matched"))
        .groupBy("doc_id", "item_id", "shift").agg(F.max("item_words").alias("item_words"), F.max("matched").alias("matched"), F.max("dense").alias("dense"))
    )
    total = lain.groupBy("doc_id", "item_id").agg(
        F.max_by("shift", F.struct("matched", -F.col("shift"))).cast("long").alias("at"), F.max("item_words").cast("long").alias("item_words"),
        # triples meet by chance: their shifts don't add up
        F.greatest(F.least(F.sum(F.col("matched") * F.col("dense")), F.max("item_words")), F.max("matched")).cast("long").alias("matched"),
    )
    share = F.col("matched") / F.col("item_words")
    return total.withColumn("coverage", share).where((share >= coverage) & (F.col("matched") >= F.least(F.lit(least), "item_words")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
