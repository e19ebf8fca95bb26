"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine.

The labelled rows of the learning folds give at most ``examples`` examples, toxic
and other ones as near to half each as there are, in the order of a hash: this is
the one bounded sample. The index holds every term of the examples whose use differs
between the classes: a G-test of each, and Benjamini and Hochberg's step-up at ``fdr``
over all of them, so their number grows with the sample; a term that doesn't differ is
no evidence of a label, and is left out of both sides of the cosine. Document
frequencies count all documents. An example's weight is its class's share of the
labelled rows over its share of the examples. Terms are words, stems (the first 3 to 8
characters of longer words) and either of them used at least 2, 3 or 5 times.

Index: examples with like terms lie side by side in blocks; a posting list has one
entry for each block that holds its term, with the weights there and the largest of
them. A query's bound for a block is the sum over its terms;
blocks are opened from the highest bound down to the k-th best cosine so far, so the
k nearest are exact. Examples that tie with the k-th are all neighbours. Votes are
weighted by cosine to the power ``sharpness``; isotonic regression over the
examples, each left out in turn, turns votes into scores.

A score is a function of the text alone, and is put on its own row: no join follows, so
rows without an id or with a repeated one are scored as any other. Defined results: null and
empty texts, and texts with no term, get the weighted share of toxic ones among such
examples; null labels are not used; with no labels every score is 0; an empty table gives an
empty result; the input's columns are kept, and one named score or evidence is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from foliosift.llm import wordpieces
from foliosift.llm.common import cut, dropped, table

#: ASCII that isn't a letter separates words; what isn't ASCII belongs to them.
LETTERS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
EVIDENCE_TYPE = ArrayType(StructType([StructField("doc_id", LongType()), StructField("similarity", DoubleType()), StructField("label", IntegerType())]))
BLOCK = 64
STEMS, REPEATS = (3, 8), (2, 3, 5)


def learns(id_column: str = "doc_id") -> Column:
    """Whether labels of a row may be learned: its fold isn't the one held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 != 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(LETTERS).split()


def features(word: bytes) -> list[str]:
    """A word and its stems: what starts with its first 3 to 8 characters."""
    text = word.decode("utf-8", "replace")
    return [text, *(text[:n] + "*" for n in range(STEMS[0], min(STEMS[1], len(text) - 1) + 1))]


def grades(name: str, count: int) -> list[str]:
    """A feature, and again for each number of uses in REPEATS that the text reaches: a
    cosine alone can't tell one use from many."""
    return [name, *(f"{name}@{n}" for n in REPEATS if count >= n)]


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Uses of each term by label, summed up per batch; the input is the bounded sample."""
    known: dict[bytes, list[str]] = {}
    for batch in batches:
        used: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts: dict[str, int] = {}
            for w, n in Counter(words_of(text)).items():
                own = known.get(w)
                if own is None:
                    own = known[w] = features(w)
                for f in own:
                    counts[f] = counts.get(f, 0) + n
            used[label].update(g for f, n in counts.items() for g in grades(f, n))
            if len(known) > 200_000:
                known.clear()
        terms = list(used[0].keys() | used[1].keys())
        t, c = ([u[term] for term in terms] for u in (used[1], used[0]))
        yield pa.record_batch([pa.array(terms, pa.string()), pa.array(t, pa.int64()), pa.array(c, pa.int64())], names=["word", "t", "c"])


class Vectorizer:
    """Texts to the vocabulary's terms and their counts. It remembers the features of words it has seen."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.known = vocabulary, {}
        self.names = sorted({t.partition("@")[0] for t in vocabulary})
        self.bases = {t: i for i, t in enumerate(self.names)}

    def __call__(self, text: str | None) -> tuple[list[int], list[int]]:
        words, known, bases, vocabulary = words_of(text), self.known, self.bases, self.vocabulary
        if len(known) > 500_000:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = tuple(i for f in features(w) if (i := bases.get(f)) is not None)
        found = Counter(chain.from_iterable(map(known.__getitem__, words)))
        own = {vocabulary[g]: n for i, n in found.items() for g in grades(self.names[i], n) if g in vocabulary}
        terms = sorted(own)
        return terms, [own[t] for t in terms]


def _document_counts(shared) -> Callable:
    """Documents per term, summed up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordpieces.forget()
        vectorize, n = Vectorizer(shared.value), Counter()
        for batch in batches:
            for text in batch.column(0):
                n.update(vectorize(text.as_py())[0])
        yield pa.record_batch([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["t", "n"])

    return run


def _example_vectors(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectorize = Vectorizer(shared.value)
        for batch in batches:
            rows = [vectorize(text.as_py()) for text in batch.column(2)]
            terms, counts = ([r[i] for r in rows] for i in (0, 1))
            kind = pa.list_(pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(terms, kind), pa.array(counts, kind)], names=["doc_id", "label", "terms", "counts"])

    return run


def weights(terms: list[int], counts: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A unit vector: terms and (1 + ln tf) * idf over the norm."""
    at = np.asarray(terms, dtype=np.int64)
    w = (1 + np.log(np.asarray(counts, dtype=np.float64))) * idf[at]
    return at, w / (np.linalg.norm(w) or 1.0)


class BlockMax:
    """Inverted index of unit vectors in blocks. Entry e says that block ``block[e]`` holds the
    term, with ``weight[e]`` for each of its places and ``most[e]`` the largest; the entries of
    term t are ``first[t]`` to ``first[t + 1]``."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        order = sorted(range(len(vectors)), key=lambda i: tuple(vectors[i][0][np.argsort(-vectors[i][1], kind="stable")][:6]))
        self.order = np.array(order, dtype=np.int64)
        self.n_blocks = -(-len(order) // BLOCK)
        nothing = np.zeros(0, np.int64)
        term = np.concatenate([nothing, *(vectors[i][0] for i in order)])
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        entry, at = np.unique(term * max(1, self.n_blocks) + place // BLOCK, return_inverse=True)
        self.weight = np.zeros((len(entry), BLOCK))
        self.weight[at, place % BLOCK] = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        self.most, self.block = self.weight.max(axis=1, initial=0), entry % max(1, self.n_blocks)
        self.first = np.searchsorted(entry // max(1, self.n_blocks), np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the index and cosines above 0 of the k nearest, with all ties of the k-th."""
        n = self.first[terms + 1] - self.first[terms]
        entries = np.repeat(self.first[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
        blocks, share = self.block[entries], np.repeat(w, n)
        bounds = np.bincount(blocks, share * self.most[entries], self.n_blocks)
        by_block = np.argsort(blocks, kind="stable")
        ends = np.cumsum(np.bincount(blocks, minlength=self.n_blocks))
        best, at, kth = np.zeros(0), np.zeros(0, dtype=np.int64), 0.0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 1e-12 or bounds[b] < kth - 1e-9:
                break
            mine = by_block[ends[b - 1] if b else 0 : ends[b]]
            sims = share[mine] @ self.weight[entries[mine]]
            if without // BLOCK == b and without >= 0:
                sims[without % BLOCK] = 0
            keep = np.flatnonzero((sims > 1e-12) & (sims >= kth - 1e-9))
            best, at = np.concatenate([best, sims[keep]]), np.concatenate([at, keep + b * BLOCK])
            if len(best) > k:
                kth = np.partition(best, -k)[-k]
                keep = best >= kth - 1e-9
                best, at = best[keep], at[keep]
        return at, best


class Model:
    """Index, labels and calibration; bounded by the texts of ``examples`` examples."""

    def __init__(self, ids, labels, vectors, idf, share: float, k: int, sharpness: float):
        self.k, self.sharpness, self.idf = k, sharpness, idf
        self.index = BlockMax(vectors, len(idf))
        order = self.index.order
        self.ids, self.labels = np.asarray(ids, dtype=np.int64)[order], np.asarray(labels, dtype=np.int64)[order]
        toxic = self.labels.mean() if len(self.labels) else 0.0
        self.class_weight = np.where(self.labels == 1, share / toxic if toxic else 0, (1 - share) / (1 - toxic) if toxic < 1 else 0)
        empty = np.array([len(vectors[i][0]) == 0 for i in order], dtype=bool)
        total = self.class_weight[empty].sum()
        self.empty = float((self.class_weight * self.labels)[empty].sum() / total) if total else float(share)
        self.steps = (np.array([0.0]), np.array([0.0]))
        raw = [(self.vote(*self.index.nearest(*vectors[i], k, without=at)), at) for at, i in enumerate(order) if len(vectors[i][0])]
        if raw:
            self.steps = isotonic(np.array([r for r, _ in raw]), self.labels[[a for _, a in raw]], self.class_weight[[a for _, a in raw]])

    def vote(self, at: np.ndarray, sims: np.ndarray) -> float:
        w = self.class_weight[at] * sims**self.sharpness
        return float((w * self.labels[at]).sum() / w.sum()) if w.sum() else self.empty

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[dict]]:
        if not len(terms) or not len(self.ids):
            return self.empty, []
        at, sims = self.index.nearest(*weights(terms, counts, self.idf), self.k)
        score = float(np.interp(self.vote(at, sims), *self.steps))
        top = np.lexsort((self.ids[at], -sims))[:5]
        return score, [{"doc_id": int(self.ids[at[i]]), "similarity": float(sims[i]), "label": int(self.labels[at[i]])} for i in top]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots for linear interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted y, least x, most x
    for v, t, u in zip(x[order], y[order], w[order]):
        if pools and pools[-1][3] == v:
            pools[-1][0] += u
            pools[-1][1] += u * t
        else:
            pools.append([u, u * t, v, v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    knots = [(e, p[1] / p[0] if p[0] else 0.0) for p in pools for e in (p[2], p[3])]
    return np.array([k for k, _ in knots]), np.clip(np.array([v for _, v in knots]), 0, 1)


def _score(shared, text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordpieces.forget()
        vocabulary, model = shared.value
        vectorize, known = Vectorizer(vocabulary), {}
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column(text_at):
                terms, counts = vectorize(text.as_py())
                key = (tuple(terms), tuple(counts))
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = model.score(terms, counts)
                score, near = known[key]
                scores.append(score)
                evidence.append(near)
            added = [pa.array(scores, pa.float64()), pa.array(evidence, EVIDENCE)]
            yield pa.record_batch([*batch.columns, *added], names=[*batch.schema.names, "score", "evidence"])

    return run


def _significant(used: DataFrame, toxic: int, other: int, fdr: float) -> list[str]:
    """Terms whose use differs between the classes: G-tests with one degree of freedom and a step-up
    over all terms. Only terms below ``fdr`` come to the driver; no other can pass."""
    part = lambda seen, rate: f"if({seen} > 0, {seen} * ln({seen} / {rate}), 0D)"
    rate, rest = f"((t + c) / {toxic + other}D)", f"(1 - (t + c) / {toxic + other}D)"
    g = f"2 * ({part('t', f'({toxic} * {rate})')} + {part('c', f'({other} * {rate})')} + {part(f'({toxic} - t)', f'({toxic} * {rest})')} + {part(f'({other} - c)', f'({other} * {rest})')})"
    tested = cut(used.select("word", F.expr(g).alias("g")), "terms")
    m, z = tested.count(), NormalDist().inv_cdf(1 - fdr / 2)
    rows = sorted(tested.where(F.col("g") >= z * z).collect(), key=lambda r: (-r["g"], r["word"]))
    passed = [i for i, r in enumerate(rows) if math.erfc(math.sqrt(r["g"] / 2)) <= fdr * (i + 1) / m]
    return sorted(r["word"] for r in rows[: passed[-1] + 1]) if passed else []


def score(docs: DataFrame, corpus: DataFrame, labels: DataFrame, *, text_column: str = "text", examples: int = 4096, fdr: float = 0.001, k: int = 15, sharpness: float = 4.0) -> DataFrame:
    """docs with score and evidence for every row. ``labels`` (doc_id, label) names rows of
    ``corpus`` (doc_id, text); only rows whose fold ``learns`` are used."""
    spark = docs.sparkSession
    docs = docs.drop("score", "evidence")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1) & learns())
    share = usable.agg(F.avg("label")).first()[0] or 0.0
    part = lambda label: usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples // 2)
    # at most ``examples`` pairs of numbers
    chosen = F.broadcast(part(0).unionByName(part(1)))
    corpus = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = cut(corpus.join(chosen, "doc_id"), "examples")
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    used = texts.select("label", "text").mapInArrow(_term_rows, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    vocabulary = {w: i for i, w in enumerate(_significant(used, n.get(1, 0) or 1, n.get(0, 0) or 1, fdr))}
    counted = docs.select(text_column).mapInArrow(_document_counts(spark.sparkContext.broadcast(vocabulary)), "t int, n long")
    df_rows = counted.groupBy("t").agg(F.sum("n").alias("n")).collect()
    total = docs.count()
    idf = np.full(len(vocabulary), math.log(1 + total))
    for r in df_rows:
        idf[r["t"]] = math.log((1 + total) / (1 + r["n"])) + 1e-3
    vectors = texts.select("doc_id", "label", "text").mapInArrow(_example_vectors(spark.sparkContext.broadcast(vocabulary)), "doc_id long, label int, terms array<int>, counts array<int>")
    rows = sorted((tuple(r) for r in vectors.collect()), key=lambda r: (r[0], r[2], r[3]))
    model = Model([r[0] for r in rows], [r[1] for r in rows], [weights(r[2], r[3], idf) for r in rows], idf, float(share), k, sharpness)
    dropped(texts)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("evidence", EVIDENCE_TYPE)])
    return docs.mapInArrow(_score(spark.sparkContext.broadcast((vocabulary, model)), docs.columns.index(text_column)), schema)


def toxicity_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return score(docs, table(spark, sf_dir, "documents"), labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_of(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence",
    )
