"""Language ID of web pages by fusing evidence.

Text: log-likelihoods of hashed byte trigrams, learned from at most ``per_language``
labelled documents of each language (the one bounded sample, in the order of a hash);
repeats within a page aren't independent, so at most ``most_evidence`` trigrams' worth
counts. Priors: the text's own posteriors are summed by host, by address suffix and
overall with grouped aggregation; each level is smoothed with the one above, and a
page's own share is taken out of its host's. A page without an address has no level but the
overall one, and a host without a suffix (a bare name) has none between. Declared language: a table of declared
against text language, counted over all pages. The posterior is the normalised product.

Defined results: a page with neither text nor address gets the overall prior, times what it
declares; a null html has no text and declares nothing; an unknown declared language is evidence of its
own kind; a null page_id stays null and its page counts like others; repeated rows are separate
pages, each with a result; ties between languages go to the first by name; texts of any length are
read whole; an empty table gives an empty result; with no labelled documents every page keeps its
host and declared language, and its languages and probability are null; only page_id, url and html, and
lang and text, are read, so no other name can clash. The tables written on the way are deleted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliosift.llm.common import alone, cut, table
from foliosift.packaged import ship

BITS = 15
HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
DECLARED = r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def trigrams(text: str) -> np.ndarray:
    b = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    whole = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
    return ((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text or ""), minlength=1 << BITS)
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at].astype(np.int64))], names=["lang", "gram", "n"])


def _likelihoods(model: np.ndarray, most_evidence: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html in batch.column("html"):
                grams = trigrams(HIDDEN.sub(" ", html.as_py() or ""))
                ll = model[:, grams].sum(axis=1) if len(grams) else np.zeros(len(model))
                ll = ll * min(1.0, most_evidence / max(1, len(grams)))
                p = np.exp(ll - ll.max())
                rows.append((ll.tolist(), (p / p.sum()).tolist()))
            doubles = pa.list_(pa.float64())
            yield pa.record_batch(
                [batch.column(i) for i in range(4)] + [pa.array([r[0] for r in rows], doubles), pa.array([r[1] for r in rows], doubles)],
                names=["page_id", "host", "suffix", "declared", "ll", "p"],
            )

    return run


def identify(pages: DataFrame, labelled: DataFrame, *, per_language: int = 1000, most_evidence: float = 60.0, smoothing: float = 5.0, broadcast_rows: int = 500_000) -> DataFrame:
    """page_id, host, declared, text_lang (by text alone), lang and probability."""
    ship(pages.sparkSession)
    return alone(lambda: _identified(pages, labelled, per_language, most_evidence, smoothing, broadcast_rows), "languages")


def _identified(pages: DataFrame, labelled: DataFrame, per_language: int, most_evidence: float, smoothing: float, broadcast_rows: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"))
    usable = labelled.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    # a hash threshold thins each language to about the bound before the exact cut
    n = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(n)
    keep = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * per_language / n[lang]))) for lang in langs]) if langs else F.lit(0.0)
    thin = usable.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < keep * 1_000_000)
    sample = thin.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("lang", "text")
    grams = sample.mapInArrow(_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    counts = np.full((max(1, len(langs)), 1 << BITS), 0.5)
    for r in grams:
        counts[langs.index(r["lang"]), r["gram"]] += r["n"]
    model = np.log(counts / counts.sum(axis=1, keepdims=True))
    size = len(langs)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    rows = pages.select("page_id", host.alias("host"), F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1).alias("suffix"), F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1)).alias("declared"), "html")
    if not size:
        return rows.select("page_id", "host", "declared", *[F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")], F.lit(None).cast("double").alias("probability"))
    text = cut(rows.mapInArrow(_likelihoods(model, most_evidence), "page_id long, host string, suffix string, declared string, ll array<double>, p array<double>"), "page-text")
    sums = F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(size)])
    total = text.agg(F.count(F.lit(1)).alias("n"), sums.alias("s")).first()
    base = [((total["s"][i] or 0.0) + 1.0) / (total["n"] + size) for i in range(size)]
    literal = "array(" + ", ".join(f"{b!r}D" for b in base) + ")"
    suffixes = text.where("suffix <> ''").groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), sums.alias("s"))
    suffixes = suffixes.select("suffix", F.expr(f"zip_with(s, {literal}, (x, b) -> (x + {smoothing} * b) / (n + {smoothing}))").alias("suffix_prior"))
    hosts = text.where("host <> ''").groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("hn"), sums.alias("hs")).join(suffixes, "suffix", "left")
    hosts = hosts.select("host", "hn", "hs", F.coalesce("suffix_prior", F.expr(literal)).alias("suffix_prior"))
    # one row per declared code, of which DECLARED allows 26^2 + 26^3
    seen = text.where("declared <> ''").groupBy("declared").agg(sums.alias("s"))
    of_all = seen.agg(F.count(F.lit(1)).alias("n_seen"), F.array(*[F.coalesce(F.sum(F.get("s", F.lit(i))), F.lit(0.0)) + 1.0 for i in range(size)]).alias("spread"))
    evidence = seen.crossJoin(of_all).select("declared", F.expr("zip_with(s, spread, (x, y) -> ln((x + 1 / (1 + n_seen)) / y))").alias("d"))
    if hosts.count() <= broadcast_rows:
        hosts = F.broadcast(hosts)
    fused = text.join(hosts, "host", "left").join(F.broadcast(evidence), "declared", "left").withColumn("d", F.coalesce("d", F.array(*[F.lit(0.0)] * size)))
    prior = f"if(hn IS NULL, {literal}[i], (greatest(0D, hs[i] - p[i]) + {smoothing} * suffix_prior[i]) / (hn - 1 + {smoothing}))"
    score = F.expr(f"transform(ll, (x, i) -> x + d[i] + ln({prior}))")
    fused = fused.withColumn("score", score).withColumn("top", F.array_max("score"))
    fused = fused.withColumn("probability", F.expr("1 / aggregate(score, 0D, (a, x) -> a + exp(x - top))"))
    names = F.array(*[F.lit(x) for x in langs])
    at = lambda values, most: F.get(names, (F.array_position(values, most) - 1).cast("int"))
    return fused.select("page_id", "host", "declared", at(F.col("p"), F.array_max("p")).alias("text_lang"), at(F.col("score"), F.col("top")).alias("lang"), "probability")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
