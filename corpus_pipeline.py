"""The corpus pipeline: STAGES over documents, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a
benchmark item go, secrets are masked, and what is left is packed into sequences of 2048
tokens. ``run`` deletes a stage's input and whatever the stage wrote on its way once its own
result is written.

Defined results. Null, empty and blank texts stay in every stage but where a score says
otherwise (a text without evidence has the score of such examples). Rows without an id are
scored, searched for benchmark items and masked like any other, but are nobody's near
duplicate, so they stay there. Rows that share an id are versions of one document to the
n-gram Jaccard join: one of them stays, the one whose text has the least SHA-256; every
other stage judges each row by its own text. Equal rows are copies. Other columns of the
input than those of documents are left out after the first stage. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliosift.llm.common import alone, cut, if_small, table
from foliosift.llm.decontaminate import overlaps
from foliosift.llm.nearset import near_duplicates
from foliosift.llm.packing import pack, tokenizer_path
from foliosift.llm.secrets import redact
from foliosift.llm.toxicity import toxicity_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go."""
    return toxicity_of(spark, docs.select(COLUMNS), sf_dir).where("score < 0.3").select(COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the least id stays; rows without an id stay."""
    docs = docs.select(COLUMNS)
    found = near_duplicates(docs)
    gone = cut(found.where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    kept = docs.join(if_small(gone), "doc_id", "left_anti").select(COLUMNS)
    # found has a row for each row of docs
    repeated = cut(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), "lang", "source", "n_chars")
    versions = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS), order).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(COLUMNS).unionByName(versions.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Texts are known by their digests, so that rows
    without an id are judged as well."""
    docs, digest = docs.select(COLUMNS), F.unhex(F.sha2("text", 256))
    texts = docs.where("text IS NOT NULL").select(digest.alias("digest"), "text")
    found = overlaps(texts, table(spark, sf_dir, "benchmark"), id_column="digest").select(F.col("doc_id").alias("_digest")).distinct()
    return docs.join(if_small(cut(found, "contaminated")), digest == F.col("_digest"), "left_anti").select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    return redact(docs.select(COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: one row per piece of a sequence, with its ids."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", packing),
]

#: The tokenizer's ids can't be had in SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
