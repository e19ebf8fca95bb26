"""Scans, filters and counts of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_source(catalog: DataFrame, source: str) -> DataFrame:
    """A source's catalog items by name; the source is compared in the scan."""
    return catalog.where(F.col("document_source") == source).select(F.col("id").cast("string").alias("id"), "document_name", "document_description").orderBy(F.col("document_name").asc_nulls_last())


def with_ids(rows: DataFrame, ids: DataFrame, column: str = "id", text: str = "id_text") -> DataFrame:
    """Rows whose id, written as text, is among ``ids``. Ids are read as numbers, so the filter
    is a typed semi-join; '0001' isn't how 1 is written and matches nothing."""
    typed = ids.select(F.col(text).alias("_text"), F.col(text).try_cast("long").alias("_id")).where("_id IS NOT NULL AND CAST(_id AS STRING) = _text")
    return rows.join(typed.select(F.col("_id").alias(column)).distinct(), column, "left_semi")


def id_like(rows: DataFrame, part: str, column: str = "id") -> DataFrame:
    return rows.where(F.col(column).cast("string").contains(part))


#: The columns of the wide scan.
WIDE = [
    "id", "document_source", "document_type", "document_name", "document_description", "document_usage", "date_created", "date_last_modified",
    "file_name", "file_size", "file_path",
]


def wide(catalog: DataFrame, source: str) -> DataFrame:
    return catalog.where(F.col("document_source") == source).select(*WIDE)


def of_source_and_type(catalog: DataFrame, source: str, kind: str) -> DataFrame:
    return catalog.where((F.col("document_source") == source) & (F.col("document_type") == kind))


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def sample(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """A reproducible random sample: the feature's n rows of least md5."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def share(rows: DataFrame, condition, name: str = "pct") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("n_true"), (F.count_if(condition) * F.lit(100.0) / F.count(F.lit(1))).alias(name))
