"""Loading the store: whole tables in one job each, and JSON for whoever reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from foliosift.scratch import written

#: Rows, and bytes of text, of a range that rows are numbered in.
IN_RANGE, BYTES = 1_000_000, 1 << 26


def loaded(df: DataFrame, schema: StructType, *keys: str) -> DataFrame:
    """Rows for a table of the store: its columns in its order, numbered by the keys; what is missing is null."""
    return shaped(numbered(df.drop("id"), *keys), schema)


def shaped(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the schema's columns, in its order; what is missing is null."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def numbered(df: DataFrame, *keys: str, after: int = 0, name: str = "id") -> DataFrame:
    """Adds reproducible ids, by the keys. Rows are dealt by ranges of the keys, some ``IN_RANGE`` or
    ``BYTES`` in each at most, sorted there, and written with their place; a range's first id is the count of those before it. No
    window spans rows of all ranges, and ranges grow in number, not in size."""
    order = [F.col(k).asc_nulls_last() for k in keys]
    texts = [F.coalesce(F.octet_length(f"`{f.name}`").cast("long"), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))).first()
    parts = max(-(-rows // IN_RANGE), -(-size // BYTES), 1)
    place = F.monotonically_increasing_id()  # the partition, and the row in it
    rows = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", place), "numbered").withColumn("_part", F.shiftright("_at", 33).cast("int"))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    number = (F.lit(after + 1) + F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")
    return rows.join(F.broadcast(starts), "_part").withColumn(name, number).drop("_part", "_at", "_before")


def save(df: DataFrame, path: str, *, append: bool = False) -> int:
    """Writes a table and returns its count. Replacing goes through a folder of its own, moved
    into place when complete, so a failed load leaves the old table as it was."""
    spark: SparkSession = df.sparkSession
    if append:
        df.write.mode("append").parquet(path)
    else:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
        df.write.parquet(new)
        fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(fs_path(path)):
            fs.rename(fs_path(path), fs_path(old))
        if not fs.rename(fs_path(new), fs_path(path)):
            raise OSError(f"{new} can't be moved to {path}")
        fs.delete(fs_path(old), True)
    return spark.read.parquet(path).count()


def as_json(df: DataFrame, name: str = "json", keep: list[str] = ()) -> DataFrame:
    """Rows as JSON; ``keep`` stay columns of their own."""
    return df.select(*keep, F.to_json(F.struct(*[c for c in df.columns if c not in keep])).alias(name))
