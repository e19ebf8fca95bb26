"""Tables that a plan is cut at: written once to the shared folder, read again, and deleted by their maker."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliosift.packaged import ship


#: Files of a shuffle go as soon as the job that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a session that runs on this machine alone may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(spark.sparkContext, "_foliosift_scratch"):
        spark.sparkContext._foliosift_scratch = tempfile.mkdtemp(prefix="foliosift-")
    return spark.sparkContext._foliosift_scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; what follows doesn't repeat its work."""
    spark = df.sparkSession
    ship(spark)
    path, schema, before = f"{folder(spark)}/foliosift-{name}-{uuid.uuid4().hex}", df.schema, spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._foliosift_path = path
    return out


def dropped(*dfs: DataFrame) -> None:
    """Deletes tables of ``written``."""
    for df in dfs:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._foliosift_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def kept(build: Callable[[], DataFrame], *inputs: DataFrame, name: str = "result") -> DataFrame:
    """build()'s rows as a table; ``inputs``, tables of ``written`` that only build() reads, are
    deleted then, and also when it fails."""
    try:
        return written(build(), name)
    finally:
        dropped(*inputs)
