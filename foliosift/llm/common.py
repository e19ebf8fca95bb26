"""What the training-data operators share: tables, and results cut off from their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliosift.packaged import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, as in tests, a temporary
    folder of a session that runs on this machine alone; a cluster's executors need a shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="foliosift-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Folders that ``cut`` wrote inside the innermost ``alone``, and the folder of each of its tables.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Files of a shuffle go as soon as the job that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _tidied(spark: SparkSession) -> None:
    """Plans of many jobs leave the driver's heap full of what nothing uses any more. A heap that has grown is given
    back by a full collection alone, which is asked for once it holds half of what it may."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: what follows
    doesn't repeat the work, and a lost executor costs only the tasks it ran."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/foliosift-{name}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _tidied(spark)
    made = _written.get()
    if made is not None:
        made.append(path)
    out = spark.read.schema(schema).parquet(path)
    _folders[out] = path
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*dfs: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing reads any more."""
    for df in dfs:
        if df in _folders:
            delete(df.sparkSession, [_folders.pop(df)])


def alone(build: Callable[[], DataFrame], name: str, before: DataFrame | None = None) -> DataFrame:
    """The result of build() as a table; the tables it wrote on its way are deleted, also where it
    fails, and so is ``before``, a table of ``cut`` that only build() read."""
    token, out = _written.set([]), None
    try:
        out = cut(build(), name)
    finally:
        made = [path for path in _written.get() if out is None or path != _folders[out]]
        _written.reset(token)
        if made:
            delete(SparkSession.active(), made)
    outer = _written.get()
    if outer is not None:
        outer.append(_folders[out])
    if before is not None:
        dropped(before)
    return out


def if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of short keys, to be broadcast while it has at most so many rows; beyond
    that it is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df
