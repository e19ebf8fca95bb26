"""A conversation's last messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES, LAST = ["user", "assistant"], 10


def recent(messages: DataFrame, last: int = LAST, with_system: bool = False) -> DataFrame:
    """Of each conversation the last messages in their order; roles are filtered first, and
    messages without role or content skipped."""
    roles = [*ROLES, "system"] if with_system else ROLES
    kept = messages.where(F.col("role").isin(roles) & F.col("content").isNotNull())
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return kept.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last).drop("_n")
