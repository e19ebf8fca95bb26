"""What model calls cost. Calls are rows; nothing is counted in a global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cost(prompt: str = "prompt_tokens", completion: str = "completion_tokens", per_prompt: str = "prompt_cost", per_completion: str = "completion_cost") -> Column:
    """Unit costs are per thousand tokens."""
    return F.col(prompt) / F.lit(1000.0) * F.col(per_prompt) + F.col(completion) / F.lit(1000.0) * F.col(per_completion)


def totals(calls: DataFrame, *by: str) -> DataFrame:
    sums = [F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.sum(cost()).alias("cost")]
    return calls.groupBy(*by).agg(*sums) if by else calls.agg(*sums)


def merged(stage_totals: DataFrame, query_totals: DataFrame) -> DataFrame:
    """Usage of single queries added to their stages'."""
    columns = ["stage", "prompt_tokens", "completion_tokens", "total_tokens", "cost"]
    both = stage_totals.select(columns).unionByName(query_totals.select(columns))
    return both.groupBy("stage").agg(*[F.sum(c).alias(c) for c in columns[1:]])
