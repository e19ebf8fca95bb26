"""When stages ran: durations, categories, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliosift.functions.text import stage_parts

LAST_RANK = 999


def seconds(a: str, b: str) -> Column:
    return (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / F.lit(1e6)


def rolled_over(start: str, end: str) -> Column:
    """The end, a day later where it would come before the start."""
    return F.when(F.col(end) < F.col(start), F.col(end) + F.expr("INTERVAL 1 DAY")).otherwise(F.col(end))


def next_ends(events: DataFrame, by: str, ts: str, key: str, until: Column | None = None) -> DataFrame:
    """Each event ends when its group's next begins; the last ends at the group's end."""
    order = Window.partitionBy(by).orderBy(ts, key)
    end = F.coalesce(F.lead(ts).over(order), until if until is not None else F.max(ts).over(Window.partitionBy(by)))
    rows = events.withColumn("end_ts", end)
    return rows.withColumn("duration", F.greatest(F.lit(0.01), seconds(ts, "end_ts")))


def since_first(events: DataFrame, ts: str) -> DataFrame:
    """Seconds since the first event of all: one row, broadcast."""
    first = events.agg(F.min(ts).alias("first_ts"))
    return events.join(F.broadcast(first)).withColumn("since", seconds("first_ts", ts)).drop("first_ts")


def category(stage: str, prefix: str = "db_query_") -> Column:
    return F.when(F.col(stage).startswith(prefix), "database queries").otherwise(F.col(stage))


def by_category(stages: DataFrame, measures: list[str], setup: list[str]) -> DataFrame:
    kept = stages.where(~F.col("stage").isin(setup))
    return kept.groupBy(category("stage").alias("category")).agg(*[F.sum(m).alias(m) for m in measures])


def by_database(stages: DataFrame, measures: list[str], name: str | None = None) -> DataFrame:
    """Sums of queries by source; with ``name`` also its least value, where several are possible."""
    source, _ = stage_parts("stage")
    named = [F.min(name).alias(name)] if name else []
    return stages.where(F.col("stage").startswith("db_query_")).groupBy(source.alias("source")).agg(*named, *[F.sum(m).alias(m) for m in measures])


def labelled(stages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels: stage, label, place. What has none shows as itself, last. Spark broadcasts them by their size."""
    out = stages.join(labels, "stage", "left")
    return out.withColumn("label", F.coalesce("label", "stage")).withColumn("place", F.coalesce("place", F.lit(LAST_RANK)))


def elapsed(start: str, end: str, now: Column | None = None) -> Column:
    """Seconds until the end, or until now while there is none."""
    now = F.current_timestamp() if now is None else now
    return (F.unix_micros(F.coalesce(F.col(end), now)) - F.unix_micros(F.col(start))) / F.lit(1e6)


def by_label(stages: DataFrame, labels: DataFrame, measures: list[str]) -> DataFrame:
    """Sums by stage and label, with the label's place."""
    return labelled(stages.groupBy("stage").agg(*[F.sum(m).alias(m) for m in measures]), labels)


def extent(events: DataFrame, since: str = "since", duration: str = "duration") -> DataFrame:
    """Where the last stage ends on the axis; 1 where there is none."""
    return events.agg(F.coalesce(F.max(F.col(since) + F.col(duration)), F.lit(1.0)).alias("extent"))


def placed(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """Adds a row's place in its run; missing values come last."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*[F.col(c).asc_nulls_last() for c in order])).cast("long"))


def first_match(rows: DataFrame, condition: Column, *order: str) -> DataFrame:
    """The first row that meets a condition; the order has no ties."""
    return rows.where(condition).orderBy(*order).limit(1)


def holds_any(rows: DataFrame, by: str, condition: Column, name: str = "any") -> DataFrame:
    return rows.groupBy(by).agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias(name))


def parsed_iso(c: str) -> Column:
    """An instant from ISO text with an offset, in microseconds since 1970."""
    return F.unix_micros(F.try_to_timestamp(F.col(c)))


def debug_records(calls: DataFrame, by: str = "source") -> DataFrame:
    """One JSON record per run: its usage, and the uses of each stage. Stages are few."""
    per = calls.groupBy(by, "stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    decisions = F.array_sort(F.collect_list(F.struct("stage", "calls"))).alias("decisions")
    runs = per.groupBy(by).agg(F.sum("calls").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), decisions)
    return runs.select(by, F.concat(F.lit("DEBUG_DATA:"), F.to_json(F.struct("calls", "prompt_tokens", "completion_tokens", "decisions"))).alias("record"))


def latest_details(details: DataFrame) -> DataFrame:
    """details (stage, name, value, seq) with the last value of each name."""
    last = details.groupBy("stage", "name").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("details"))
