"""Reading the document store: Parquet or a database; and the shared tables seen as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION_CHARS = 1000


def open_store(spark: SparkSession, location: str, table: str, **options: str) -> DataFrame:
    """A table of the store: a folder of Parquet, or over JDBC where location is a jdbc: address.
    A store that can't be read raises, rather than looking empty."""
    if location.startswith("jdbc:"):
        return spark.read.format("jdbc").option("url", location).option("dbtable", table).options(**options).load()
    return spark.read.parquet(f"{location}/{table}.parquet")


def open_parallel(spark: SparkSession, url: str, table: str, key: str, partitions: int, *, where: str | None = None, **options: str) -> DataFrame:
    """A database's table in so many partitions of even size, by ranges of a whole-numbered key, spelled as
    the database does; rows without a key are in the first. ``where`` is a condition in the database's own SQL, which the counts respect too;
    filters on the result reach the database as well."""
    inside = f"({where})" if where else None
    cuts = key_bounds(spark, url, table, key, partitions, where=where, **options)
    ranges = [f"{key} IS NULL OR {key} < {cuts[0]}", *[f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])], f"{key} >= {cuts[-1]}"] if cuts else ["1 = 1"]
    return spark.read.jdbc(url, table, predicates=[f"({r}) AND {inside}" if inside else f"({r})" for r in ranges], properties=options)


#: Buckets that the database counts a range of keys in.
KEY_BUCKETS = 256


def key_bounds(spark: SparkSession, url: str, table: str, key: str, partitions: int, *, where: str | None = None, **options: str) -> list[int]:
    """Keys that cut the table into at most so many ranges of like counts. The database counts by buckets;
    a bucket that holds more than a range's share is counted anew in finer ones, until it is small or one key. Only
    counts come here, so skewed keys cost a few more queries and no reading."""
    condition = f" AND ({where})" if where else ""

    def ask(query: str) -> list[tuple]:
        return [tuple(r) for r in spark.read.jdbc(url, f"({query}) t", properties=options).collect()]

    low, high, total = ask(f"SELECT MIN({key}) AS a, MAX({key}) AS b, COUNT({key}) AS n FROM {table} WHERE {key} IS NOT NULL{condition}")[0]
    if not total or partitions < 2:
        return []
    share, counted, open_ = -(-total // partitions), [], [(int(low), int(high))]
    while open_:
        lo, hi = open_.pop()
        width = (hi - lo) // KEY_BUCKETS + 1
        buckets = ask(f"SELECT b, COUNT(*) AS n FROM (SELECT ({key} - {lo}) / {width} AS b FROM {table} WHERE {key} >= {lo} AND {key} <= {hi}{condition}) x GROUP BY b")
        for b, n in buckets:
            start = lo + int(b) * width
            if n > share and width > 1:
                open_.append((start, min(hi, start + width - 1)))
            else:
                counted.append((start, n))
    cuts, held = [], 0
    for start, n in sorted(counted):
        if held and held + n > share and len(cuts) < partitions - 1:
            cuts.append(start)
            held = 0
        held += n
    return cuts


def existing(spark: SparkSession, names: list[str]) -> list[str]:
    """Those of the names that are tables or views of the session's catalog."""
    return [n for n in names if spark.catalog.tableExists(n)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a catalog: one row per document, described by its text."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("document_source"), F.col("lang").alias("document_type"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_name"), F.nullif("text", F.lit("")).alias("document_description"), "n_chars",
    )


def wide_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a catalog with what is known of their files."""
    docs = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), (F.col("doc_id") % n).cast("int")).cast("timestamp")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("document_source"), F.col("lang").alias("document_type"), name.alias("document_name"),
        F.nullif("text", F.lit("")).alias("document_description"), F.lit("reference").alias("document_usage"), day("2024-01-01", 300).alias("date_created"),
        day("2024-06-01", 100).alias("date_last_modified"), F.concat(name, F.lit(".txt")).alias("file_name"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("file_size"), F.concat(F.lit("/"), "source", F.lit("/"), name, F.lit(".txt")).alias("file_path"),
    )


def sql(spark: SparkSession, statement: str, **frames: DataFrame) -> DataFrame:
    """A statement over tables named in braces, as {sections}."""
    return spark.sql(statement, **frames)


def sections(spark: SparkSession, sf_dir: str, chars: int = SECTION_CHARS) -> DataFrame:
    """documents in sections of so many characters; the first has no name."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pos = F.explode(F.sequence(F.lit(0), F.expr(f"greatest(CAST((length(text) - 1) div {chars} AS INT), 0)")))
    rows = docs.select("*", pos.alias("section_id"))
    return rows.select(
        F.col("source").alias("document_source"), F.col("lang").alias("document_type"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_name"), "section_id",
        F.when(F.col("section_id") > 0, F.concat(F.lit("Part "), F.col("section_id").cast("string"))).alias("section_name"),
        F.expr(f"nullif(left(substr(text, section_id * {chars} + 1, {chars}), 80), '')").alias("section_summary"),
        F.expr(f"substr(text, section_id * {chars} + 1, {chars})").alias("section_content"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as model calls: the type is the stage, the user the source."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), F.col("event_type").alias("stage"), F.concat(F.lit("src_"), (F.col("user_id") % 11).cast("string")).alias("source"), "ts", "value",
        (F.col("event_id") % 997).alias("prompt_tokens"), (F.col("event_id") % 331).alias("completion_tokens"),
        F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(0.5).alias("prompt_cost"), F.lit(1.5).alias("completion_cost"), (F.col("event_id") % 13 != 0).alias("ok"), "props",
    )


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as what a monitor is told: the user is the run, a fifth of props.k the stage; a signup starts it,
    purchases and errors end it, views tell details, clicks use tokens."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run"), F.concat(F.lit("stage_"), (k % 5).cast("string")).alias("stage"), "event_id",
        F.when(kind == "signup", "start").when(kind.isin("purchase", "error"), "end").when(kind == "view", "detail").otherwise("tokens").alias("kind"), "ts",
        F.when(kind == "purchase", "done").when(kind == "error", "failed").alias("status"), F.when(kind == "view", F.concat(F.lit("k"), (k % 3).cast("string"))).alias("name"),
        F.when(kind == "view", k.cast("string")).alias("value"), F.when(kind == "click", k).alias("tokens"),
    )
