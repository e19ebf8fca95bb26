"""The sources a question can go to. A key's prefix says whether it is internal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliosift import schemas

#: key, value of document_source, display name, description, query type, content type, when to use, implemented, two-phase.
DEFAULT = [
    ("internal_policy", "policy", "Policy handbook", "policies and accounting positions by section", "semantic search", "policies", "questions of rules and treatment", True, True),
    ("internal_wiki", "wiki", "Team wiki", "short articles and worked answers", "semantic search", "articles", "questions of practice and examples", True, False),
    ("internal_memo", "memo", "Memos", "memos on single transactions", "semantic search", "memos", "questions of precedent", True, False),
    ("internal_approvals", "approvals", "Project approvals", "approval guidance for projects", "semantic search", "guidance", "questions of approval and capital", True, False),
    ("internal_controls", "controls", "Controls", "internal control documents", "semantic search", "controls", "questions of control and risk", True, False),
    ("internal_sheets", "sheets", "Summary sheets", "one-page summaries", "keyword search", "summaries", "a short overview", False, False),
    ("external_standards", "standards", "Standards", "published standards", "semantic search", "standards", "wording of a standard", False, False),
    ("external_firm_a", "firm_a", "Firm guidance A", "guidance of a firm", "semantic search", "guidance", "interpretation of a standard", False, False),
    ("external_firm_b", "firm_b", "Firm guidance B", "guidance of a firm", "semantic search", "guidance", "interpretation of a standard", False, False),
    ("external_firm_c", "firm_c", "Firm guidance C", "guidance of a firm", "semantic search", "guidance", "interpretation of a standard", False, False),
]


def registry(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(DEFAULT if rows is None else rows, schemas.SOURCE)


def of_catalog(catalog: DataFrame, internal: list[str]) -> DataFrame:
    """A registry of the sources that a catalog has: what each holds is told from its counts. Those
    named ``internal`` come before the others; a null source isn't registered."""
    held = catalog.where("document_source IS NOT NULL").groupBy("document_source").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("document_type")).alias("kinds"))
    kinds = F.array_join("kinds", ", ")
    return held.select(
        F.concat(F.when(F.col("document_source").isin(internal), "internal_").otherwise("external_"), F.col("document_source")).alias("key"), F.col("document_source").alias("source_value"),
        F.concat(F.lit("Source "), "document_source").alias("display_name"), F.concat(F.col("n").cast("string"), F.lit(" documents: "), kinds).alias("description"), F.lit("ranked search").alias("query_type"),
        F.lit("documents").alias("content_type"), F.concat(F.lit("questions in "), kinds).alias("use_when"), F.lit(True).alias("implemented"), F.lit(True).alias("two_phase"),
    )


def tiers(reg: DataFrame) -> DataFrame:
    """Adds ``tier`` (internal or external) and ``tier_rank``; any other prefix is internal."""
    tier = F.when(F.col("key").startswith("external_"), "external").otherwise("internal")
    return reg.withColumn("tier", tier).withColumn("tier_rank", F.when(tier == "internal", 0).otherwise(1))


def statement(reg: DataFrame) -> DataFrame:
    """The registry as one text, internal sources first: for a planner's prompt."""
    entry = F.concat(
        F.lit('<source id="'), "key", F.lit('" name="'), "display_name", F.lit('">\n  '), F.coalesce("description", F.lit("")),
        F.lit("\n  Use when: "), F.coalesce("use_when", F.lit("")), F.lit("\n</source>"),
    )
    return tiers(reg).select("tier_rank", "key", entry.alias("entry")).agg(F.expr("listagg(entry, '\n') WITHIN GROUP (ORDER BY tier_rank, key)").alias("statement"))


def display_names(rows: DataFrame, reg: DataFrame, key: str = "source") -> DataFrame:
    """Adds display_name; a key that isn't registered shows as itself."""
    names = reg.select(F.col("key").alias("_key"), F.col("display_name").alias("_name"))
    return rows.join(names, F.col(key) == F.col("_key"), "left").withColumn("display_name", F.coalesce("_name", key)).drop("_key", "_name")
