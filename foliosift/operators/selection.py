"""Ranking documents and sections by the words of a question: the deterministic stand-in
for a model's choice, not its equal."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliosift.operators.assembly import KEY

MOST = 5


def scored(rows: DataFrame, question: str, text: str) -> DataFrame:
    """Rows with the number of the question's words they hold, where there is one."""
    wanted = sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in question.lower()).split()})
    # the intersection is distinct already, and null for no text
    words = F.split(F.lower(F.col(text)), "[^a-z0-9]+")
    score = F.size(F.array_intersect(F.array(*map(F.lit, wanted)), words)) if wanted else F.lit(0)
    return rows.withColumn("score", score.cast("long")).where("score > 0")


def top(rows: DataFrame, by: str | list[str], order: str, most: int = MOST) -> DataFrame:
    """The best rows of each group, ties by ``order``. Spark keeps the first few of each task
    before the shuffle, so a large source doesn't gather in one task."""
    within = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(order))
    return rows.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= most)


def select_documents(catalog: DataFrame, question: str, most: int = MOST) -> DataFrame:
    return top(scored(catalog, question, "document_description"), "document_source", "id", most).select("document_source", "id", "document_name", "score", F.col("rank").cast("long").alias("rank"))


def select_sections(sections: DataFrame, question: str, most: int = MOST) -> DataFrame:
    """Each document's best sections by their summaries; contents aren't read."""
    rows = scored(sections.select(*KEY, "section_id", "section_summary"), question, "section_summary")
    return top(rows, KEY, "section_id", most).select(*KEY, "section_id", "score", F.col("rank").cast("long").alias("rank"))


def plan_sources(statements: DataFrame, sources: list[dict], statement: str = "statement", most: int = MOST) -> DataFrame:
    """For each statement the registered sources that share most words with it, internal ones first
    among equals. The registry is a literal of a handful of entries in the plan."""
    words = lambda s: sorted({w for k in ("display_name", "description", "content_type", "use_when") for w in re.findall("[a-z0-9]+", (s.get(k) or "").lower())})
    known = F.array(*[F.struct(F.lit(s["key"]).alias("key"), F.lit(int(s["key"].startswith("external_"))).alias("tier"), F.array(*map(F.lit, words(s))).alias("words")) for s in sources])
    asked = F.split(F.lower(F.coalesce(F.col(statement), F.lit(""))), "[^a-z0-9]+")
    ranked = F.transform(known, lambda s: F.struct((-F.size(F.array_intersect(s["words"], asked))).alias("less"), s["tier"].alias("tier"), s["key"].alias("key")))
    best = F.slice(F.array_sort(ranked), 1, most)
    return statements.select("*", F.posexplode(best).alias("_at", "_s")).select(*statements.columns, (F.col("_at") + 1).cast("long").alias("rank"), F.col("_s.key").alias("source"), (-F.col("_s.less")).cast("long").alias("score"))


def selected(catalog: DataFrame, chosen: DataFrame) -> DataFrame:
    """Catalog rows among the chosen ids, in the catalog's order; other ids are ignored."""
    return catalog.join(chosen.select("id").distinct(), "id", "left_semi").orderBy(F.col("document_name").asc_nulls_last(), "id")
