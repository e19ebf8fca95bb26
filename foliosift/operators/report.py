"""Results by source: unique, complete and written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliosift.functions.text import listed, or_default
from foliosift.operators.assembly import pieces_of

FIRST = 10


def unique(results: DataFrame) -> DataFrame:
    """The first of each document in a source; rows of errors all stay."""
    key = F.when(F.col("error").isNull(), F.col("document_name"))
    first = Window.partitionBy("source", "document_name", F.col("error").isNull()).orderBy("pos")
    return results.withColumn("_n", F.row_number().over(first)).where((F.col("_n") == 1) | key.isNull()).drop("_n")


def complete(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Every planned source with its results' count, that of their different names and the first
    ``FIRST`` of these; none is 0 and an empty list. Of each source only so many names are gathered."""
    names = results.where("document_name IS NOT NULL").select("source", "document_name").distinct()
    first = names.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("document_name"))).where(F.col("_n") <= FIRST)
    listed_names = first.groupBy("source").agg(F.array_sort(F.collect_list("document_name")).alias("names"))
    per = results.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(names.groupBy("source").agg(F.count(F.lit(1)).alias("different")), "source", "left")
    out = plan.join(per, "source", "left").join(listed_names, "source", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "different")}).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def status(good: str = "good", bad: str = "bad") -> Column:
    g, b = F.col(good), F.col(bad)
    return (
        F.when((g == 0) & (b == 0), "No documents were found.").when(b == 0, F.concat(F.lit("Found information in "), g.cast("string"), F.lit(" document(s).")))
        .when(g == 0, F.concat(F.lit("All "), b.cast("string"), F.lit(" document(s) failed."))).otherwise(F.concat(g.cast("string"), F.lit(" document(s) answered, "), b.cast("string"), F.lit(" failed.")))
    )


def outcomes(results: DataFrame) -> DataFrame:
    return results.groupBy("source").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad")).withColumn("status", status())


def plan_text(names: Column, scope: Column) -> Column:
    verb = F.when(scope == "metadata", "Listing what is relevant in ").otherwise("Researching your question in ")
    return F.concat(verb, listed(names), F.lit("."))


def listing(plan: DataFrame, results: DataFrame) -> DataFrame:
    """One line per source, for a report of items found."""
    more = F.col("different") > F.size("names")
    found = F.concat(F.col("n").cast("string"), F.lit(" item(s): "), F.array_join("names", ", "), F.when(more, ", ...").otherwise(""))
    return complete(plan, unique(results)).select("source", "n", F.when(F.col("n") == 0, "no items").otherwise(found).alias("line"))


def usage_text(prompt: Column, completion: Column, cost: Column, seconds: Column) -> Column:
    return F.format_string("%d input and %d output tokens, $%.4f, %.2f s", prompt, completion, cost, seconds)


def answer_line() -> Column:
    return F.concat(F.lit("### "), "document_name", F.lit("\n"), or_default("answer", F.lit("No answer")))


def reports(results: DataFrame) -> DataFrame:
    """The answers of each source under their documents' names, for the few documents of a question."""
    return results.withColumn("_line", answer_line()).groupBy("source").agg(F.expr("listagg(_line, '\n\n') WITHIN GROUP (ORDER BY pos)").alias("report"))


def report_pieces(results: DataFrame) -> DataFrame:
    """reports for any number of answers, in pieces."""
    return pieces_of(results, ["source"], answer_line(), "pos", separator="\n\n", name="report")


def listed_names(names: list[str]) -> str:
    """The line of ``listing`` for the few items that a question chose."""
    different = sorted(set(names))
    return f"{len(names)} item(s): {', '.join(different[:FIRST])}{', ...' if len(different) > FIRST else ''}" if names else "no items"


def totals_line(listed_sources: DataFrame) -> DataFrame:
    """How many items were found, and in how many of the sources."""
    return listed_sources.agg(F.sum("n").alias("items"), F.count_if(F.col("n") > 0).alias("with_items"), F.count(F.lit(1)).alias("sources"))


def source_line(name: Column, scope: Column, n: Column, error: Column) -> Column:
    """A source's status when its query has ended."""
    return (
        F.when(error.isNotNull(), F.concat(name, F.lit(": failed ("), error, F.lit(")")))
        .when(n == 0, F.concat(name, F.lit(": nothing found")))
        .when(scope == "metadata", F.concat(name, F.lit(": "), n.cast("string"), F.lit(" item(s)")))
        .otherwise(F.concat(name, F.lit(": report of "), n.cast("string"), F.lit(" document(s)")))
    )


def summary_context(source_reports: DataFrame, plan: list[str] | None = None) -> DataFrame:
    """What a summary across sources is written from: a header, the numbered plan where there is
    one, and a block per source. One row per source of a question, so one text."""
    block = F.concat(F.lit("## "), F.coalesce("display_name", "source"), F.lit("\n"), or_default("report", F.lit("No report")))
    head = "# Research\n\n" + "".join(f"{i}. {p}\n" for i, p in enumerate(plan or [], 1)) + ("\n" if plan else "")
    return source_reports.withColumn("_block", block).agg(F.concat(F.lit(head), F.expr("coalesce(listagg(_block, '\n\n') WITHIN GROUP (ORDER BY source), '')")).alias("context"))


def monitor_summary(stages: DataFrame, by: str) -> DataFrame:
    """A run's stages in order, one line each: name, status and seconds."""
    line = F.concat("stage", F.lit(" ["), "status", F.lit("] "), F.format_string("%.2f", F.col("duration")), F.lit(" s"))
    return stages.withColumn("_line", line).groupBy(by).agg(F.count(F.lit(1)).alias("stages"), F.expr("listagg(_line, '\n') WITHIN GROUP (ORDER BY place)").alias("summary"))


def chunk_kind(chunk: Column) -> Column:
    """What a chunk of a mixed output is, by its literal prefix."""
    return F.when(chunk.startswith("DEBUG_DATA:"), "debug").when(chunk.startswith("MONITOR:"), "monitor").otherwise("answer")


def grid(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines of a table whose columns are as wide as their longest value."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    widths = rows.select(text).agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"_w_{c}") for c in columns])
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(f"_w_{c}"), F.lit(" ")) for c in columns]
    # the widths are one row
    return rows.join(F.broadcast(widths)).select(*columns, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
