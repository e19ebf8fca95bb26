"""Documents from their sections, and text from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliosift.functions.text import or_default, section_title

#: The whole logical key; a name alone may occur in several sources.
KEY = ["document_source", "document_type", "document_name"]


def joined(catalog: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per document and section; documents without sections have none."""
    return catalog.select("id", *KEY).join(sections, KEY)


def documents(catalog: DataFrame, sections: DataFrame, column: str = "section_content") -> DataFrame:
    """Each document with its sections in order, as an array of structs; with the summaries
    instead of the contents, nothing else is read."""
    rows = joined(catalog, sections.select(*KEY, "section_id", "section_name", column))
    entry = F.struct("section_id", section_title("section_name", "section_id").alias("section_name"), column)
    return rows.groupBy("id", *KEY).agg(F.array_sort(F.collect_list(entry)).alias("sections"))


def named(catalog: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections of the catalog's documents by name and source, whatever their type says."""
    return sections.join(catalog.select("document_name", "document_source"), ["document_name", "document_source"])


def content_of(sections: DataFrame, source: str, name: str | None = None) -> DataFrame:
    """A source's sections, or those of one of its documents; both are compared in the scan."""
    mine = sections.where(F.col("document_source") == source)
    return mine if name is None else mine.where(F.col("document_name") == name)


def chosen_sections(sections: DataFrame, choice: DataFrame) -> DataFrame:
    """Content of chosen sections. ``choice``: the key of a document and section_ids (array of
    strings); one id that isn't a number leaves its whole document out."""
    ids = choice.select(*KEY, F.transform("section_ids", lambda x: x.try_cast("int")).alias("ids")).where("NOT exists(ids, x -> x IS NULL)")
    return sections.join(ids.select(*KEY, F.explode("ids").alias("section_id")).distinct(), [*KEY, "section_id"], "left_semi")


def text_of(rows: DataFrame, by: list[str], line: Column, order: list[str], separator: str = "\n", name: str = "text") -> DataFrame:
    """Lines of each group put together in order."""
    keys = ", ".join(order)
    return rows.withColumn("_line", line).groupBy(*by).agg(F.expr(f"trim(BOTH '\n\t ' FROM listagg(_line, '{separator}') WITHIN GROUP (ORDER BY {keys}))").alias(name))


def pieces_of(rows: DataFrame, by: list[str], line: Column, number: str, size: int = 1000, separator: str = "\n", name: str = "text") -> DataFrame:
    """text_of for groups of any size: lines are put together by thousands of a number that no two
    rows of a group share, so no text grows with its group. Pieces in their order are the whole."""
    return text_of(rows.withColumn("piece", F.floor(F.col(number) / size).cast("long")), [*by, "piece"], line, [number], separator, name)


def catalog_line() -> Column:
    return F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\nname: "), "document_name", F.lit("\ndescription: "), or_default("document_description", F.lit("none")), F.lit("\n"))


def section_line() -> Column:
    return F.concat(F.lit("## "), section_title("section_name", "section_id"), F.lit("\n"), "section_content", F.lit("\n"))


def summary_line() -> Column:
    return F.concat(F.lit("["), F.col("section_id").cast("string"), F.lit("] "), or_default("section_name", F.lit("Main Section")), F.lit(": "), or_default("section_summary", F.lit("No summary available")))


def summary_texts(catalog: DataFrame, sections: DataFrame) -> DataFrame:
    """A document's sections by number, name and summary, for a choice among them."""
    return text_of(joined(catalog, sections.select(*KEY, "section_id", "section_name", "section_summary")), ["id", "document_name"], summary_line(), ["section_id"])


def document_text(catalog: DataFrame, sections: DataFrame, id: int) -> DataFrame:
    """One document by its id; the catalog is filtered before its sections are looked up."""
    return document_texts(catalog.where(F.col("id") == id), sections)


def document_texts(catalog: DataFrame, sections: DataFrame) -> DataFrame:
    """document_name and its text: a title, then each section under its own."""
    body = text_of(joined(catalog, sections), ["id", "document_name"], section_line(), ["section_id"])
    return body.select("id", "document_name", F.concat(F.lit("# "), "document_name", F.lit("\n\n"), "text", F.lit("\n\n---")).alias("text"))
