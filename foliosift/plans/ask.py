"""A question from beginning to end. Sources are queried at the same time, one plan each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliosift.operators import assembly, report, search, selection, sources, summary
from foliosift.packaged import ship
from foliosift.plans import decisions as d
from foliosift.plans.dispatch import as_they_end
from foliosift.plans.monitor import Monitor

NOT_BUILT = "This source isn't available yet."


def normalised(conversation, last: int = 10, with_system: bool = False) -> list[dict]:
    """A list of messages, or an object with one; filtered by role, then cut to the last."""
    messages = conversation.get("messages", []) if isinstance(conversation, dict) else conversation
    roles = {"user", "assistant"} | ({"system"} if with_system else set())
    return [{"role": m["role"], "content": m["content"]} for m in messages if m.get("role") in roles and m.get("content") is not None][-last:]


RESULTS = "source string, document_name string, pos long, answer string, ok boolean, error string"


def extract(question: str, rows: DataFrame) -> DataFrame:
    """The stand-in for a synthesis: the chosen sections themselves, as they are."""
    return rows.select("source", "document_name", "pos", F.col("content").alias("answer"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))


def each_document(answer: Callable[[str, str, str], str]) -> Callable[[str, DataFrame], DataFrame]:
    """A synthesis from ``answer(question, document name, content)``, called in tasks for one document
    after another. A failure is that document's error row."""

    def synthesise(question: str, rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    try:
                        out.append((r.source, r.document_name, r.pos, answer(question, r.document_name, r.content), True, None))
                    except Exception as e:
                        out.append((r.source, r.document_name, r.pos, None, False, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["source", "document_name", "pos", "answer", "ok", "error"])

        return rows.select("source", "document_name", "pos", "content").mapInPandas(run, RESULTS)

    return synthesise


def summarised(question: str, rows: DataFrame) -> DataFrame:
    """A synthesis without a model: of each document the sentences that stand for its chosen sections and
    for the question, in their order."""
    cut = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda s: F.transform(summary.sentences(s["content"]), lambda t: F.struct(s["pos"].alias("pos"), t.alias("sentence"))))
    whole = rows.groupBy("source", "document_name").agg(F.min("pos").alias("pos"), F.flatten(cut).alias("sentences"))
    found = summary.summarise(whole, ["source", "document_name", "pos"], asked=F.array_distinct(search.terms(F.lit(question))))
    answer = F.array_join(F.transform("summary", lambda s: s["s"]["sentence"]), " ")
    return found.select("source", "document_name", "pos", answer.alias("answer"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))


def digest(spark: SparkSession, budget: int = summary.BUDGET) -> Callable[[str], Iterator[str]]:
    """What ``ask(summarise=...)`` takes: a summary of the sources' reports, sentence by sentence."""

    def summarise(context: str) -> Iterator[str]:
        ship(spark)
        text = spark.createDataFrame([(0, context)], "id long, context string").select("id", F.transform(summary.sentences(F.col("context")), lambda t: F.struct(t.alias("sentence"))).alias("sentences"))
        for row in summary.summarise(text.withColumn("sentences", F.filter("sentences", lambda s: ~s["sentence"].startswith("#"))), ["id"], budget=budget).collect():
            yield from (f"{s['s']['sentence']}\n" for s in row["summary"])

    return summarise


def planner_of(spark: SparkSession, index: DataFrame) -> Callable[[str, list[dict]], list[str]]:
    """A planner that goes by what the sources hold: the registered ones among those with most belief."""

    def plan(question: str, known: list[dict]) -> list[str]:
        key_of = {s["source_value"]: s["key"] for s in known}
        asked = spark.createDataFrame([(0, question)], "question long, text string")
        found = sources.choose(index.where(F.col("source").isin(list(key_of))), asked).orderBy("rank").collect()  # MOST rows
        return [key_of[r["document_source"]] for r in found]

    return plan


def chosen(catalog: DataFrame, question: str, index: DataFrame | None = None) -> DataFrame:
    """The ids of the documents to read, of one source's catalog: by its index, where there is one."""
    if index is None:
        return selection.select_documents(catalog, question).select("id")
    asked = catalog.sparkSession.createDataFrame([(0, question)], "question long, text string")
    return search.search(index, asked).select("id")


def metadata(catalog: DataFrame, question: str, index: DataFrame | None = None) -> DataFrame:
    return selection.selected(catalog, chosen(catalog, question, index))


def research(catalog: DataFrame, sections: DataFrame, question: str, synthesise: Callable = extract, per_document: int = selection.MOST, index: DataFrame | None = None) -> DataFrame:
    """Documents, then their sections by summary, then the contents of the chosen sections only. A
    document none of whose summaries shares a word with the question gives its first section. Rows are
    numbered in order; they are ``per_document`` sections of ``MOST`` documents at most."""
    mine = catalog.join(chosen(catalog, question, index), "id").select("id", *assembly.KEY)
    summaries = sections.select(*assembly.KEY, "section_id", "section_summary").join(mine, assembly.KEY)
    best = selection.select_sections(summaries, question, per_document).select(*assembly.KEY, "section_id")
    rest = mine.join(best.select(*assembly.KEY).distinct(), assembly.KEY, "left_anti")
    first = summaries.join(rest.select("id"), "id", "left_semi").groupBy(*assembly.KEY).agg(F.min("section_id").alias("section_id"))
    rows = sections.join(best.unionByName(first), [*assembly.KEY, "section_id"], "left_semi").join(mine, assembly.KEY)
    rows = rows.select(F.col("document_source").alias("source"), "document_name", F.row_number().over(Window.orderBy("id", "section_id")).cast("long").alias("pos"), F.col("section_content").alias("content"))
    return synthesise(question, rows)


def ask(
    spark: SparkSession, conversation, catalog: DataFrame, sections: DataFrame, registered: DataFrame, *, router: d.Router = d.route,
    clarifier: d.Clarifier = d.clarify, planner: d.Planner = d.plan, answer: Callable[[list[dict]], Iterator[str]] | None = None,
    synthesise: Callable = extract, summarise: Callable[[str], Iterator[str]] | None = None, monitor: Monitor | None = None, index: DataFrame | None = None,
) -> Iterator[str]:
    """Yields the answer in chunks: a plan, a line per source as its query ends, then a listing, or
    the reports, or with ``summarise`` what it makes of their context. A source that fails has its
    line and an error in place of its report, and the others go on. With an ``index`` of the catalog
    (``search.index``) documents are ranked by it, and no description is read for the question."""
    ship(spark)  # before the sources' threads start
    monitor = monitor or Monitor(enabled=False)
    messages = normalised(conversation)
    with monitor.stage("route"):
        where = router(messages)
    if where not in (d.DIRECT, d.RESEARCH):
        raise d.DecisionError(f"unknown route {where}")
    if where == d.DIRECT:
        yield from answer(messages) if answer else ["How can I help?"]
        return
    with monitor.stage("clarify"):
        need = clarifier(messages).checked()
    if need.action == d.ASK:
        yield need.output
        return
    known = [r.asDict() for r in registered.collect()]  # the registry, a handful of rows
    with monitor.stage("plan"):
        keys = d.checked_plan(planner(need.output, known), known)
    by_key = {s["key"]: s for s in known}
    name = {k: by_key[k]["display_name"] for k in keys}
    yield f"{'Listing' if need.scope == d.METADATA else 'Researching'} in {', '.join(name.values())}.\n"

    def job(key: str) -> Callable:
        own = lambda df: df.where(F.col("document_source") == by_key[key]["source_value"])

        def run() -> list:
            with monitor.stage(f"db_query_{key}_0", scope=need.scope):
                its = None if index is None else index.where(F.col("source") == by_key[key]["source_value"])
                found = metadata(own(catalog), need.output, its) if need.scope == d.METADATA else research(own(catalog), own(sections), need.output, synthesise, index=its)
                return found.collect()  # at most MOST documents of a source

        return run

    ended: dict[str, tuple[list, str | None]] = {}
    for key, rows, error in as_they_end({k: job(k) for k in keys if by_key[k]["implemented"]}):
        ended[key] = (rows or [], error)
        counted = f"{len(rows)} item(s)" if rows and need.scope == d.METADATA else f"{len({r['document_name'] for r in rows})} document(s)" if rows else "nothing found"
        yield f"{name[key]}: {f'failed ({error})' if error else counted}\n"
    for k in keys:
        if not by_key[k]["implemented"]:
            yield f"{name[k]}: {NOT_BUILT if need.scope == d.FULL else 'no items'}\n"
    reports = []
    for key, (rows, error) in sorted(ended.items(), key=lambda e: keys.index(e[0])):
        if error:
            body = f"This source failed: {error}"
        elif need.scope == d.METADATA:
            body = report.listed_names([r["document_name"] for r in rows])
        else:
            told = [f"### {r['document_name']}\n{r['answer'] or 'No answer' if r['ok'] else 'Failed: ' + r['error']}" for r in sorted(rows, key=lambda r: r["pos"])]
            body = "\n\n".join(told) or "No documents were found."
        reports.append((key, name[key], body))
    if summarise and need.scope == d.FULL:
        with monitor.stage("summarise"):
            table = spark.createDataFrame(reports, "source string, display_name string, report string")
            yield from summarise(report.summary_context(table, [name[k] for k in keys]).first()["context"])
        return
    for _, display, body in reports:
        yield f"{display}: {body}\n" if need.scope == d.METADATA else f"## {display}\n{body}\n"


def answered(*args, **kwargs) -> Iterator[str]:
    """ask, for a caller that wants text whatever happens: an error ends it with a line that names it."""
    try:
        yield from ask(*args, **kwargs)
    except Exception as e:
        yield f"\nThe question can't be answered: {type(e).__name__}: {e}\n"
