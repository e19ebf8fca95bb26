import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliosift.functions import fiscal, replies, text
from foliosift.operators import assembly, catalog, profile, report, selection, stages
from foliosift.plans import decisions as d
from foliosift.plans.ask import answered, ask, each_document, extract
from foliosift.plans.models import Adapter, ModelConfig
from foliosift.plans.monitor import Monitor
from foliosift.plans.prompts import prompt
from foliosift.sources import registry, sinks, tables
from foliosift.streaming.events import usage_by_window

SECTION = "document_source string, document_type string, document_name string, section_id int, section_name string, section_summary string, section_content string"
CATALOG = "id long, document_source string, document_type string, document_name string, document_description string"


@pytest.mark.parametrize("reply, fallback, expected", [
    ('["1","2"]', replies.DIGITS, ["1", "2"]), ("[1,2]", replies.DIGITS, []), ('["1",2]', replies.DIGITS, []), ("[]", replies.DIGITS, []), ('{"a":1}', replies.DIGITS, []),
    ('ids: "12" and "x"', replies.DIGITS, ["12"]), ('ids: "12" and "x"', replies.ANY, ["12", "x"]), ("ids: 'a' \"b\"", replies.QUOTES, ["a", "b"]), ("junk", replies.DIGITS, []), (None, replies.DIGITS, []),
])
def test_id_list(reply, fallback, expected):
    assert replies.id_list(reply, fallback) == expected


def test_id_list_column_agrees(spark):
    cases = ['["1","2"]', "[1,2]", "[]", '{"a":1}', 'ids: "12" and "x"', "junk", '["1"] "7"']
    rows = spark.createDataFrame([(c,) for c in cases], "r string").select("r", replies.id_list_column(F.col("r")).alias("ids")).collect()
    assert {r["r"]: r["ids"] for r in rows} == {c: replies.id_list(c) if c != '["1"] "7"' else ["1", "7"] for c in cases}


def test_section_choice():
    assert replies.section_choice('Here: {"d": ["0", "2"]} ok') == {"d": ["0", "2"]}
    assert replies.section_choice('{"d": [1]}') == replies.section_choice('{"d": "1"}') == replies.section_choice("none") == {}
    with pytest.raises(ValueError):
        replies.arguments('{"a": 1}', {"a": str})


def test_october_is_in_the_fourth_quarter(spark):
    days = [(dt.date(2023, 10, 31),), (dt.date(2023, 11, 1),), (dt.date(2024, 1, 31),), (dt.date(2024, 2, 29),)]
    got = spark.createDataFrame(days, "d date").select(fiscal.year(F.col("d")), fiscal.quarter(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(2023, 4), (2024, 1), (2024, 1), (2024, 2)]
    one = spark.range(1).select(fiscal.quarter_start(F.lit(2024), F.lit(2)), fiscal.quarter_end(F.lit(2024), F.lit(2)), fiscal.quarter_label(F.lit(0))).first()
    assert tuple(one) == (dt.date(2024, 2, 1), dt.date(2024, 4, 30), "Invalid quarter")


def test_text(spark):
    names = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "n array<string>").select(text.listed("n")).collect()
    assert [r[0] for r in names] == ["", "a", "a and b", "a, b, and c"]
    parts = spark.createDataFrame([("db_query_internal_policy_0",)], "s string").select(*text.stage_parts("s")).first()
    assert tuple(parts) == ("internal_policy", 0)


def test_assembly_orders_names_and_keeps_sources_apart(spark):
    cat = spark.createDataFrame([(1, "a", "t", "same", ""), (2, "b", "t", "same", None), (3, "a", "t", "bare", "x")], CATALOG)
    sec = spark.createDataFrame([("a", "t", "same", 1, "", None, "two"), ("a", "t", "same", 0, None, None, "one"), ("b", "t", "same", 0, "B", None, "b")], SECTION)
    got = {r["id"]: [tuple(s) for s in r["sections"]] for r in assembly.documents(cat, sec).collect()}
    assert got == {1: [(0, "Section 0", "one"), (1, "Section 1", "two")], 2: [(0, "B", "b")]}
    texts = {r["id"]: r["text"] for r in assembly.document_texts(cat, sec).collect()}
    assert texts[1] == "# same\n\n## Section 0\none\n\n## Section 1\ntwo\n\n---"
    choice = lambda *ids: spark.createDataFrame([("a", "t", "same", list(ids))], "document_source string, document_type string, document_name string, section_ids array<string>")
    assert assembly.chosen_sections(sec, choice("0", "x")).count() == 0
    assert [r["section_content"] for r in assembly.chosen_sections(sec, choice("0")).collect()] == ["one"]


def test_ids_are_compared_as_written(spark):
    cat = spark.createDataFrame([(1, "a", "t", "n", "")], CATALOG)
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id_text string")
    assert catalog.with_ids(cat, ids("1", "zz")).count() == 1
    assert catalog.with_ids(cat, ids("0001", "1.0", " 1")).count() == 0


def test_unique_and_complete(spark):
    results = spark.createDataFrame([("s", 1, "x", None, True), ("s", 2, "x", None, True), ("s", 3, "x", "bad", False), ("s", 4, "x", "bad", False)], "source string, pos long, document_name string, error string, ok boolean")
    assert sorted(r["pos"] for r in report.unique(results).collect()) == [1, 3, 4]
    plan = spark.createDataFrame([("s",), ("t",)], "source string")
    assert {r["source"]: r["n"] for r in report.complete(plan, results).collect()} == {"s": 4, "t": 0}
    assert {r["source"]: r["line"] for r in report.listing(plan, results).collect()}["t"] == "no items"


def test_middle_needs_ten_rows(spark):
    few = spark.range(9).select("id", F.col("id").alias("tokens"))
    assert tuple(profile.middle_and_bottom(few).first()) == (None, None)
    many = spark.range(20).select("id", F.col("id").alias("tokens"))
    assert tuple(profile.middle_and_bottom(many).first()) == (sum(range(5, 15)), sum(range(10)))


def test_rollover_and_labels(spark):
    rows = spark.sql("SELECT TIMESTAMP '2024-01-01 23:59:00' a, TIMESTAMP '2024-01-01 00:01:00' b").withColumn("e", stages.rolled_over("a", "b")).select(stages.seconds("a", "e")).first()
    assert rows[0] == 120.0


def test_store_over_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/store;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, document_name string")
    rows.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "catalog").save()
    got = tables.open_store(spark, url, "catalog", driver=driver)
    assert sorted(tuple(r) for r in got.where("ID = 1").collect()) == [(1, "a")] and got.count() == 2
    rows.write.parquet(f"{tmp_path}/sections.parquet")
    assert tables.open_store(spark, str(tmp_path), "sections").count() == 2
    rows.createOrReplaceTempView("seen_here")
    assert tables.existing(spark, ["seen_here", "not_here"]) == ["seen_here"]


def test_parallel_reads_of_a_database(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/store;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    keys = [*range(1, 301), *[10**9 + i * i for i in range(300)], *[5] * 40, None, None]
    rows = spark.createDataFrame([(k, "ab"[i % 2], i) for i, k in enumerate(keys)], "id long, document_source string, n long")
    rows.write.format("jdbc").option("url", url).option("dbtable", "catalog").option("createTableColumnTypes", "document_source VARCHAR(20)").options(**options).save()
    got = tables.open_parallel(spark, url, "catalog", '"id"', 8, **options)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert sorted(r["N"] for r in got.select(F.col("n").alias("N")).collect()) == list(range(len(keys)))
    assert 6 <= got.rdd.getNumPartitions() <= 8 and sum(sizes) == len(keys) and max(sizes) <= 2 * len(keys) / 8
    mine = got.where(F.col("document_source") == "a")
    plan = mine._jdf.queryExecution().executedPlan().toString().lower()
    assert "pushedfilters" in plan and "equalto(document_source,a)" in plan and mine.count() == len(keys) // 2
    own = tables.open_parallel(spark, url, "catalog", '"id"', 4, where="\"document_source\" = 'b'", **options)
    assert own.count() == len(keys) // 2 and 3 <= own.rdd.getNumPartitions() <= 4
    assert tables.open_parallel(spark, url, "catalog", '"id"', 4, where="\"document_source\" = 'none'", **options).count() == 0


def test_numbering_and_saving(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    assert {r["k"]: r["id"] for r in sinks.numbered(df, "k").collect()} == {"a": 1, "b": 2, "c": 3, None: 4}
    path = str(tmp_path / "t")
    assert sinks.save(df, path) == 4 and sinks.save(df, path) == 4 and sinks.save(df, path, append=True) == 8


def test_decisions():
    user = lambda *t: [{"role": "user", "content": x} for x in t]
    assert d.route(user("hello there")) == d.DIRECT and d.route(user("what is the policy on leases")) == d.RESEARCH
    assert d.clarify(user("leases")).action == d.ASK
    assert d.clarify(user("list documents on leases")).scope == d.METADATA and d.clarify(user("explain leases", "proceed")).is_continuation
    sources = [{"key": "internal_a", "description": "leases"}, {"key": "external_b", "description": "leases"}]
    assert d.plan("leases", sources) == ["internal_a", "external_b"]
    for bad in ([], ["nope"]):
        with pytest.raises(d.DecisionError):
            d.checked_plan(bad, sources)


def test_ask_lists_and_researches(spark):
    cat = spark.createDataFrame([(1, "policy", "t", "Leases", "how leases are treated"), (2, "wiki", "t", "Other", "nothing")], CATALOG)
    sec = spark.createDataFrame([("policy", "t", "Leases", 0, None, None, "leases are treated so"), ("wiki", "t", "Other", 0, None, None, "nothing")], SECTION)
    reg, monitor = registry.registry(spark), Monitor()
    listed = "".join(ask(spark, [{"role": "user", "content": "list documents on leases"}], cat, sec, reg, monitor=monitor))
    assert "1 item(s): Leases" in listed and "no items" in listed
    told = "".join(ask(spark, {"messages": [{"role": "user", "content": "explain how leases are treated"}]}, cat, sec, reg))
    assert "leases are treated so" in told and "No documents were found." in told
    rows = monitor.table(spark).collect()
    assert {r["status"] for r in rows} == {"done"} and {r["stage"] for r in rows} > {"route", "clarify", "plan", "db_query_internal_policy_0"}


def test_a_failed_source_leaves_the_others(spark):
    cat = spark.createDataFrame([(1, "policy", "t", "Leases", "leases"), (2, "wiki", "t", "Notes", "leases too")], CATALOG)
    sec = spark.createDataFrame([("policy", "t", "Leases", 0, None, "of leases", "long text"), ("wiki", "t", "Notes", 0, None, None, "short")], SECTION)
    reg, question = registry.registry(spark), [{"role": "user", "content": "explain how leases work"}]

    both = lambda *_: ["internal_policy", "internal_wiki"]

    def broken(_, rows):
        if rows.where("source = 'wiki'").count():
            raise OSError("no connection")
        return extract(_, rows)

    told = list(ask(spark, question, cat, sec, reg, planner=both, synthesise=broken))
    assert any(c.startswith("Team wiki: failed (OSError: no connection)") for c in told) and "long text" in "".join(told) and "This source failed" in "".join(told)
    per = "".join(ask(spark, question, cat, sec, reg, planner=both, synthesise=each_document(lambda q, name, text: f"{name} {len(text)}" if name == "Leases" else 1 / 0)))
    assert "### Leases\nLeases 9" in per and "### Notes\nFailed: ZeroDivisionError" in per
    seen = []
    chunks = list(ask(spark, question, cat, sec, reg, planner=both, summarise=lambda context: seen.append(context) or iter(["in", " short"])))
    assert chunks[-2:] == ["in", " short"] and seen[0].startswith("# Research\n\n1. ") and "long text" in seen[0]
    assert "can't be answered: DecisionError" in "".join(answered(spark, question, cat, sec, reg, planner=lambda *_: d.checked_plan([], [])))


def test_prompts():
    assert prompt("plan", "c", sources="s", empty="").split("\n\n")[:2] == ["<context>\nc\n</context>", "<sources>\ns\n</sources>"]
    with pytest.raises(ValueError):
        prompt("nothing", "c")


def test_adapter_retries_and_counts():
    tries = []

    def call(config, prompt, timeout):
        tries.append(prompt)
        if len(tries) < 3:
            raise OSError
        return "ok", 10, 5

    a = Adapter(call, {"small": ModelConfig("m", 0.5, 1.5)}, delay=0)
    assert a.complete("small", "p", "route") == "ok" and [u[-1] for u in a.usage] == [False, False, True]
    with pytest.raises(ValueError):
        a.complete("large", "p", "route")

    def chunks(config, prompt, timeout):
        yield "a"
        yield "b"
        return 7, 2

    a.stream_call = chunks
    assert list(a.stream("small", "p", "summarise")) == ["a", "b"] and a.usage[-1][1:5] == ("summarise", "", 7, 2)
    stopped = a.stream("small", "p", "summarise")
    next(stopped), stopped.close()
    assert a.usage[-1][-1] is False


def test_stream_counts_events(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parque*")
    q = usage_by_window(stream).writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("usage").agg(F.sum("n")).first()[0] == events.count()


def test_selection_breaks_ties_by_id(spark):
    cat = spark.createDataFrame([(i, "s", "t", f"d{i}", "leases") for i in range(8, 0, -1)], CATALOG)
    assert [r["id"] for r in selection.select_documents(cat, "Leases?").orderBy("rank").collect()] == [1, 2, 3, 4, 5]
