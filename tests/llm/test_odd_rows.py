"""Every operator on one table of odd rows: null and repeated ids, null, empty and very long texts,
equal rows, and further columns that are named like those the operators use or add."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliosift.llm import decontaminate, language, licenses, nearset, packing, resharding, secrets, toxicity, urlfilters

LONG = "word " * 60_000
ROWS = [(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, None), (3, ""), (None, None), (None, "one two three four five six seven eight"), (4, LONG), (5, "x" * 300_000), (6, " \t\n"), (6, "else")]
#: Columns inside or added by the operators.
CLASHES = ["spans", "_text", "score", "evidence", "size", "shard", "slot", "row", "part", "old", "host", "verdict", "pattern", "p", "license", "u", "start", "length", "n_shingles", "bucket", "subset"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("mine"))
    return df


def test_secrets(odd):
    rows = secrets.annotate(odd).collect()
    assert len(rows) == len(ROWS) and all(r["spans"] == [] or r["text"] == "x" * 300_000 for r in rows) and {r["score"] for r in rows} == {"mine"}
    assert sorted(map(repr, (r["text"] for r in secrets.redact(odd).collect()))) == sorted(repr(t) for _, t in ROWS)


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (None, "x y z a b c"), (2, None), (3, "word " * 9)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(odd, items.withColumn("words", F.lit(1))).collect()}
    assert got == {(1, 1), (4, 3)}


def test_licenses(spark, odd):
    more = spark.createDataFrame([(7, "MIT"), (8, licenses.MIT), (8, licenses.MIT), (9, LONG + "\n" + licenses.MIT)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r["unit"] for r in licenses.scan(odd.unionByName(more, allowMissingColumns=True)).collect()}
    assert got == {(8, "MIT"): "text"}


def test_packing(odd):
    rows = packing.pack(odd, packing.tokenizer_path()).collect()
    total = {}
    for r in rows:
        total.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert set(total) == {1, 2, 3, 4, 5, 6, None} and all(r["length"] <= 2048 for r in rows)
    assert len(total[1]) >= 2 and sum(r["length"] for r in rows if r["doc_id"] in (2, 3)) == 2
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length


def test_language(odd):
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.col("text").alias("html"), *CLASHES)
    labelled = odd.select(F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 4, "de").alias("lang"), "text")
    rows = language.identify(pages, labelled).collect()
    assert len(rows) == len(ROWS) and {r["lang"] for r in rows if r["page_id"] == 1} == {"en"} and {r["lang"] for r in rows if r["page_id"] == 4} == {"de"}


def test_resharding(odd):
    rows = resharding.reshard(odd, F.lit(0), 3).collect()
    assert len(rows) == len(ROWS) and {r["part"] for r in rows} == {"mine"}
    for j in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == j) == list(range(sum(r["shard"] == j for r in rows)))
    assert {r["size"] for r in rows if not r["text"]} == {1} and len({r["shard"] for r in rows if r["text"] == ROWS[0][1]}) == 1


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)] + [(None, 1), (2, None)], "doc_id long, label int")
    rows = toxicity.score(odd, odd.select("doc_id", "text"), labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows) and {r["size"] for r in rows} == {"mine"}
    assert len({r["score"] for r in rows if r["text"] == ROWS[0][1]}) == 1 and len({r["score"] for r in rows if not r["text"]}) == 1


def test_list_entries_at_one_rank(spark):
    day = dt.date(2024, 1, 2)
    log = spark.createDataFrame([("block", "a.example", "add", day), ("allow", "a.example", "add", day), ("block", "b.example", "add", day), ("block", "b.example", "remove", day), ("block", None, "add", day)], "list string, pattern string, action string, happened date")
    rows = [(1, "http://a.example/", day), (1, "http://a.example/", day), (None, "http://a.example/", day), (2, "http://b.example/" + "x" * 300_000, day), (3, "", day)]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched_at date").withColumn("verdict", F.lit("mine")).withColumn("entries", F.lit("mine"))
    got = sorted((repr(r["page_id"]), r["verdict"], r["entries"]) for r in urlfilters.judge(caps, log).collect())
    assert got == [("1", "allow", "mine"), ("1", "allow", "mine"), ("2", "none", "mine"), ("3", "none", "mine"), ("None", "allow", "mine")]


def test_near_duplicates(odd):
    rows = nearset.near_duplicates(odd).collect()
    got = sorted({(repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in rows})
    assert len(rows) == len(ROWS)
    assert got == [("1", 4, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "4"), ("5", 1, "5"), ("6", 0, "6"), ("6", 1, "6"), ("None", 0, "None"), ("None", 4, "None")]
