"""A question answered from the index: sources by what they hold, documents by BM25, sentences by rank."""

from foliosift.operators import profile, search
from foliosift.plans.ask import ask, digest, planner_of, summarised
from foliosift.sources import registry

CATALOG = "id long, document_source string, document_type string, document_name string, document_description string"
SECTION = "document_source string, document_type string, document_name string, section_id int, section_name string, section_summary string, section_content string"


def store(spark):
    docs = [(1, "policy", "t", "Leases", "how leases are recognised as assets and liabilities"), (2, "policy", "t", "Cash", "cash and bank balances"), (3, "wiki", "t", "Trips", "how trips are booked"), (4, "memo", "t", "Old lease", "a lease of one building, leases in general")]
    parts = [
        ("policy", "t", "Leases", 0, None, "recognising leases", "Leases are recognised as assets. A liability is recognised too. Leases are recognised as assets."),
        ("policy", "t", "Leases", 1, None, "other", "The weather was fine."), ("memo", "t", "Old lease", 0, None, "a lease", "One building was leased. Its leases are short."), ("wiki", "t", "Trips", 0, None, "trips", "Trips are booked early."),
    ]
    return spark.createDataFrame(docs, CATALOG), spark.createDataFrame(parts, SECTION)


def test_answers_from_the_index(spark):
    catalog, sections = store(spark)
    index, reg = search.index(catalog), registry.registry(spark)
    plan = planner_of(spark, index)
    known = [r.asDict() for r in reg.collect()]
    assert plan("how are leases recognised", known)[0] == "internal_policy" and "internal_wiki" not in plan("leases and cash balances", known)
    asked = [{"role": "user", "content": "explain how leases are recognised as assets"}]
    told = "".join(ask(spark, asked, catalog, sections, reg, planner=plan, index=index, synthesise=summarised))
    assert "### Leases\nLeases are recognised as assets. A liability is recognised too." in told and told.count("Leases are recognised as assets.") == 1
    short = list(ask(spark, asked, catalog, sections, reg, planner=plan, index=index, synthesise=summarised, summarise=digest(spark, 12)))
    assert any(c == "Leases are recognised as assets.\n" for c in short) or any("recognised" in c for c in short[-3:])
    listed = "".join(ask(spark, [{"role": "user", "content": "list documents on leases"}], catalog, sections, reg, planner=plan, index=index))
    assert "Leases" in listed and "Cash" not in listed


def test_an_injected_tokenizer(spark):
    rows = spark.createDataFrame([("a b", 2), ("", 0), (None, 0), ("a  b c ", 3)], "t string, n long")
    assert all(r["n"] == r["tokens"] for r in profile.exactly_counted(rows, "t", lambda: str.split).collect())
