"""What the summary's plan does once."""

from foliosift.operators import summary
from foliosift.sources import tables

SF = "/root/testdata/sf0.001"


def test_texts_are_cut_and_hashed_once(spark):
    found = summary.of_documents(tables.catalog(spark, SF), tables.sections(spark, SF))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 1
    assert "split(" in plan and plan.count("[.!?]") == 1
