"""Order statistics without sorting, against sorting."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from foliosift.operators import profile

CASES = {
    "spread": lambda rng, n: [rng.randrange(10**12) for _ in range(n)], "ties": lambda rng, n: [rng.choice([3, 3, 3, 7, -2]) for _ in range(n)], "one value": lambda rng, n: [5] * n,
    "signs": lambda rng, n: [rng.randrange(-(2**40), 2**40) for _ in range(n)], "far": lambda rng, n: [rng.choice([0, 2**58, -(2**58), 17]) for _ in range(n)],
}


@pytest.mark.parametrize("case", CASES)
def test_selection_equals_sorting(spark, case):
    rng = random.Random(case)
    for n in (10, 11, 400):
        values = CASES[case](rng, n)
        df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "tokens long").where("tokens IS NOT NULL")
        down = sorted(values, reverse=True)
        ranks = sorted({1, 2, n // 2, n - 1, n})
        assert profile.values_at(df, "tokens", [0, *ranks, n + 1]) == {r: (down[r - 1], sum(v > down[r - 1] for v in values)) for r in ranks}
        start = max(0, n // 2 - 5)
        assert tuple(profile.middle_and_bottom(df).first()) == (sum(down[start : start + 10]), sum(down[-10:]))


def test_no_sort_or_window_in_the_plan(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 501).alias("tokens"))
    plan = profile.middle_and_bottom(df)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan


def test_medians_of_groups(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice(kinds)) for g, n, kinds in (("a", 5000, range(10**6)), ("b", 4, [1, 2, 9]), ("c", 1, [7]), (None, 31, [3, 4]), ("d", 3000, [1, 1, 1, 2])) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("e", None)], "g string, v long").repartition(7)
    want = {g: (sum(x == g for x, _ in rows), float(statistics.median(v for x, v in rows if x == g))) for g in {g for g, _ in rows}}
    assert {r["g"]: (r["n"], r["median"]) for r in profile.medians(df, "g", "v").collect()} == want


def test_medians_where_a_sketch_is_wrong(spark, monkeypatch):
    monkeypatch.setattr(profile, "SLACK", -0.4)  # bounds that don't hold the median
    df = spark.createDataFrame([("a", v) for v in range(1001)], "g string, v long")
    assert [tuple(r) for r in profile.medians(df, "g", "v").collect()] == [("a", 1001, 500.0)]


def stratified(rng):
    return [(g, i, max(1, round(c / f + rng.gauss(0, 3))), c) for i in range(900) for g, f in [rng.choice([("a", 4), ("b", 5), ("c", 3)])] for c in [rng.randrange(40, 900)]]


def test_bottom_k_is_the_same_in_any_partitioning(spark):
    df = spark.createDataFrame(stratified(random.Random(1)), "g string, id long, tokens long, chars long")
    one = sorted(map(tuple, profile.bottom_k(df, "g", "id", 20).collect()))
    assert one == sorted(map(tuple, profile.bottom_k(df.repartition(9), "g", "id", 20).collect())) and len(one) == 60
    halves = profile.bottom_k(df.where("id % 2 = 0"), "g", "id", 20).unionByName(profile.bottom_k(df.where("id % 2 = 1"), "g", "id", 20))
    assert one == sorted(map(tuple, profile.bottom_k(halves, "g", "id", 20).collect()))


def test_the_interval_holds_the_ratio(spark):
    """In about 95 of 100 samples, and always where the sample is the whole."""
    rows = stratified(random.Random(3))
    df = spark.createDataFrame(rows, "g string, id long, tokens long, chars long").coalesce(1).cache()
    true = sum(r[2] for r in rows) / sum(r[3] for r in rows)
    held = 0
    for seed in range(60):
        one = profile.ratio_of_sample(df, "g", "id", "tokens", "chars", 40, seed).first()
        held += one["low"] <= true <= one["high"]
    assert 52 <= held
    whole = profile.ratio_of_sample(df, "g", "id", "tokens", "chars", 10_000).first()
    assert abs(whole["ratio"] - true) < 1e-12 and whole["error"] == 0 and whole["chars"] == sum(r[3] for r in rows)
