"""Loads of both tables: all or nothing, and repeated without harm."""

import glob

import pytest
from pyspark.sql import functions as F

from foliosift import schemas
from foliosift.sources import sinks
from foliosift.sources.store import Conflict, Store

KEY = ["document_source", "document_type", "document_name"]
SECTION_KEY = [*KEY, "section_id"]


def catalog(spark, rows):
    return spark.createDataFrame([("s", "t", n, d) for n, d in rows], "document_source string, document_type string, document_name string, document_description string")


def content(spark, rows):
    return spark.createDataFrame([("s", "t", n, i, c) for n, i, c in rows], "document_source string, document_type string, document_name string, section_id int, section_content string")


def both(spark, docs, parts):
    return {"catalog": (catalog(spark, docs), schemas.CATALOG, KEY), "content": (content(spark, parts), schemas.SECTION, SECTION_KEY)}


def seen(store):
    return (
        sorted((r["id"], r["document_name"], r["document_description"]) for r in store.read("catalog").collect()),
        sorted((r["id"], r["document_name"], r["section_id"], r["section_content"]) for r in store.read("content").collect()),
    )


FIRST = [("a", "one"), ("b", None), ("c", "three")], [("a", 0, "x"), ("a", 1, "y"), ("b", 0, None)]


def test_replace_numbers_and_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.replace(both(spark, *FIRST)) == 1 and store.counts() == {"catalog": 3, "content": 3}
    assert seen(store) == ([(1, "a", "one"), (2, "b", None), (3, "c", "three")], [(1, "a", 0, "x"), (2, "a", 1, "y"), (3, "b", 0, None)])
    assert [f.name for f in schemas.CATALOG.fields] == store.read("catalog").columns
    assert store.replace({"catalog": (catalog(spark, []), schemas.CATALOG, KEY)}) == 2 and store.counts() == {"catalog": 0, "content": 3}
    assert store.read("catalog", 1).count() == 3 and store.read("catalog").count() == 0


def test_a_failure_at_any_step_leaves_both_tables(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.replace(both(spark, *FIRST))
    before, again = seen(store), both(spark, [("z", "new"), ("a", "changed")], [("z", 0, "new"), ("a", 0, "changed")])
    steps = []
    for name in ("_write", "_put", "_counted", "_publish"):
        whole = getattr(Store, name)

        def counted(self, *args, whole=whole, name=name):
            steps.append(name)
            if len(steps) == fail_at:
                raise OSError(f"before step {fail_at}")
            out = whole(self, *args)
            steps.append(f"{name} done")
            if len(steps) == fail_at and name not in ("_put", "_publish"):
                raise OSError(f"after step {fail_at}")
            return out

        monkeypatch.setattr(Store, name, counted)
    for load, stride in ((store.replace, 1), (store.merge, 3)):
        fail_at, failed = 1, 0
        while True:
            steps.clear()
            try:
                load(again)
            except OSError:
                failed += 1
                assert seen(store) == before and store.versions() == [1]
                fail_at += stride
                continue
            if "_put done" in steps and fail_at > len(steps):
                break
            if store.versions() != [1]:  # the step after the rename: published
                store._delete("_manifests/000000000002.json")
            fail_at += stride
        assert failed >= 8 // stride
        assert seen(store) != before
        store._delete("_manifests/000000000002.json")
        assert seen(store) == before
    fail_at = 0
    left = store.clean()
    assert left and seen(store) == before and store.clean() == []


def test_the_second_of_two_loads_at_once_is_told(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.replace(both(spark, *FIRST))
    stale = store.manifest()
    store.merge(both(spark, [("z", "new")], []))
    now = seen(store)
    monkeypatch.setattr(Store, "manifest", lambda self, version=None: stale)
    with pytest.raises(Conflict):
        store.merge(both(spark, [("y", "late")], []))
    monkeypatch.undo()
    assert seen(store) == now and store._names("_manifests") == ["000000000001.json", "000000000002.json"]


def test_loading_twice_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.merge(both(spark, *FIRST))["catalog"] == {"new": 3, "changed": 0, "unchanged": 0, "rewritten_files": 0}
    files = sorted(glob.glob(f"{tmp_path}/data/**/*.parquet", recursive=True))
    for _ in range(2):
        told = store.merge(both(spark, FIRST[0] + FIRST[0][:1], FIRST[1]))
        assert told["catalog"] == {"new": 0, "changed": 0, "unchanged": 3, "rewritten_files": 0} and store.versions() == [1]
    assert sorted(glob.glob(f"{tmp_path}/data/**/*.parquet", recursive=True)) == files


def test_merge_keeps_ids_and_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    names = [(f"d{i:03d}", f"text {i}") for i in range(200)]
    store.replace({"catalog": (catalog(spark, names), schemas.CATALOG, KEY)})
    entry = store.manifest()["tables"]["catalog"]
    spread = store._rows(entry).repartition(8, "id")  # several files, as a large load has
    files = store._write(spread, "data/spread/catalog")
    store._publish(store.manifest(), {"catalog": entry | {"files": files}})
    told = store.merge({"catalog": (catalog(spark, [("d007", "changed"), ("d008", "text 8"), ("e", "new"), ("ä", None)]), schemas.CATALOG, KEY)})
    assert told["catalog"] == {"new": 2, "changed": 1, "unchanged": 1, "rewritten_files": 1}
    now = store.manifest()["tables"]["catalog"]
    assert len(set(files) & set(now["files"])) == len(files) - 1 and now["rows"] == 202 and now["last_id"] == 202
    rows = {r["document_name"]: (r["id"], r["document_description"]) for r in store.read("catalog").collect()}
    assert len(rows) == 202 and rows["d007"] == (8, "changed") and rows["d008"] == (9, "text 8") and rows["e"] == (201, "new") and rows["ä"] == (202, None)
    assert store.clean() and store.read("catalog").count() == 202


def test_keys_that_clash_are_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(ValueError, match="several rows"):
        store.merge({"catalog": (catalog(spark, [("a", "one"), ("a", "two")]), schemas.CATALOG, KEY)})
    nulls = catalog(spark, [("a", "one")]).withColumn("document_type", F.lit(None).cast("string"))
    load = {"catalog": (nulls, schemas.CATALOG, KEY)}
    assert store.merge(load)["catalog"]["new"] == 1 and store.merge(load)["catalog"]["unchanged"] == 1


def test_numbering_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sinks, "IN_RANGE", 10)
    df = spark.range(95).select((F.col("id") * 7919 % 95).alias("k"), (F.col("id") % 3).alias("v")).withColumn("k", F.when(F.col("k") != 50, F.col("k")))
    got = sinks.numbered(df, "k", after=100).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: (r["k"] is None, r["k"]))] == list(range(101, 196))


def test_ranges_hold_few_bytes(spark, monkeypatch):
    """Long texts make more ranges of few rows, and the numbers stay the same."""
    df = spark.range(60).select(F.col("id").alias("k"), F.when(F.col("id") != 7, F.repeat(F.lit("é"), 500)).alias("some text")).repartition(3)
    monkeypatch.setattr(sinks, "BYTES", 6000, raising=False)
    rows = sinks.numbered(df, "k", name="n")
    assert [(r["k"], r["n"]) for r in rows.orderBy("k").collect()] == [(i, i + 1) for i in range(60)]
    held = [r["size"] for r in spark.read.parquet(*rows.inputFiles()).groupBy(F.input_file_name()).agg(F.sum(F.octet_length("some text")).alias("size")).collect()]
    assert len(held) >= 8 and max(held) <= 12000
