"""Each stage of the pipeline against plain Python, on a table with every kind of odd row."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliosift.llm import common, nearset
from tests.llm.test_operators import brute_components, brute_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with toxic, copied, contaminated and secret texts, null and repeated ids; labels; benchmark."""
    root, rng = tmp_path_factory.mktemp("tables"), random.Random(4)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so", "ni", "ve") for b in ("ran", "dol", "mek", "sil", "tor", "pan", "lim", "gus", "bar", "fen", "hul")]
    items = [prose(30) for _ in range(5)]
    rows = [(i, prose(60) + (" awful rotten filth" if i % 5 == 0 else "")) for i in range(400)]
    rows += [(400 + i, rows[3 * i + 1][1] + " end") for i in range(20)]  # near copies
    rows += [(430 + i, f"{prose(20)} {items[i % 5]} {prose(20)}") for i in range(10)]
    rows += [(450 + i, f"{prose(20)} password=hunter{i}22 {prose(9)}") for i in range(5)]
    rows += [(None, prose(40)), (None, rows[0][1] + " awful rotten filth"), (None, f"{prose(9)} {items[0]}"), (None, rows[1][1])]
    rows += [(460, prose(30)), (460, prose(31)), (461, rows[2][1]), (461, rows[2][1]), (462, None), (463, ""), (464, " \n "), (465, "x" * 300_000)]
    documents = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    documents.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 5 == 0) for i in range(400)], "doc_id long, b boolean").select("doc_id", F.lit(1).alias("quality"), F.col("b").cast("int").alias("toxic")).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, items


def test_stages_against_plain_python(spark, tables, tmp_path):
    sf, rows, items = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = key(docs)
        docs = written(stage(spark, docs, sf), tmp_path / str(number))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            after = key(docs)
        if name == "toxicity":
            want = [r for r in before if "awful" not in (r[1] or "")]
        elif name == "n-gram Jaccard join":
            groups = brute_components([r for r in before if r[0] is not None])
            stays = [r for r in before if r[0] is None or groups[r[0]][1] == r[0]]
            assert len([r for r in after if r[0] in (460, 461)]) == 2 - (461 not in {r[0] for r in stays})
            want = [r for r in stays if r[0] not in (460, 461)]
            after = [r for r in after if r[0] not in (460, 461)]
        elif name == "benchmark decontamination":
            want = [r for r in before if not any(i in (r[1] or "") for i in items)]
        elif name == "secret scans":
            want = sorted(((i, masked(t)) for i, t in before), key=repr)
        else:
            pieces = docs.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("pieces")).collect()
            assert sum(r["n"] for r in pieces) == sum(r["n"] // r["doc_tokens"] * r["doc_tokens"] for r in pieces)
            assert {r["doc_id"] for r in pieces} == {r[0] for r in before}
            continue
        assert after == want and after


def masked(text):
    spans = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(text)]
    for a, b in reversed(spans):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def test_run_equals_the_stages_and_leaves_no_folders(spark, tables, tmp_path, monkeypatch):
    sf, *_ = tables
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    got = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()
    left = sorted(p.name.split("-")[1] for p in tmp_path.iterdir() if p.name.startswith("foliosift"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf), tmp_path / f"again{number}")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    of = lambda rows: sorted({(key(r)[0], r["length"]) for r in rows if r["start"] == 0 and r["length"] < 40})
    assert of(got) == of(docs.select("doc_id", "start", "length", "ids_crc32").collect())
    # the last stage's input and its pieces, which the result reads
    assert left == ["packed", "secret"]


def test_pipeline_of_empty_tables(spark, tables, tmp_path):
    sf, *_ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf), tmp_path / str(number))
        assert docs.count() == 0


def test_other_columns_do_not_clash(spark, tables, tmp_path):
    sf, *_ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    for c in ("score", "evidence", "spans", "_text", "_digest", "row", "count"):
        docs = docs.withColumn(c, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == corpus_pipeline.COLUMNS


def test_near_duplicates_reads_its_columns_alone(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 1, "y")], "doc_id long, text string, n int, bucket string")
    assert {tuple(r) for r in nearset.near_duplicates(df).collect()} == {(1, 2, 1), (2, 2, 1)}
