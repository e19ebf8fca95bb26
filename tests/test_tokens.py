"""Exact counts against the library that the vocabulary is for."""

import base64
import random
import tracemalloc

import pytest

from foliosift.operators import tokens

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_of_the_tables(spark, encoding):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = tokens.counted(docs.select("doc_id", "text"), "text", PATH).collect()
    assert all(r["tokens"] == len(encoding.encode_ordinary(r["text"] or "")) for r in rows) and len(rows) == docs.count()


def test_odd_texts(spark, encoding):
    rng = random.Random(3)
    parts = ["the ", " ", "\n\n", "\t", "é", "中文", "😀", "don't", "we'll", "'S", "123", " 4567", "==", "a" * 300, "=" * 500, " ", " ", "ab" * 200, " x"]
    texts = ["", None, *parts, *("".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(150))]
    rows = tokens.counted(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "t", PATH, "n").collect()
    assert {r["i"]: r["n"] for r in rows} == {i: len(encoding.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_a_full_memory_begins_anew(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 5)
    merger = tokens.Merger(PATH)
    text = "one two three four five six seven eight nine ten " * 3
    assert merger.count(text) == tokens.Merger(PATH).count(text) and len(merger.known) <= 5


def test_a_worker_holds_few_characters(monkeypatch):
    """Long words fill the memory as many do, and a text isn't held as a list of its words."""
    monkeypatch.setattr(tokens, "CHARS", 300, raising=False)
    merger, text = tokens.Merger(PATH), " ".join(chr(97 + i % 26) * (60 + i % 30) for i in range(100))
    assert merger.count(text) == tokens.Merger(PATH).count(text) > 100 and sum(map(len, merger.known)) < 300 + 100
    tracemalloc.start()
    merger.count("and so on " * 100_000)
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()
