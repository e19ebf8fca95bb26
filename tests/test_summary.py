"""Summaries against a version that builds the whole graph and takes sentence after sentence."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliosift.operators import search, summary


def split(text):
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def plain(sentences, asked=None, budget=summary.BUDGET):
    """Places in the order they are taken."""
    n = len(sentences)
    bags = [Counter(split(s)) for s in sentences]
    held = Counter(w for b in bags for w in b)
    rare = {w: math.log(1 + n / held[w]) for w in held}
    vectors = [{w: c * rare[w] for w, c in b.items()} for b in bags]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    cosine = lambda i, j: sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) / (norms[i] * norms[j]) if norms[i] and norms[j] else 0.0
    weights = np.array([[cosine(i, j) if i != j else 0.0 for j in range(n)] for i in range(n)])
    wanted = set(split(asked or "")) & set(held)
    total = sum(rare[w] for w in wanted)
    start = np.array([1 + summary.DRAW * (sum(rare[w] for w in wanted if b[w]) / total if total else 0) for b in bags])
    start /= start.sum()
    degree, share = weights.sum(axis=1), start.copy()
    for _ in range(summary.ROUNDS):
        linked = degree > 1e-12
        step = weights @ np.where(linked, share / np.where(linked, degree, 1), 0)
        new = (1 - summary.DAMPING) * start + summary.DAMPING * (step + share[~linked].sum() * start)
        change, share = np.abs(new - share).sum(), new
        if change < summary.TOLERANCE:
            break
    share = np.where(np.array(norms) > 0, share, 0)
    if not share.max():
        return []
    rank, left, taken = share / share.max(), budget, []
    size = [max(1, len(s) // 4) for s in sentences]
    while True:
        value = {i: round(1e9 * rank[i] * (1 - min(1, max((cosine(i, t) for t in taken), default=0)))) for i in range(n) if i not in taken}
        able = [i for i in value if size[i] <= left and value[i] > 0] or ([i for i in value if value[i] > 0] if not taken else [])
        if not able:
            return taken
        best = min(able, key=lambda i: (-value[i], i))
        taken.append(best)
        left -= size[best]


WORDS = "lease asset term rate cash the of and credit loss élan risk".split()


def drawn(rng, n):
    out = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 9))).capitalize() + "." for _ in range(n)]
    return [*out, "!!", out[0]] if out and rng.random() < 0.5 else out


@pytest.mark.parametrize("budget", [6, 25, 120])
def test_equals_the_whole_graph(spark, budget):
    rng = random.Random(budget)
    texts = [(i, drawn(rng, rng.randrange(0, 40)), rng.choice([None, "credit risk", "nowhere"])) for i in range(60)]
    rows = spark.createDataFrame(texts, "id long, s array<string>, question string").withColumn("sentences", F.transform("s", lambda x: F.struct(x.alias("sentence"))))
    asked = F.when(F.col("question").isNotNull(), F.array_distinct(search.terms("question")))
    got = {r["id"]: r["summary"] for r in summary.summarise(rows.repartition(3), ["id"], asked=asked, budget=budget).collect()}
    assert set(got) == {i for i, s, _ in texts if s}
    for i, s, question in texts:
        if s:
            want = plain(s, question, budget)
            assert [x["s"]["sentence"] for x in got[i]] == [s[k] for k in sorted(want)]
            assert [x["taken"] for x in got[i]] == [want.index(k) + 1 for k in sorted(want)]


def test_documents_keep_sections_and_repeats_are_left_out(spark):
    catalog = spark.createDataFrame([(1, "s", "t", "d", ""), (2, "s", "t", "none", ""), (3, "s", "t", "long", "")], "id long, document_source string, document_type string, document_name string, document_description string")
    sections = spark.createDataFrame(
        [("s", "t", "d", 1, None, "", "Leases are assets. Leases are assets."), ("s", "t", "d", 0, "First", "", "Rates of leases are fixed.\nLeases are assets."), ("s", "t", "none", 0, None, None, None), ("s", "t", "long", 0, None, None, "word " * 5000)],
        "document_source string, document_type string, document_name string, section_id int, section_name string, section_summary string, section_content string",
    )
    rows = {r["id"]: r["summary"] for r in summary.of_documents(catalog, sections, budget=20).collect()}
    assert set(rows) == {1, 3} and len(rows[3]) == 1
    assert [(x["s"]["section_id"], x["s"]["section_name"], x["s"]["sentence"]) for x in rows[1]] == [(0, "First", "Rates of leases are fixed."), (0, "First", "Leases are assets.")]


def test_sources_in_rounds(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), i, [(s,) for s in drawn(rng, 4)]) for i in range(90)]
    frame = spark.createDataFrame(rows, "document_source string, id long, sentences array<struct<sentence: string>>")
    frame = frame.withColumn("summary", F.transform("sentences", lambda s: F.struct(F.struct(F.lit(0).alias("section_id"), F.lit("").alias("section_name"), s["sentence"].alias("sentence")).alias("s"), F.lit(1).alias("taken"), F.lit(1).alias("rank"))))
    once = {r["document_source"]: r["summary"] for r in summary.of_sources(frame.select("document_source", "id", "summary"), budget=40, fan_in=1000).collect()}
    assert set(once) == {"a", "b", None}
    for source, got in once.items():
        own = [(i, s) for src, i, ss in sorted(rows, key=lambda r: r[1]) if src == source for (s,) in ss]
        assert [(x["s"]["id"], x["s"]["sentence"]) for x in got] == [own[k] for k in sorted(plain([s for _, s in own], budget=40))]
    many = {r["document_source"]: r["summary"] for r in summary.of_sources(frame.select("document_source", "id", "summary"), budget=40, fan_in=8).collect()}
    held = {(i, s) for _, i, ss in rows for (s,) in ss}
    assert set(many) == set(once) and all(x and {(y["s"]["id"], y["s"]["sentence"]) for y in x} <= held for x in many.values())
