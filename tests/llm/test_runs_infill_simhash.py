"""op11 to op13 against plain Python: over the smallest tables, over drawn texts, and over odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliosift.llm import buffers, infill, periodic, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
ODD = [(1, "a b a b a b a b a b"), (1, "a b a b a b a b a b"), (1, "other words here now"), (2, None), (3, ""), (None, "a b a b a b a b a b"), (None, None), (4, "word " * 60_000), (5, "x" * 300_000), (6, " \t\n"), (7, "éé   <P> end"), (8, "<S")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("n", "form", "output", "runs", "h1", "print", "node", "shard", "piece", "component_id", "words", "start"):
        df = df.withColumn(c, F.lit("mine"))
    return df


# op11


def plain_runs(w, shortest=6, exponent=4):
    """By looking along every distance."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, k, q) for (s, k), q in out.items())


def collapsed(w, runs):
    gone = {x for s, k, q in runs for x in range(s + q, s + k)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def drawn_texts(rng):
    docs = []
    for _ in range(rng.randint(1, 5)):
        n, kinds = rng.choice([0, 1, 2, 7, 20, 60, 150]), rng.choice([1, 2, 3, 5, 50])
        w = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.5 and n > 5:
            a = rng.randrange(n)
            p = rng.randint(1, 1 + (n - a) // 3)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.4 and n > 5:  # a run inside a copied stretch
            b = w[rng.randrange(n) :]
            w = [*w, 98, *b, 99, *b]
        docs.append(w)
    return docs


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_drawn_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        docs = drawn_texts(rng)
        at, code = np.cumsum([0, *map(len, docs)]), np.array([x for w in docs for x in w], np.int64)
        for shortest, exponent in ((6, 4), (2, 2), (5, 3)):
            assert periodic.find_runs(code, at, shortest, exponent) == [plain_runs(w, shortest, exponent) for w in docs]


def test_previous_factors():
    rng = random.Random(3)
    for _ in range(20):
        docs = drawn_texts(rng)
        at, code = np.cumsum([0, *map(len, docs)]), np.array([x for w in docs for x in w], np.int64)
        if not len(code):
            continue
        longest, source = periodic.previous_factors(periodic.Suffixes(code, at))
        for low, w in zip(at.tolist(), docs):
            share = lambda i, j: next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i)  # noqa: E731, B023
            for i in range(len(w)):
                assert longest[low + i] == max((share(i, j) for j in range(i)), default=0)
                if longest[low + i]:
                    assert share(i, source[low + i] - low) == longest[low + i]


def test_op11_equals_plain_python(spark):
    docs = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    rows = periodic.op11_runs(spark, SF).collect()
    assert len(rows) == len(docs) and any(r["n_runs"] for r in rows)
    for r in rows:
        w = WORD.findall(docs[r["doc_id"]] or "")
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert tuple(r) == (r["doc_id"], len(runs), *want, digest(lines), digest(collapsed(w, runs)))


def test_runs_of_odd_rows(spark, odd):
    rows = periodic.collapse_runs(odd).collect()
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows), key=repr)
    want = []
    for i, text in ODD:
        w = WORD.findall(text or "")
        runs = [(0, 60_000, 1)] if len(w) == 60_000 else plain_runs(w)
        want.append((i, len(w), runs, "word" if len(w) == 60_000 else collapsed(w, runs)))
    assert got == sorted(want, key=repr)
    assert periodic.collapse_runs(odd.where("false")).collect() == []
    with pytest.raises(ValueError):
        periodic.collapse_runs(odd, exponent=1)


# op12


def plain_infill(i, text, seed=1):
    text, h = text or "", digest(f"{seed}:{'' if i is None else i}")
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, (h1, h2, h3, h4) = len(units), (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    if h4 % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_plain_python(spark, odd):
    rng = random.Random(5)
    parts = ["a", "Z", "bc", " ", "\n", "é", "中", "\U0001f600", "<", "S", ">", "<P", "7"]
    rows = ODD + [(100 + i, "".join(rng.choices(parts, k=rng.randrange(40)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("mine"))
    out = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:-1] for r in out))) == sorted(repr(plain_infill(*r)) for r in rows)
    assert sorted(map(repr, ((r["doc_id"], r["back"]) for r in out))) == sorted(repr((i, t or "")) for i, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.where("false")).collect() == [] and infill.fill_in_middle(odd).count() == len(ODD)


def test_infill_ignores_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same = lambda df: sorted(map(repr, infill.fill_in_middle(df).collect()))
    assert same(docs) == same(docs.repartition(7))


# op13


def plain_print(text):
    w = WORD.findall((text or "").translate(LOW))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """(print, least id of its component) by comparing all pairs; prints has (id, print) rows."""
    values = sorted({p for _, p in prints})
    root = list(range(len(values)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    least = {}
    for i, p in prints:
        t = top(values.index(p))
        if i is not None:
            least[t] = min(i, least.get(t, i))
    return {p: least.get(top(k)) for k, p in enumerate(values)}


def test_op13_equals_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, plain_print(t)) for i, t in docs]
    of = plain_components(prints)
    got = sorted(tuple(r) for r in simhash.op13_simhash(spark, SF).collect())
    assert got == sorted((i, f"{p:016x}", of[p]) for i, p in prints)


def test_simhash_of_odd_rows(spark, odd):
    prints = [(i, plain_print(t)) for i, t in ODD]
    of = plain_components(prints)
    got = sorted((repr(tuple(r)) for r in simhash.simhash_duplicates(odd).collect()))
    assert got == sorted(repr((i, f"{p:016x}", of[p])) for i, p in prints)
    lost = simhash.simhash_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], odd.select("doc_id", "text").schema)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["component_id"]) for r in lost))) == ["(3, 3)", "(None, None)", "(None, None)"]
    assert simhash.simhash_duplicates(odd.where("false")).collect() == []


def families(rng, n, of):
    """Fingerprints in chains of up to three changed bits."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice(of)):
            out.append(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    return out[:n]


def test_fingerprints_of_one_batch():
    rng = random.Random(2)
    texts = ["", None, "one", "A b", *(" ".join(rng.choices(["Ab", "c", "É", "dé"], k=rng.randrange(30))) for _ in range(200))]
    got = simhash.fingerprints(*buffers.utf8(pa.array(texts)))
    assert got.tolist() == [plain_print(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_forest_finds_all_within_the_radius(seed):
    rng = random.Random(seed)
    values = np.unique(np.array(families(rng, 500, [1, 2, 30]), np.uint64))
    group = np.sort(np.array([rng.randrange(3) for _ in values]))
    forest = simhash.Forest.grow(values, group)
    # every child hangs at its distance from its parent
    for i in range(len(values)):
        for c in range(forest.low[i], forest.high[i]):
            assert forest.edge[c] == int(forest.value[i] ^ forest.value[c]).bit_count()
    roots = {g: k for k, g in enumerate(sorted(set(group.tolist())))}
    found = {(int(values[q]), int(forest.value[n])) for qs, ns in forest.within(values, np.array([roots[g] for g in group.tolist()]), 4) for q, n in zip(qs, ns)}
    want = {(int(x), int(y)) for x, g in zip(values, group) for y, h in zip(values, group) if g == h and int(x ^ y).bit_count() <= 4}
    assert found == want


def test_links_in_many_pieces(spark, monkeypatch):
    """Pieces so small that every shard of a family is dealt to several."""
    rng = random.Random(9)
    values = families(rng, 1200, [1, 3, 200])
    monkeypatch.setattr(simhash, "PIECE", 16)
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    links = simhash.linked(spark.createDataFrame([(v,) for v in signed], "print long")).collect()
    root = {v: v for v in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[top(r["u"])] = top(r["v"])
    got, want = {}, plain_components([(v, v) for v in set(values)])
    for v in signed:
        got.setdefault(top(v), set()).add(v % (1 << 64))
    groups = {}
    for p, c in want.items():
        groups.setdefault(c, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert len(links) < 40 * len(signed)
