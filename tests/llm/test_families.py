"""Near-duplicate families larger than any subset whose pairs are taken, around the threshold."""

import random

import numpy as np
import pytest

from foliosift.llm import nearset


def brute_components(texts):
    """Components by all pairs: rows of a 0/1 matrix, multiplied."""
    shingle, at = nearset.Shingler(), {}
    sets = [shingle(t) for t in texts]
    for s in sets:
        for x in s.tolist():
            at.setdefault(x, len(at))
    m = np.zeros((len(sets), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[x] for x in s.tolist()]] = 1
    both, size, up = m @ m.T, m.sum(1), list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in np.argwhere(np.triu((175 * both >= 75 * (size[:, None] + size[None])) & (both > 0), 1)):
        a, b = root(int(i)), root(int(j))
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed, copies, size, edits, drop, nested", [(1, 2000, 150, 7, 0.0, 0), (2, 900, 100, 5, 0.5, 0), (3, 900, 120, 6, 0.3, 3)])
def test_families_around_the_threshold(spark, monkeypatch, seed, copies, size, edits, drop, nested):
    """Substituted, cut and twice copied texts; blocks of 64 sets, so that many pairs of blocks meet."""
    monkeypatch.setattr(nearset, "TOGETHER", 64)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(100_000)}"
    base = [word() for _ in range(size)]

    def edited(text):
        text = list(text)
        for _ in range(rng.randrange(max(1, edits - 3), edits + 3)):
            at = rng.randrange(len(text))
            if rng.random() < drop:
                del text[at : at + rng.randrange(1, 4)]
            else:
                text[at] = word()
        return text

    middles = [base, *(edited(base) for _ in range(nested))]
    rows = [(i, " ".join(base if i == 0 else edited(rng.choice(middles)))) for i in range(copies)]
    got = dict(nearset.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect())
    want = brute_components([t for _, t in rows])
    assert [got[i] for i in range(copies)] == want
    assert 1 < len(set(want)) < copies


def test_packing_keys_holds_them_once():
    """What is put together for a row isn't held twice."""
    import tracemalloc

    import numpy as np

    from foliosift.llm import nearset

    rng = np.random.default_rng(1)
    tracemalloc.start()
    keys = nearset.Keys(28, nearset.Bands(1000))
    while keys.n_keys < nearset.FLUSH:
        sets = [np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64)) for _ in range(300)]
        keys.add(sets, rng.integers(0, 1 << 60, 300))
    keys.pack(0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000, most
