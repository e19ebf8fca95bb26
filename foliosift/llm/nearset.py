"""Near-duplicate documents: exact Jaccard join of 5-word shingle sets.

Universe partition. Sizes are cut into bands. In a band, the tokens' universe is
hashed into m segments; two sets of the band whose Jaccard similarity reaches the
threshold differ in at most H tokens, so at least m - H segments are the same in
both. Each set indexes the subset of its tokens in every segment that has any.
Empty segments are no evidence: a set with z of them is sure to share an indexed
subset with each of its partners while its slack m - H - 1 - z is 0 or more, and a
pair is found if one of the two has such slack. m exceeds H by ``SPARE``, so most
sets have slack. A set without it also indexes its subsets' one-deletion
neighbourhoods; as many of its segments as it is short of are allocated a distance
of 1, those whose probes cost least (deletions to look up, plus the chance that a
small subset is common), and only those probe. Sets that even this can't reach meet
under a key of their own. A set also goes into the next band when it may have
partners there.

Keys travel packed: one row per task and bucket, 4 bytes of key and 2 of document
each, so the shuffle sorts thousands of rows and not millions. Subsets in at most
``TEAM`` distinct sets give all their pairs. Larger ones give each member's pair
with the member that most consists of large subsets, and cost each member one slack unless all their members
turn out to be in one component. Sets whose slack that uses up are matched again in
the finest partition, a segment for each token, where a pair is sure to meet unless
more than six in seven of its tokens are common; what is left of these is compared
through the middle of the large subset they share (``_through_middles``). Candidates are verified on the whole sets: first
the pair with most votes for each set, then, of the others, those that the links found
so far don't already join, and at last the pairs of sets without slack. So components are exact.

Equal sets are one class and compared once. Defined results: words are split and
lowered as ASCII; a null, empty or blank text has no shingles and is linked with
nothing, not even its copies; fewer than five words are one shingle; repeated rows
are copies; a null id keeps a null component; ids name documents, so different
texts under one id count as linked; an empty table gives an empty result; only the
id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliosift.llm import wordpieces
from foliosift.llm.common import alone, cut, dropped, table
from foliosift.llm.components import components

WORDS, NUM, DEN = 5, 75, 100
#: Band growth; segments beyond H + 1 as a share of H; the largest subset whose pairs are all taken.
GROWTH, SPARE, TEAM = 1.5, 0.4, 8
#: Keys a bucket is planned for, keys a task packs at once, words and sets a task remembers.
BUCKET, FLUSH, MEMORY = 1_000_000, 1_000_000, 200_000
#: Sets of a block that is compared with another.
TOGETHER = 512
U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * M2
    x = (x ^ (x >> U(29))) * M3
    return x ^ (x >> U(32))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, U)
        if len(words) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], U)
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), U, len(words))
        acc = h[: len(h) - WORDS + 1]
        for j in range(1, WORDS):
            acc = mix(acc) * M1 + h[j : len(h) - WORDS + 1 + j]
        return np.unique(mix(acc))


def identity(tokens: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit fingerprint as two signed longs."""
    whole = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return tuple(int(v) for v in np.array([whole >> 64, whole & (2**64 - 1)], U).view(np.int64))


class Bands:
    """Size bands [first, last]; differences and segments of each."""

    def __init__(self, most: int):
        starts = [1]
        while starts[-1] <= most * DEN // NUM + 1:
            starts.append(max(starts[-1] + 1, int(starts[-1] * GROWTH)))
        self.first = np.array(starts[:-1], np.int64)
        self.last = np.array(starts[1:], np.int64) - 1
        h = 2 * self.last * (DEN - NUM) // (DEN + NUM)
        self.segments = h + 3 + np.ceil(SPARE * h).astype(np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, sizes, side="right") - 1

    def differences(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The most tokens in which a set and a partner in the band can differ."""
        partner = np.minimum(sizes * DEN // NUM, self.last[band])
        return (sizes + partner) * (DEN - NUM) // (DEN + NUM)


def key_of(total, count, segment, band):
    return mix(total + M1 * count.astype(U) + M2 * segment.astype(U) + M3 * (band.astype(U) + U(1)))


class Keys:
    """Collects keys of (set, band) entries and packs them by bucket."""

    def __init__(self, buckets: int, bands: Bands):
        self.buckets, self.bands = buckets, bands
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []  # doc_id, n, hi, lo of every document
        self.entries: list[tuple] = []  # arrays: hi, size, slack, band, native
        self.keys: list[tuple] = []  # arrays: key, entry, flag
        self.n_entries = self.n_keys = 0

    def add(self, sets: list[np.ndarray], ids: np.ndarray) -> None:
        sizes = np.array([len(s) for s in sets], np.int64)
        tokens, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        own = self.bands.of(sizes)
        self._entries(tokens, doc, ids, sizes, own, np.ones(len(sets), bool), True)
        nxt = np.minimum(own + 1, len(self.bands.first) - 1)
        self._entries(tokens, doc, ids, sizes, nxt, (nxt > own) & (sizes * DEN >= NUM * self.bands.first[nxt]), False)

    def _entries(self, tokens, doc, ids, sizes, band, use, native: bool) -> None:
        if not use.any():
            return
        number = np.cumsum(use) - 1
        keep = use[doc]
        tokens, doc = tokens[keep], number[doc[keep]]
        ids, sizes, band = ids[use], sizes[use], band[use]
        m = self.bands.segments[band]
        at = np.concatenate([[0], np.cumsum(m)])
        place = at[doc] + ((tokens >> U(32)) * m[doc].astype(U) >> U(32)).astype(np.int64)
        mixed = mix(tokens)
        total, count = np.zeros(at[-1], U), np.bincount(place, minlength=at[-1])
        np.add.at(total, place, mixed)
        full = np.flatnonzero(count)
        owner = np.searchsorted(at, full, side="right") - 1
        slack = m - self.bands.differences(sizes, band) - 1 - (m - np.bincount(owner, minlength=len(ids)))
        key = key_of(total[full], count[full], full - at[owner], band[owner])
        flag = np.zeros(len(key), np.uint8)
        hard = np.flatnonzero(slack < 0)
        for e in hard:
            mine = owner == e
            flag[mine] |= self._neighbourhoods(e, place - at[e], tokens, mixed, doc == e, total, count, at[e], int(-slack[e]), band[e], full[mine] - at[e])
        self.entries.append((ids, sizes, np.maximum(slack, 0), band, np.full(len(ids), native)))
        self.keys.append((key, (owner + self.n_entries).astype(np.int32), flag))
        self.n_entries += len(ids)
        self.n_keys += len(key)

    def _neighbourhoods(self, e, segment, tokens, mixed, mine, total, count, base, short, band, full) -> np.ndarray:
        """Indexes one-deletion subsets of a set; returns flags of its whole subsets (2: allocated)."""
        sizes = count[base + full]
        # the cost of a distance of 1: a look-up per deletion, and chance hits of what is left
        cost = np.where(sizes >= 2, sizes + 64.0 / sizes, np.inf)
        chosen = [i for i in np.argsort(cost, kind="stable")[:short] if sizes[i] >= 2]
        allocated = np.zeros(len(full), bool)
        allocated[chosen] = True
        seg = segment[mine]
        many = count[base + seg] >= 2
        seg, gone = seg[many], mixed[mine][many]
        keys = key_of(total[base + seg] - gone, count[base + seg] - 1, seg, np.full(len(seg), band))
        flags = 1 + 2 * np.isin(seg, full[allocated]).astype(np.uint8)
        if len(chosen) < short:  # no allocation suffices: such sets meet under one key
            keys, flags = np.append(keys, mix(np.array([band], U) + M3)), np.append(flags, np.uint8(0))
        self.keys.append((keys, np.full(len(keys), self.n_entries + e, np.int32), flags.astype(np.uint8)))
        self.n_keys += len(keys)
        return np.where(allocated, 2, 0).astype(np.uint8)

    def pack(self, turn: int) -> pa.RecordBatch:
        """One row per bucket with keys, and one, of a bucket by turns, with the documents' sets."""
        names, blobs = [turn % self.buckets], [None]
        ids = pa.array([r[0] for r in self.rows], pa.int64())
        known = pa.record_batch([ids, *(pa.array(c, pa.int64()) for c in (list(zip(*self.rows))[1:] or [[]] * 3))], names=["doc_id", "n", "hi", "lo"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, known.schema) as stream:
            stream.write_batch(known)
        if self.keys:
            self._pack_keys(names, blobs)
        self.clear()
        return pa.record_batch(
            [pa.array(names, pa.int32()), pa.array(blobs, pa.binary()), pa.array([sink.getvalue().to_pybytes()] + [None] * (len(names) - 1), pa.binary())],
            names=["bucket", "blob", "sets"],
        )

    def _pack_keys(self, names: list, blobs: list) -> None:
        hi, size, slack, band, native = (np.concatenate(c) for c in zip(*self.entries))
        key, entry, flag = (np.concatenate(c) for c in zip(*self.keys))
        self.entries, self.keys = [], []  # what is put together isn't held twice
        bucket = ((key >> U(32)) * U(self.buckets) >> U(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable").astype(np.int32)
        key, entry, flag, bucket = (key[order] & U(0xFFFFFFFF)).astype("<u4"), entry[order], flag[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for lo, up in zip([0, *cuts], [*cuts, len(key)]):
            used, local = np.unique(entry[lo:up], return_inverse=True)
            local = local.astype("<u2" if len(used) < 65536 else "<u4")
            odd = np.flatnonzero(flag[lo:up]).astype("<u4")
            head = np.array([len(used), up - lo, local.itemsize, len(odd)], "<u4")
            parts = [
                head, hi[used].astype("<i8"), size[used].astype("<u4"), slack[used].astype("<i4"), band[used].astype(np.uint8), native[used].astype(np.uint8),
                key[lo:up], local, odd, flag[lo:up][odd],
            ]
            names.append(int(bucket[lo]))
            blobs.append(b"".join(p.tobytes() for p in parts))


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """Per key: key, hi, size, slack, band, native, flag."""
    n, k, width, n_odd = (int(x) for x in np.frombuffer(blob, "<u4", 4))
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    entries = [take("<i8", n), take("<u4", n), take("<i4", n), take("u1", n), take("u1", n)]
    key, local = take("<u4", k), take(f"<u{width}", k)
    odd = take("<u4", n_odd)
    flag = np.zeros(k, np.uint8)
    flag[odd] = take("u1", n_odd)
    return key, *(e[local] for e in entries), flag


def _index(buckets: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordpieces.forget()
        shingle, keys, seen = Shingler(), Keys(buckets, Bands(most)), set()
        sets, ids, held, turn = [], [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = shingle(text.as_py())
                own = identity(tokens) if len(tokens) else (0, 0)
                keys.rows.append((doc_id, len(tokens), *own))
                if not len(tokens) or own in seen:
                    continue
                if len(seen) > MEMORY:
                    seen.clear()
                seen.add(own)
                sets.append(tokens), ids.append(own[0])
                held += len(tokens)
                if held > 200_000:
                    keys.add(sets, np.array(ids, np.int64))
                    sets, ids, held = [], [], 0
                    if keys.n_keys > FLUSH:
                        yield keys.pack(turn)
                        turn += 1
        if sets:
            keys.add(sets, np.array(ids, np.int64))
        yield keys.pack(turn)

    return run


FOUND = pa.schema(
    [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("votes", pa.int64()), ("subset", pa.int64()), ("slack", pa.int32()), ("other", pa.int32()), ("band", pa.int32()), ("native", pa.bool_()), ("size", pa.int64())]
)
FOUND_SQL = "kind int, a long, b long, votes long, subset long, slack int, other int, band int, native boolean, size long"


_NOTHING = tuple(np.zeros(0, t) for t in ("<u4", "<i8", "<u4", "<i4", "u1", "u1", "u1"))


def _grouped(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """Keys that more than one set has, sorted by key, band and set; where groups start, and sizes."""
    k, hi, size, slack, band, native, flag = (np.concatenate(c) for c in zip(*parts))
    del parts
    order = np.argsort(k, kind="stable")
    ks = k[order]
    same = np.concatenate([[False], ks[1:] == ks[:-1]])[: len(k)]
    order = order[same | np.concatenate([same[1:], [False]])[: len(k)]]
    order = order[np.lexsort((flag[order], hi[order], band[order], k[order]))]
    k, hi, size, slack, band, native, flag = (c[order] for c in (k, hi, size, slack, band, native, flag))
    group = (k.astype(U) << U(8)) | band.astype(U)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (hi[1:] != hi[:-1])])[: len(k)]
    k, hi, size, slack, band, native, flag, group = (c[new] for c in (k, hi, size, slack, band, native, flag, group))
    size = size.astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(k)])
    counts = np.diff(np.append(starts, len(k)))
    return k, hi, size, slack, band, native, flag, starts, counts


def _match_tokens(key: tuple, rows: pa.Table) -> pa.Table:
    """Pairs (kind 0) that share rare tokens, and the number of common tokens of a set (4)."""
    k, hi, size, slack, band, native, flag, starts, counts = _grouped([unpack(blob) for blob in rows.column("blob").to_pylist() if blob] or [_NOTHING])
    pairs = []
    for n in range(2, TEAM + 1):
        at = starts[counts == n]
        for i, j in combinations(range(n), 2) if len(at) else ():
            x, y = at + i, at + j
            ok = np.minimum(size[x], size[y]) * DEN >= np.maximum(size[x], size[y]) * NUM
            x, y = x[ok], y[ok]
            pairs.append((hi[x], hi[y], slack[x], slack[y], band[x]))
    node, common = np.unique(hi[np.repeat(counts > TEAM, counts)], return_counts=True)
    zero = np.zeros(len(node), np.int64)
    out = [_counted(0, pairs), [zero.astype(np.int32) + 4, node, zero, common, zero, zero.astype(np.int32), zero.astype(np.int32), zero.astype(np.int32), zero.astype(bool), zero]]
    return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)


def _token_index(buckets: int) -> Callable:
    """The finest partition of the universe: a segment for each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, keys = Shingler(), Keys(buckets, Bands(1))
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = shingle(text.as_py())
                one = np.array([1])
                keys.entries.append((np.array([node], np.int64), one * len(tokens), one * 0, one * 0, one == 1))
                keys.keys.append((mix(tokens), np.full(len(tokens), keys.n_entries), np.zeros(len(tokens), np.uint8)))
                keys.n_entries += 1
                keys.n_keys += len(tokens)
                if keys.n_keys > FLUSH:
                    yield keys.pack(0)
        yield keys.pack(0)

    return run


def _match(key: tuple, rows: pa.Table) -> pa.Table:
    """Pairs (kind 0), members of large subsets (2) and documents (3) of a bucket."""
    parts = [unpack(blob) for blob in rows.column("blob").to_pylist() if blob]
    sets = [pa.ipc.open_stream(x).read_all() for x in rows.column("sets").to_pylist() if x]
    known = _rows_of(sets)
    if not parts:
        return known
    k, hi, size, slack, band, native, flag, starts, counts = _grouped(parts)
    pairs: list[tuple] = []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        ok = (native[i] | native[j]).astype(bool) & (np.minimum(size[i], size[j]) * DEN >= np.maximum(size[i], size[j]) * NUM)
        deleted = (flag[i] & 1) + (flag[j] & 1)
        ok &= (deleted == 0) | ((deleted == 1) & (((flag[i] | flag[j]) & 2) > 0))
        i, j = i[ok], j[ok]
        i, j = np.where(hi[i] < hi[j], i, j), np.where(hi[i] < hi[j], j, i)
        pairs.append((hi[i], hi[j], slack[i], slack[j], band[i]))

    for n in range(2, TEAM + 1):
        at = starts[counts == n]
        if len(at):
            for i, j in combinations(range(n), 2):
                take(at + i, at + j)
    large = counts > TEAM
    member = np.repeat(large, counts)
    out = [_counted(0, pairs)]
    mine = np.flatnonzero(member)
    subset = ((np.int64(key[0].as_py()) << 40) | (k[mine].astype(np.int64) << 8) | band[mine]).astype(np.int64)
    nothing = np.zeros(len(mine), np.int64)
    out.append([np.full(len(mine), 2, np.int32), hi[mine], nothing, nothing, subset, slack[mine].astype(np.int32), nothing.astype(np.int32), band[mine].astype(np.int32), native[mine].astype(bool), size[mine]])
    found = pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)
    return pa.concat_tables([known, found])


def _rows_of(sets: list[pa.Table]) -> pa.Table:
    """Kind 3: hi, lo, n and doc_id of documents, as a, b, votes and subset."""
    if not sets:
        return FOUND.empty_table()
    rows = pa.concat_tables(sets)
    n = rows.num_rows
    none = lambda kind: pa.nulls(n, kind)
    return pa.Table.from_arrays(
        [pa.array(np.full(n, 3, np.int32)), rows["hi"], rows["lo"], rows["n"], rows["doc_id"], none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.bool_()), none(pa.int64())],
        schema=FOUND,
    )


def _counted(kind: int, pairs: list[tuple]) -> list[np.ndarray]:
    a, b, slack, other, band = (np.concatenate(c) for c in zip(*pairs)) if pairs else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((b, a))
    a, b, slack, other, band = (c[order] for c in (a, b, slack, other, band))
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
    votes = np.diff(np.append(starts, len(a)))
    zero = np.zeros(len(starts), np.int64)
    slack, other, band = (c[starts].astype(np.int32) for c in (slack, other, band))
    return [np.full(len(starts), kind, np.int32), a[starts], b[starts], votes, zero, slack, other, band, zero.astype(bool), zero]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    last: tuple[str, np.ndarray] | None = None
    for batch in batches:
        keep = []
        for text_u, text_v in zip(batch.column(2), batch.column(3)):
            v = text_v.as_py()
            if last is None or last[0] != v:
                last = (v, shingle(v))
            a, b = shingle(text_u.as_py()), last[1]
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both > 0 and both * DEN >= NUM * (len(a) + len(b) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", "text_u", "text_v")
    return cut(joined.mapInArrow(_verified, "u long, v long"), name)


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id reachable by links)."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return alone(lambda: _near_duplicates(docs), "near-duplicates")


def _near_duplicates(docs: DataFrame) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    total, most = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    # a shingle takes 2 bytes of text at least, and in prose some 6
    buckets = max(1, -(-int(total) // (6 * BUCKET)))
    packed = docs.mapInArrow(_index(buckets, int(most) // 2 + 1), "bucket int, blob binary, sets binary")
    # a partition for each bucket, so that a task reads one bucket at any size of the input
    found = cut(packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_match, FOUND_SQL), "found")
    sets = found.where("kind = 3").select(F.col("subset").alias("doc_id"), F.col("votes").alias("n"), F.col("a").alias("hi"), F.col("b").alias("lo"))
    classes = cut(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep")), "classes")
    rep = lambda fp, name: classes.select(F.col("hi").alias(fp), F.col("rep").alias(name))
    used = cut(found.where("kind = 2").groupBy("a", "band").agg(F.count(F.lit(1)).alias("used"), F.max("slack").alias("slack"), F.max("size").alias("size")), "used")
    votes = _voted(found, used)
    alike = classes.alias("x").join(classes.alias("y"), F.expr("x.hi = y.hi AND x.lo < y.lo")).select(F.col("x.rep").alias("u"), F.col("y.rep").alias("v"), F.lit(1).alias("votes").cast("long"), F.lit(0).alias("kind"))
    pairs = votes.join(rep("a", "ra"), "a").join(rep("b", "rb"), "b").select(F.least("ra", "rb").alias("u"), F.greatest("ra", "rb").alias("v"), "votes", "kind")
    pairs = cut(pairs.unionByName(alike).where("u <> v"), "pairs")
    members = found.where("kind = 2").join(rep("a", "node"), "a").select("node", "subset", "slack", "band", "native", "size")
    short = used.where("used > slack").join(rep("a", "node"), "a").select("node")
    needed = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).union(short).distinct()
    texts = cut(docs.join(needed, "doc_id", "left_semi"), "texts")

    ends = pairs.select("u", "v", "votes", F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select("u", "v", "votes", F.col("v"), F.col("u")))
    best = ends.groupBy("x").agg(F.max_by("y", F.struct("votes", -F.col("y"))).alias("y")).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    links = _verify(best, texts, "links")
    first = components(links)

    rest = _across(pairs, first).join(best, ["u", "v"], "left_anti")
    second = components(_joined(first, _verify(rest, texts, "more-links")))
    of = second.select("node", "component")
    placed = members.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told, linked = _used_up(placed, texts, int(total))
    told = told.distinct().join(pairs.select("u", "v"), ["u", "v"], "left_anti")
    final = components(_joined(second, _verify(told, texts, "last-links").unionByName(linked)))
    named = classes.join(final, classes["rep"] == final["node"], "left").select("hi", "lo", "n", F.coalesce("component", "rep").alias("component"))
    out = sets.join(named, ["hi", "lo", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    both = pairs.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left")
    return both.where("coalesce(cu, u) <> coalesce(cv, v)").select("u", "v")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    return parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)


def _voted(found: DataFrame, used: DataFrame) -> DataFrame:
    """Pairs of sets with votes. Kind 0 must be verified: linked sets share, beyond what the
    larger subsets may have taken from either, more subsets than the slack of each. Kind 1 may
    be worth verifying: as many votes as a quarter of that, with those of representatives."""
    own = found.where("kind = 0").select("a", "b", "votes", F.col("votes").alias("own"), "band", "slack", "other")
    members = found.where("kind = 2").select("a", "band", "subset").join(used, ["a", "band"])
    # the member that most consists of large subsets is the nearest to a family's middle
    middle = members.groupBy("subset").agg(F.max(F.struct(F.col("used") / F.col("size"), "a", "slack")).alias("m")).select("subset", F.col("m.a").alias("m"), F.col("m.slack").alias("m_slack"))
    star = members.join(middle, "subset").where("a <> m").groupBy("a", "m", "band").agg(F.count(F.lit(1)).alias("votes"), F.max("slack").alias("slack"), F.max("m_slack").alias("m_slack"))
    star = star.select(
        F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b"), "votes", F.lit(0).cast("long").alias("own"), "band",
        F.expr("if(a < m, slack, m_slack)").alias("slack"), F.expr("if(a < m, m_slack, slack)").alias("other"),
    )
    # votes count against the slack of their own band; a pair is taken if any band demands it
    both = own.unionByName(star).groupBy("a", "b", "band").agg(*[f(c).alias(c) for c, f in (("own", F.sum), ("votes", F.sum), ("slack", F.max), ("other", F.max))])
    taken = lambda c: used.select(F.col("a").alias(c), "band", F.col("used").alias(f"used_{c}"))
    both = both.join(taken("a"), ["a", "band"], "left").join(taken("b"), ["b", "band"], "left")
    least = F.expr("1 + greatest(slack - coalesce(used_a, 0), other - coalesce(used_b, 0))")
    kind = F.when((F.col("own") > 0) & (F.col("own") >= least), 0).when(F.expr("4 * votes >= 1 + greatest(slack, other)"), 1)
    return both.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("a", "b").agg(F.sum("votes").alias("votes"), F.min("kind").alias("kind"))


def _used_up(members: DataFrame, texts: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Pairs to verify, and links, among sets whose slack the large subsets of several components
    have used up.

    Their tokens are matched one by one. With r' and s' the tokens of r and s that at most ``TEAM``
    of these sets have, linked sets share s of them, where |r'| + |s'| - 2s is at most their
    difference. Pairs that share no rare token, and have too few to tell, meet through a middle."""
    mixed = members.groupBy("subset").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("subset")
    bad = members.join(mixed, "subset")
    used = bad.groupBy("node", "band").agg(F.count(F.lit(1)).alias("used"), F.max("slack").alias("slack")).where("used > slack").select("node", "band")
    hard = cut(bad.join(used, ["node", "band"]), "hard")
    nodes = hard.groupBy("node").agg(F.max("size").alias("size"), F.max("component").alias("component"))
    asked = texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    buckets = max(1, -(-total // (6 * BUCKET)))
    tokens = asked.mapInArrow(_token_index(buckets), "bucket int, blob binary, sets binary").repartition(buckets, "bucket")
    found = cut(tokens.groupBy("bucket").applyInArrow(_match_tokens, FOUND_SQL), "found-tokens")
    common = found.where("kind = 4").groupBy(F.col("a").alias("node")).agg(F.sum("votes").alias("common"))
    # DEN + NUM times the rare tokens, less DEN - NUM times all: what a pair must have above 0 together
    rare = nodes.join(common, "node", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    rare = cut(rare.withColumn("surplus", F.expr(f"{DEN + NUM} * (size - common) - {DEN - NUM} * size")).select("node", "component", "surplus", "size", "common"), "rare")
    of = lambda c: rare.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"), F.col("surplus").alias(f"s{c}"))
    votes = found.where("kind = 0").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("votes").alias("votes"))
    told = votes.join(of("u"), "u").join(of("v"), "v").where(f"cu <> cv AND {2 * (DEN + NUM)} * votes >= su + sv").select("u", "v")
    told = told.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return told, _through_middles(hard, rare, texts)


def _through_middles(hard: DataFrame, rare: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among sets that share no rare token, each described by its difference from a middle.

    The middle p of a subset is the member with the largest share of common tokens. With
    a = |p - x|, and c common tokens of x outside p, x and y share |p| - |(p - x) + (p - y)| tokens
    of p and at most min(c, c') others, so x can be linked with sets of at most ``reach`` tokens
    (scaled by NUM) alone. Where substituted copies are as long as their middle, hardly any
    but those linked with the middle itself is in reach of another. Sets within each other's
    reach are compared in blocks, as bits over the middle's tokens; a pair of blocks gives no
    pairs but a forest of links."""
    place = hard.select("subset", "node").distinct().join(rare, "node")
    middle = place.groupBy("subset").agg(F.max_by("node", F.struct(F.col("common") / F.col("size"), -F.col("node"))).alias("middle"), F.min("surplus").alias("least"))
    # only pairs whose surplus is 0 or less together are left; one of a set and its middle at least
    asked = place.join(middle, "subset").where("surplus + least <= 0").select("node", "middle").distinct()
    of = lambda c: rare.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("size", "common", "component")])
    text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    rows = asked.join(of("node"), "node").join(of("middle"), "middle").join(text("node"), "node").join(text("middle"), "middle")
    rows = rows.select("node", "middle", "node_component", "middle_component", "node_common", (F.col("middle_size") - F.col("middle_common")).alias("middle_rare"), "text_node", "text_middle")
    apart = cut(rows.mapInArrow(_differences, DIFFERENCE_SQL), "differences")
    outer = F.col("component") != F.col("middle_component")
    for _ in range(2):
        # a set of the middle's component needs a partner in another, others need any
        most = apart.groupBy("middle").agg(
            F.min("size").alias("s"), F.max("reach").alias("r"), F.min(F.when(outer, F.col("size"))).alias("so"), F.max(F.when(outer, F.col("reach"))).alias("ro")
        )
        apart = apart.join(most, "middle").where(F.expr(f"if(component <> middle_component, {NUM} * s <= reach AND {NUM} * size <= r, {NUM} * so <= reach AND {NUM} * size <= ro)")).drop("s", "r", "so", "ro")
    apart = cut(apart, "within-reach")
    blocks = apart.groupBy("middle").agg(F.ceil(F.count(F.lit(1)) / F.lit(TOGETHER)).cast("int").alias("blocks"))
    dealt = apart.join(blocks, "middle").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("middle", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "component", "size", "missing", "extra")
    return cut(dealt.groupBy("middle", "one", "two").applyInArrow(_linked, "u long, v long"), "middle-links")


DIFFERENCE_SQL = "node long, middle long, component long, middle_component long, size long, reach long, missing binary, extra binary"


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets by their difference from a middle: which of its tokens they lack, and their others."""
    shingle, last = Shingler(), ("", np.zeros(0, U))
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for common, rare, text, middle in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6, 7))):
            if last[0] != middle:
                last = (middle, shingle(middle))
            own, p = shingle(text), last[1]
            missing = ~np.isin(p, own, assume_unique=True)
            extra = own[~np.isin(own, p, assume_unique=True)]
            shared = len(own) - len(extra)
            others = min(len(extra), common - shared + rare)
            for column, value in zip(out, (len(own), (DEN + NUM) * (shared + others) - NUM * len(own), np.packbits(missing).tobytes(), extra.tobytes())):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.record_batch([*batch.columns[:4], *(pa.array(c, t) for c, t in zip(out, kinds))], names=["node", "middle", "component", "middle_component", "size", "reach", "missing", "extra"])


def _linked(key: tuple, rows: pa.Table) -> pa.Table:
    """A forest of the links between two blocks of sets with one middle, across components."""
    one, two = key[1].as_py(), key[2].as_py()
    node, component, size, own = (rows.column(c).to_numpy() for c in ("node", "component", "size", "own"))
    lacks = np.stack([np.frombuffer(b, np.uint8) for b in rows.column("missing").to_pylist()])
    extras = [np.frombuffer(b, U) for b in rows.column("extra").to_pylist()]
    n_extra = np.array([len(e) for e in extras])
    held = size - n_extra
    root = {c: c for c in component.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    left, right, links = np.flatnonzero(own == one), np.flatnonzero(own == two), []
    for i in left:
        both = np.bitwise_count(lacks[right] & lacks[i]).sum(axis=1, dtype=np.int64)
        # what both hold of the middle: what i holds, less what the other lacks and i doesn't
        inside = held[i] - (np.bitwise_count(lacks[right]).sum(axis=1, dtype=np.int64) - both)
        need = NUM * (size[i] + size[right])
        near = (DEN + NUM) * (inside + np.minimum(n_extra[i], n_extra[right])) >= need
        for k in np.flatnonzero(near & (component[right] != component[i])):
            j = right[k]
            a, b = top(component[i]), top(component[j])
            if a != b and (DEN + NUM) * (inside[k] + len(np.intersect1d(extras[i], extras[j], assume_unique=True))) >= need[k]:
                root[a] = b
                links.append((int(node[i]), int(node[j])))
    return pa.table({"u": pa.array([min(x) for x in links], pa.int64()), "v": pa.array([max(x) for x in links], pa.int64())})


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
