"""SimHash near-duplicates: fingerprints of 64 bits, linked where few bits differ, by BK-trees.

Fingerprints are made in one pass over the texts. Equal fingerprints are one node from then on.
With a radius of R differing bits, two linked fingerprints are equal in one of R + 1 bands of bits
at least: the nodes with the same bits in one band are a shard. Shards are dealt in pieces of at
most some ``PIECE`` nodes, so a hot band fills many pieces and no task.

Each piece is grown into a BK-tree: its least fingerprint is the root, the others hang below it by
their Hamming distance to it, and so on in each child's own group. The trees of a task grow
together, a level at a time. Each piece is also a block of queries. A tree meets every block
of its shard that doesn't come before its own piece, and a search follows from a node at distance d
only edges d - R to d + R, for all queries of a chunk together. What a chunk finds is joined up in
place, so a family of any size gives each of its members one link for each tree and block it is in.

Trees are sent to the blocks of their shard and no further, by a shuffle: broadcasting
them to all would take every document's fingerprint through the driver.

Defined results: words are lowered as ASCII and split at ASCII white space; a null, empty or blank
text has fingerprint zero, linked like any other; fewer words than a shingle's are one
shingle; repeated rows are copies; rows that share an id are each linked by their own text; a row
without an id has a fingerprint and links like others but gives its component no name, and a
component without any id is null; texts of any length are read whole; an empty table gives an
empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliosift.llm.buffers import LOWER, SPACE, in_slices, utf8, words
from foliosift.llm.common import alone, cut, table
from foliosift.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Bytes of text, nodes of a piece, and pairs of query and node that are handled at once.
TOGETHER, PIECE, PAIRS = 1 << 20, 16_384, 1 << 20
#: A fingerprint that this share of all rows has is looked up in a broadcast; fewer than its inverse can be such.
HOT = 1000
U = np.uint64


def fingerprints(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of each row: a bit is set if more than half of the shingles' hashes have it."""
    kept, starts, first = words(LOWER[data], at)
    # each word and the space behind it
    n = len(starts) - 1
    spaced = np.full(len(kept) + n, 0x20, np.uint8)
    spaced[np.arange(len(kept)) + np.repeat(np.arange(n), np.diff(starts))] = kept
    begin = starts[:-1] + np.arange(n)
    end = starts[1:] + np.arange(n)
    count = np.diff(first)
    shingles = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    rows = np.repeat(np.arange(len(count)), shingles)
    one = np.arange(len(rows)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[:-1][rows]
    last = np.minimum(one + shingle, first[1:][rows]) - 1
    raw, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(begin[one].tolist(), end[last].tolist())], U)
    out = np.zeros(len(count), U)
    full = np.flatnonzero(shingles)
    if len(full):
        ends = np.cumsum(shingles)[full]
        for low in range(0, 64, 8):  # a byte of the hashes at a time
            bits = np.unpackbits(((hashes >> U(low)) & U(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            have = np.add.reduceat(bits, ends - shingles[full], axis=0, dtype=np.int64)
            most = np.packbits(2 * have > shingles[full][:, None], axis=1, bitorder="little")[:, 0]
            out[full] |= most.astype(U) << U(low)
    return out


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 1, TOGETHER):
        yield pa.record_batch([batch.column(0), pa.array(fingerprints(*utf8(batch.column(1))).view(np.int64))], names=["doc_id", "print"])


class Forest:
    """BK-trees of groups of fingerprints: ``value`` by node, ``edge`` its distance to its parent;
    the children of node i are nodes ``low[i]`` to ``high[i]``, by distance. Roots come first."""

    def __init__(self, value: np.ndarray, edge: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.value, self.edge, self.low, self.high = value, edge, low, high

    @classmethod
    def grow(cls, values: np.ndarray, group: np.ndarray) -> Forest:
        """One tree for each number in ``group``; the first of a group becomes its root."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        parent, edge, done = group, np.zeros(len(values), np.int64), 0
        while len(values):
            # the group below one edge of one parent: its first is that child, the rest hang below it
            order = np.lexsort((np.arange(len(values)), edge, parent))
            values, parent, edge = values[order], parent[order], edge[order]
            head = np.append(True, (parent[1:] != parent[:-1]) | (edge[1:] != edge[:-1]))
            node = np.cumsum(head) - 1
            parts.append((values[head], edge[head], parent[head]))
            rest = ~head
            up = values[head][node[rest]]
            values, parent = values[rest], done + node[rest]
            edge, done = np.bitwise_count(values ^ up).astype(np.int64), done + int(head.sum())
        value, edge, parent = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        trees = len(parts[0][0]) if parts else 0
        # nodes stand level by level and by parent, so each node's children are next to each other
        below = parent[trees:]
        low = trees + np.searchsorted(below, np.arange(len(value)), side="left")
        high = trees + np.searchsorted(below, np.arange(len(value)), side="right")
        return cls(value.astype(U), edge.astype(np.int64), low, high)

    def within(self, query: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of the query, node) within the radius, for queries that start at a root
        each. Only edges within the radius of a node's distance are followed."""
        waiting = [(np.arange(len(query)), root)]
        while waiting:
            q, node = waiting.pop()
            if len(q) > PAIRS:
                waiting += [(q[i : i + PAIRS], node[i : i + PAIRS]) for i in range(0, len(q), PAIRS)]
                continue
            apart = np.bitwise_count(query[q] ^ self.value[node]).astype(np.int64)
            near = apart <= radius
            yield q[near], node[near]
            children = self.high[node] - self.low[node]
            # a node has at most 64 children, one at each distance
            many = np.repeat(np.arange(len(q)), children)
            child = np.arange(len(many)) - np.repeat(np.cumsum(children) - children, children) + self.low[node][many]
            follow = np.abs(self.edge[child] - apart[many]) <= radius
            if follow.any():
                waiting.append((q[many[follow]], child[follow]))


class Links:
    """A forest of links among values, joined up as pairs come."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.root = np.arange(len(self.values))

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        a, b = np.searchsorted(self.values, u), np.searchsorted(self.values, v)
        while True:
            a, b = self.root[a], self.root[b]
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            if not len(a):
                return
            np.minimum.at(self.root, b, a)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.values[own], self.values[self.root[own]]


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces as trees: the nodes of each row's tree in the order of a ``Forest`` of its own."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("nodes"))
        size = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1])
        forest = Forest.grow(lists.flatten().to_numpy().view(U), np.repeat(np.arange(len(size)), size))
        # the tree of each node, by its parent's
        tree = np.zeros(len(forest.value), np.int64)
        trees = int((size > 0).sum())
        tree[:trees] = np.flatnonzero(size)
        parent = np.repeat(np.arange(len(forest.value)), forest.high - forest.low)
        level = np.arange(trees)
        while len(level):
            below = np.flatnonzero(np.isin(parent, level)) + trees
            tree[below] = tree[parent[below - trees]]
            level = below
        by = np.argsort(tree, kind="stable")
        own = np.argsort(by)  # where each node goes
        base = (np.cumsum(size) - size)[tree]
        move = lambda x: np.append(own, len(own))[np.minimum(x, len(own) - 1)]
        low = np.where(forest.high > forest.low, move(forest.low) - base, 0)[by]
        n = (forest.high - forest.low)[by]
        as_lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(x, t))
        yield pa.record_batch(
            [*(batch.column(c) for c in ("shard", "piece")), as_lists(forest.value[by].view(np.int64), pa.int64()), as_lists(forest.edge[by], pa.int8()), as_lists(low, pa.int32()), as_lists(n, pa.int8())],
            names=["shard", "piece", "value", "edge", "low", "children"],
        )


TREE = "shard int, piece int, value array<long>, edge array<tinyint>, low array<int>, children array<tinyint>"


def _searched(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            start, sizes = 0, np.array([len(x) + len(y) for x, y in zip(whole.column(0), whole.column(4))])
            while start < whole.num_rows:
                end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), 4 * PIECE, side="right")))
                batch, start = whole.slice(start, end - start), end
                flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(5)]
                count = lambda i: np.array([len(x) for x in batch.column(i)])  # noqa: E731, B023
                tree, asked = count(0), count(4)
                root = np.cumsum(tree) - tree
                low = flat[2] + np.repeat(root, tree)
                forest = Forest(flat[0].view(U), flat[1].astype(np.int64), low, low + flat[3])
                query = flat[4].view(U)
                links = Links(np.concatenate([forest.value, query]))
                for q, node in forest.within(query, np.repeat(root, asked), radius):
                    links.add(query[q], forest.value[node])
                u, v = links.pairs()
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return run


def linked(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between distinct fingerprints (column ``print``) that join what differs in at most ``radius`` bits."""
    bounds = [64 * i // (radius + 1) for i in range(radius + 2)]
    bands = F.array(*[
        F.struct(F.expr(f"int({i} + {radius + 1} * (shiftrightunsigned(print, {low}) & {(1 << (high - low)) - 1}L))").alias("shard"))
        for i, (low, high) in enumerate(zip(bounds, bounds[1:]))
    ])
    entries = prints.select("print", F.explode(bands).alias("b")).select("print", "b.shard")
    # shards are as many as a band's bits allow, whatever the input
    shards = entries.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(PIECE)).cast("int").alias("pieces")).where("pieces > 1")
    dealt = entries.join(F.broadcast(shards), "shard", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("print"), F.col("pieces")).cast("int"))
    blocks = cut(dealt.groupBy("shard", "piece").agg(F.first("pieces").alias("pieces"), F.sort_array(F.collect_list("print")).alias("nodes")).where("pieces > 1 OR size(nodes) > 1"), "blocks")
    trees = blocks.select("shard", "piece", "nodes").mapInArrow(_grown, TREE).join(F.broadcast(shards), "shard", "left")
    meets = trees.withColumn("block", F.explode(F.sequence("piece", F.coalesce("pieces", F.lit(1)) - 1)))
    queries = blocks.select(F.col("shard").alias("s"), F.col("piece").alias("block"), "nodes")
    pairs = meets.join(queries, (meets["shard"] == queries["s"]) & (meets["block"] == queries["block"]))
    return pairs.select("value", "edge", "low", "children", "nodes").mapInArrow(_searched(radius), "u long, v long")


def simhash_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least id reachable by links)."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return alone(lambda: _duplicates(texts, radius), "simhash")


def _duplicates(texts: DataFrame, radius: int) -> DataFrame:
    prints = cut(texts.mapInArrow(_printed, "doc_id long, print long"), "prints")
    nodes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")), "nodes")
    found = components(linked(nodes.select("print")))
    ids = found.join(nodes.select(F.col("print").alias("node"), F.col("node").alias("id")), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    joined = found.join(ids, "component").select(F.col("node").alias("print"), "component_id")
    # the ids of a component are all null if its least is
    least = cut(nodes.select("print", "node").join(joined, "print", "left").select("print", F.coalesce("component_id", "node").alias("component_id")), "least")
    hot = cut(nodes.where(F.col("rows") > max(1, prints.count() // HOT)).select("print").join(least, "print"), "hot")
    at_hot = prints.join(F.broadcast(hot), "print")
    others = prints.join(F.broadcast(hot.select("print")), "print", "left_anti").join(least, "print")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return at_hot.unionByName(others).select("doc_id", digits.alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))
