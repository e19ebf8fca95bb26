"""Resharding by minimum-cost flow.

Rows lie in old shards; new capacities are equal. Blocks are the rows of an old shard
whose texts share a hash bucket, so equal texts move together. A bucket that holds more
than a shard is cut by a second hash of the text; only a text whose own rows are more
than a shard holds is dealt by id into ``PARTS`` blocks. A flow network joins each old
shard with each new one, at no cost to stay and one per byte to move, and its
minimum-cost flow says how many bytes go where. The blocks of a shard go only to the
ends of its own flows, the largest first to the end that lacks most, then single blocks
move or change places while that brings the sizes nearer. So no shard both sends and
receives, and for the sizes reached no fewer bytes can move. Only shards with a transfer
are rewritten.

The plan holds sums per block: ``old shards * buckets`` rows and ``PARTS`` for each of the
texts and buckets that are cut, which are fewer than shards. Rows are never gathered:
slots are a running sum over blocks plus a row number within one.

Defined results: a null text has no bytes, so size 1, and is equal to an empty one; repeated
rows are rows of their own; a null id is kept, and rows of one text without an id are one block; equal rows are numbered
in any order; an empty table gives an empty result; other columns of the input stay with its rows,
and one named like an added column is replaced by it.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliosift.llm.common import table

#: Blocks that a text or bucket too large for a shard is dealt into; most rounds of bringing sizes nearer.
PARTS, ROUNDS = 256, 50
ADDED = ["size", "text_crc32", "old_shard", "shard", "slot"]


def least_moves(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Successive shortest paths with potentials: flow[(old, new)] of least total cost.
    ``cost(i, j)`` is the cost of a unit; the capacities together hold the supply."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(u: int, v: int, room: int, price: int) -> None:
        graph[u].append([v, room, price, len(graph[v])])
        graph[v].append([u, 0, -price, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    left, potential = sum(supply), [0] * (n + m + 2)
    if left > sum(capacity):
        raise ValueError("the new shards can't hold all rows")
    while left:
        dist, before = [float("inf")] * len(graph), [None] * len(graph)
        dist[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, room, price, _) in enumerate(graph[u]):
                if room and (nd := d + price + potential[u] - potential[v]) < dist[v]:
                    dist[v], before[v] = nd, (u, k)
                    heapq.heappush(heap, (nd, v))
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, dist)]
        push, v = left, sink
        while v != source:
            u, k = before[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = before[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
        left -= push
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1]}


def place_blocks(blocks: list[tuple[int, int, int]], shards: int) -> dict[tuple[int, int], int]:
    """(old, part) -> new shard, for blocks (old, part, bytes). Capacities are equal."""
    total = sum(b[2] for b in blocks)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    olds = sorted({b[0] for b in blocks})
    supply = [sum(b[2] for b in blocks if b[0] == o) for o in olds]
    flow = least_moves(supply, capacity, lambda i, j: 0 if olds[i] == j else 1)
    ends = {o: [j for (i, j) in flow if olds[i] == o] for o in olds}
    lacks = {(olds[i], j): x for (i, j), x in flow.items()}
    held: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for old, part, size in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        j = max(ends[old], key=lambda s: (lacks[old, s], s == old, -s))
        lacks[old, j] -= size
        held.setdefault((old, j), []).append((size, part))
    room = [sum(x for (_, s), x in lacks.items() if s == j) for j in range(shards)]
    for _ in range(ROUNDS):
        if not any(_improve(held, old, one, two, room) for old in olds for one in ends[old] for two in ends[old] if one != two):
            break
    return {(old, part): j for (old, j), own in held.items() for _, part in own}


def _improve(held: dict, old: int, one: int, two: int, room: list[int]) -> bool:
    """Moves a block of an old shard from one end to another, or changes two, where that brings
    the rooms of both nearer to each other; says whether it did."""
    gap = room[two] - room[one]  # what the second lacks more than the first
    if gap < 2:
        return False
    theirs = sorted(held.get((old, two), []))
    sizes, best = [b[0] for b in theirs], None
    for block in held.get((old, one), []):
        at = bisect_left(sizes, block[0] - gap / 2)
        for other in (None, *theirs[max(0, at - 1) : at + 1]):
            by = block[0] - (other[0] if other else 0)
            if 0 < by < gap and (best is None or abs(gap - 2 * by) < best[0]):
                best = (abs(gap - 2 * by), by, block, other)
    if best is None:
        return False
    _, by, block, other = best
    held[old, one].remove(block)
    held.setdefault((old, two), []).append(block)
    if other:
        held[old, two].remove(other)
        held[old, one].append(other)
    room[one], room[two] = room[one] + by, room[two] - by
    return True


def _parts(rows: DataFrame, shards: int, buckets: int) -> tuple[DataFrame, list]:
    """rows with the column part, and (old, part, bytes, n) of each block."""
    sums = lambda df: df.groupBy("old", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    rows = rows.withColumn("part", F.pmod("hash", F.lit(buckets)).cast("int"))
    blocks = sums(rows)
    total = sum(r["bytes"] for r in blocks)
    large = [(r["old"], r["part"]) for r in blocks if r["bytes"] * shards > total]  # fewer than shards
    if not large or shards < 2:
        return rows, blocks
    inside = lambda keys: reduce(or_, [(F.col("old") == o) & (F.col("part") == p) for o, p in keys], F.lit(False))
    texts = rows.where(inside(large)).groupBy("old", "hash", "text_crc32").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * shards > total).collect()
    same = reduce(or_, [(F.col("old") == t["old"]) & (F.col("hash") == t["hash"]) & (F.col("text_crc32") == t["text_crc32"]) for t in texts], F.lit(False))
    # after the buckets, PARTS numbers for each text that no shard holds, and for each bucket that is cut
    by_text = F.lit(None).cast("int")
    for i, t in enumerate(texts):
        by_text = F.when((F.col("old") == t["old"]) & (F.col("hash") == t["hash"]) & (F.col("text_crc32") == t["text_crc32"]), buckets + i * PARTS + F.pmod(F.xxhash64("id", F.lit("by id")), F.lit(PARTS)).cast("int")).otherwise(by_text)
    by_bucket = F.lit(None).cast("int")
    for i, (o, p) in enumerate(large, len(texts)):
        by_bucket = F.when((F.col("old") == o) & (F.col("part") == p), buckets + i * PARTS + F.pmod(F.xxhash64("hash", "text_crc32", F.lit("again")), F.lit(PARTS)).cast("int")).otherwise(by_bucket)
    rows = rows.withColumn("part", F.when(same, by_text).otherwise(F.coalesce(by_bucket, "part")))
    return rows, sums(rows)


def reshard(docs: DataFrame, old_shard, shards: int, *, id_column: str = "doc_id", text_column: str = "text", buckets: int = 4096) -> DataFrame:
    """docs with size, text_crc32, old_shard, shard and slot (gapless from 0 in each shard)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.col(id_column).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hash"), old_shard.cast("int").alias("old"))
    rows, blocks = _parts(rows, shards, buckets)
    placed = place_blocks([(r["old"], r["part"], r["bytes"]) for r in blocks], shards)
    begins, plan = [0] * shards, []
    for r in sorted(blocks, key=lambda r: (r["old"], r["part"])):
        j = placed[r["old"], r["part"]]
        plan.append((r["old"], r["part"], j, begins[j]))
        begins[j] += r["n"]
    # old shards * buckets rows and PARTS for each text or bucket that is cut, whatever the input
    plan_df = docs.sparkSession.createDataFrame(plan, "old int, part int, shard int, begin long")
    within = Window.partitionBy("old", "part").orderBy("id", "hash")
    out = rows.join(F.broadcast(plan_df), ["old", "part"]).withColumn("slot", F.col("begin") + F.row_number().over(within) - 1)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED]
    return out.select(*kept, "size", "text_crc32", F.col("old").alias("old_shard"), "shard", "slot")


def rewrite(resharded: DataFrame, path: str, *, rows_per_file: int = 1_000_000) -> list[int]:
    """Writes the shards that a transfer touches, old and new, under ``path`` as shard=N, in files of
    at most so many rows; the others' files stay as they are. Returns the shards written."""
    moved = resharded.where("old_shard <> shard").select("old_shard", "shard").distinct().collect()
    touched = sorted({s for r in moved for s in (r["old_shard"], r["shard"])})
    files = resharded.where(F.col("shard").isin(touched)).repartition("shard", F.floor(F.col("slot") / rows_per_file))
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
    return touched


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six old shards by text hash become eight of near equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = reshard(docs, F.pmod(F.crc32(F.coalesce("text", F.lit(""))), F.lit(6)), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
