"""How many tokens a corpus has, and where."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliosift.packaged import ship

# Bounds of the two histograms, and the limits that are counted.
SMALL = [50, 100, 200, 300, 400, 500, 1000]
LARGE = [1000, 2000, 5000, 10000, 20000, 50000]
#: Buckets of a pass of a selection; how far from the middle a sketch's bounds are; groups whose bounds are broadcast.
BUCKETS, SLACK, GROUPS = 1024, 0.02, 100_000


def stats(rows: DataFrame, measure: str = "tokens") -> DataFrame:
    c = F.col(measure)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.max(c).alias("most"), F.min(c).alias("least"), F.percentile(c, 0.5).alias("median"))


def exactly_counted(rows: DataFrame, column: str, tokenizer: Callable[[], Callable[[str], list]]) -> DataFrame:
    """rows with ``tokens``, the exact count of an injected tokenizer: ``tokenizer()`` is called once
    per task and returns what turns a text into tokens. Null and empty texts have none."""

    ship(rows.sparkSession)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer()
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return rows.withColumn("tokens", F.pandas_udf(count, "long")(F.col(column)))


def histogram(rows: DataFrame, bounds: list[int], measure: str = "tokens") -> DataFrame:
    """bucket, low, high, n and pct; buckets without rows are there, with 0."""
    edges = [*zip([0, *[b + 1 for b in bounds]], bounds), (bounds[-1] + 1, None)]
    buckets = rows.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(edges)], "bucket int, low long, high long")
    at: Column = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        at = F.when(F.col(measure) <= bounds[i], i).otherwise(at)
    n = rows.groupBy(at.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    full = buckets.join(F.broadcast(n), "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("pct", F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy(F.lit(0))))


def over_limits(rows: DataFrame, limits: list[int], measure: str = "tokens") -> DataFrame:
    return rows.agg(*[F.count_if(F.col(measure) > x).alias(f"over_{x}") for x in limits])


def per_document(sections: DataFrame, measure: str = "tokens") -> DataFrame:
    return sections.groupBy("document_source", "document_name").agg(F.count(F.lit(1)).alias("sections"), F.sum(measure).alias("tokens"))


def largest(rows: DataFrame, measure: str, key: str, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc(measure), F.asc(key)).limit(n)


def top_sums(rows: DataFrame, ks: list[int], measure: str = "tokens", key: str = "id") -> DataFrame:
    """Sum of the k largest, for each k: only the largest max(k) rows are kept and ordered."""
    few = rows.select(measure, key).orderBy(F.desc(measure), F.asc(key)).limit(max(ks))
    order = Window.orderBy(F.desc(measure), F.asc(key))
    run = few.withColumn("k", F.row_number().over(order)).withColumn("total", F.sum(measure).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("k").isin(ks)).select(F.col("k").cast("long").alias("k"), "total")


def values_at(rows: DataFrame, measure: str, ranks: list[int]) -> dict[int, tuple[int, int]]:
    """Of each rank, from 1 for the largest, the value of a whole-numbered measure there, and how many
    rows have a larger one. Ranks beyond the rows are left out; so are null measures.

    Each pass counts rows in at most ``BUCKETS`` buckets of each value range that still holds a
    rank, and narrows it to a bucket: two or three passes over one column, whatever the size, with
    partial counts before the shuffle. Nothing is sorted."""
    n, least, most = rows.agg(F.count(measure), F.min(measure), F.max(measure)).first()
    open_, found = {r: (least, most, 0) for r in set(ranks) if 1 <= r <= n}, {}
    while open_:
        spans = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        place = F.lit(None)
        for i, (lo, hi) in enumerate(spans):
            width = (hi - lo) // BUCKETS + 1
            place = F.when(F.col(measure).between(lo, hi), F.struct(F.lit(i).alias("span"), F.expr(f"(`{measure}` - {lo}L) div {width}L").alias("bucket"))).otherwise(place)
        counts = rows.where(" OR ".join(f"`{measure}` BETWEEN {lo} AND {hi}" for lo, hi in spans)).groupBy(place.alias("p")).count()
        held: dict[int, list[tuple[int, int]]] = {}
        for r in counts.collect():  # BUCKETS a span at most
            held.setdefault(r["p"]["span"], []).append((r["p"]["bucket"], r["count"]))
        for rank, (lo, hi, above) in list(open_.items()):
            width = (hi - lo) // BUCKETS + 1
            for bucket, count in sorted(held[spans.index((lo, hi))], reverse=True):
                if above + count >= rank:
                    break
                above += count
            open_[rank] = (lo + bucket * width, min(hi, lo + (bucket + 1) * width - 1), above)
            if width == 1:
                found[rank] = (open_[rank][0], above)
                del open_[rank]
    return found


def middle_and_bottom(rows: DataFrame, measure: str = "tokens", n: int = 10) -> DataFrame:
    """Sums of the middle and of the last n rows by size; null below n rows. The values at both ends of
    each stretch are selected; then the few values between them are counted."""
    total = rows.count()
    stretches = {"middle": (max(0, total // 2 - n // 2), n), "bottom": (total - n, n)} if total >= n else {}
    ends = values_at(rows, measure, [r for start, k in stretches.values() for r in (start + 1, start + k)])
    sums = []
    for name in ("middle", "bottom"):
        if name not in stretches or stretches[name][0] + n not in ends:
            sums.append(F.lit(None).cast("long").alias(name))
            continue
        start = stretches[name][0]
        (high, above), (low, below) = ends[start + 1], ends[start + n]
        # rows between the end values all count; of those at an end value as many as the stretch reaches
        between = F.coalesce(F.sum(F.when((F.col(measure) < high) & (F.col(measure) > low), F.col(measure))), F.lit(0))
        inner = F.count_if((F.col(measure) < high) & (F.col(measure) > low))
        at_low = start + n - below if high != low else n
        sums.append((between + F.lit(low * at_low) + F.lit(high) * (F.lit(n - at_low) - inner) if high != low else F.lit(high * n)).cast("long").alias(name))
    return rows.agg(*sums, F.count(F.lit(1)).alias("_n")).drop("_n")


def medians(rows: DataFrame, by: str, measure: str) -> DataFrame:
    """by, n and the exact median of a whole-numbered measure in each group, nulls left out.

    A mergeable sketch of each group gives values between which the median is all but sure to
    be; rows below and between them are counted by value. Where a sketch was wrong, the counts tell,
    and the group is counted by value as a whole. No group is sorted or gathered."""
    known = rows.where(F.col(measure).isNotNull()).select(by, F.col(measure).cast("long").alias("v"))
    sketched = known.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.kll_sketch_agg_bigint("v").alias("sketch"))
    at = lambda q: F.kll_sketch_get_quantile_bigint("sketch", F.lit(q))
    bounds = sketched.select(F.col(by).alias("_by"), "n", at(0.5 - SLACK).alias("low"), at(0.5 + SLACK).alias("high"), "least", "most")

    def tried(groups: DataFrame, low: str, high: str) -> DataFrame:
        groups = F.broadcast(groups) if groups.count() <= GROUPS else groups
        near = known.join(groups, F.col(by).eqNullSafe(F.col("_by"))).where(F.col("v") <= F.col(high))
        inside = F.when(F.col("v") >= F.col(low), F.col("v"))
        counts = near.groupBy("_by", "n", inside.alias("v")).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy("_by").orderBy(F.col("v").asc_nulls_first()))
        # of n values the ones at (n + 1) div 2 and n div 2 + 1
        place = lambda k: F.min(F.when((F.col("upto") >= k) & F.col("v").isNotNull() & (F.col("upto") - F.col("c") < k), F.col("v")))
        return counts.withColumn("upto", upto).groupBy("_by", "n").agg(place(F.expr("(n + 1) div 2")).alias("a"), place(F.expr("n div 2 + 1")).alias("b"))

    first = tried(bounds, "low", "high")
    told = first.where("a IS NOT NULL AND b IS NOT NULL")
    missed = bounds.join(told.select(F.col("_by").alias("_told"), F.lit(True).alias("_yes")), F.col("_by").eqNullSafe(F.col("_told")), "left").where("_yes IS NULL").select(bounds.columns)
    done = told if missed.isEmpty() else told.unionByName(tried(missed, "least", "most"))
    return done.select(F.col("_by").alias(by), "n", ((F.col("a") + F.col("b")) / F.lit(2.0)).alias("median"))


def rescaled(sampled: DataFrame, all_rows: DataFrame, tokens: str, chars: str) -> DataFrame:
    """Tokens per character in one table, applied to the characters of another."""
    ratio = sampled.agg((F.sum(tokens) / F.sum(chars)).alias("ratio"))
    total = all_rows.agg(F.sum(chars).alias("chars"))
    return total.join(F.broadcast(ratio)).select("ratio", "chars", F.floor(F.col("chars") * F.col("ratio")).cast("long").alias("tokens"))


def bottom_k(rows: DataFrame, stratum: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """A sample of at most k rows of each stratum: those whose keys hash least. It is the same in any
    partitioning, the samples of parts merge into the whole's, and Spark keeps k rows of each
    stratum and task before the shuffle. Rows that share a key stand or fall by their other columns' order: keys should differ."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    least = Window.partitionBy(stratum).orderBy("_place", key)
    return rows.withColumn("_place", place).withColumn("_rank", F.row_number().over(least)).where(F.col("_rank") <= k).drop("_place", "_rank")


def ratio_of_sample(rows: DataFrame, stratum: str, key: str, tokens: str, chars: str, k: int, seed: int = 0) -> DataFrame:
    """One row: the estimated tokens per character, its standard error, the interval that holds the
    true ratio in about 95 of 100 samples, characters, and the estimated tokens with their bounds.
    ``tokens`` is read in the sample alone.

    The combined ratio of a stratified sample: sums of tokens and of characters are scaled up by each
    stratum's share and divided; the error comes from what the ratio leaves unexplained in each stratum,
    with the correction for strata of which much is in the sample. A stratum sampled by one row
    out of several tells no spread; it counts with its row's own square."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars"))
    sample = bottom_k(rows.select(stratum, key, tokens, chars), stratum, key, k, seed)
    t, c = F.col(tokens).cast("double"), F.col(chars).cast("double")
    sums = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("m"), F.sum(t).alias("t"), F.sum(c).alias("c"), F.sum(t * t).alias("tt"), F.sum(c * c).alias("cc"), F.sum(t * c).alias("tc"))
    both = sizes.withColumnRenamed(stratum, "_s").join(sums, F.col("_s").eqNullSafe(F.col(stratum)))
    up = F.col("n") / F.col("m")
    whole = both.agg((F.sum(up * F.col("t")) / F.sum(up * F.col("c"))).alias("ratio"), F.sum(up * F.col("c")).alias("scaled"), F.sum("chars").cast("long").alias("all_chars"))
    r = F.col("ratio")
    left = F.col("tt") - 2 * r * F.col("tc") + r * r * F.col("cc")  # squares of what the ratio leaves
    mean = (F.col("t") - r * F.col("c")) / F.col("m")
    spread = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), left - F.col("m") * mean * mean) / (F.col("m") - 1)).otherwise(left)
    # one row, of sums
    error = both.join(F.broadcast(whole)).agg(F.first("ratio").alias("ratio"), F.first("all_chars").alias("chars"), (F.sqrt(F.sum(F.col("n") * (F.col("n") - F.col("m")) * spread / F.col("m"))) / F.first("scaled")).alias("error"))
    low, high = r - F.lit(1.96) * F.col("error"), r + F.lit(1.96) * F.col("error")
    count = lambda x: F.floor(F.col("chars") * x).cast("long")
    return error.select("ratio", "error", low.alias("low"), high.alias("high"), "chars", count(r).alias("tokens"), count(low).alias("tokens_low"), count(high).alias("tokens_high"))
