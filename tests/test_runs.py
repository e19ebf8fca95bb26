"""Stages of many runs: the batch against plain Python, and the stream against the batch."""

import datetime as dt
import random
import shutil

import pytest

from foliosift.plans.monitor import Monitor
from foliosift.streaming import runs

QUIET = dt.timedelta(minutes=10)
DAY = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)


def drawn(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice([runs.START, runs.END, runs.DETAIL, runs.TOKENS])
        ts = DAY + dt.timedelta(seconds=rng.randrange(6 * 3600), microseconds=rng.choice([0, 5, 999_999]))
        out.append((f"run{rng.randrange(3)}", rng.choice(["route", "plan", "db_query_a_0"]), i, kind, ts, rng.choice(["done", "failed"]) if kind == runs.END else None, rng.choice("xyz") if kind == runs.DETAIL else None, rng.choice(["1", "é\"", None]) if kind == runs.DETAIL else None, rng.randrange(9) if kind == runs.TOKENS else None))
    return out


def plain(events):
    """Each stage's events in order, cut where it was quiet."""
    out, of = [], {}
    for e in {(e[0], e[1], e[2]): e for e in events}.values():
        of.setdefault(e[:2], []).append(e)
    for (run, stage), own in of.items():
        own.sort(key=lambda e: (e[4], e[2]))
        stretches = [[own[0]]]
        for a, b in zip(own, own[1:]):
            if b[4] - a[4] >= QUIET:
                stretches.append([])
            stretches[-1].append(b)
        for s in stretches:
            starts, ends = [e[4] for e in s if e[3] == runs.START], [e for e in s if e[3] == runs.END]
            details = {e[6]: e[7] for e in s if e[3] == runs.DETAIL}
            out.append((run, stage, s[0][4], s[-1][4], starts[0] if starts else None, ends[-1][4] if ends else s[-1][4], ends[-1][5] if ends else runs.ABANDONED, sum(e[8] or 0 for e in s), len(s), tuple(sorted(details.items()))))
    return sorted(out, key=repr)


def rows(df):
    at = lambda t: t and t.astimezone(dt.UTC)
    return sorted(((r[0], r[1], *map(at, r[2:6]), *r[6:9], tuple(sorted(r[9].items()))) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_batch_equals_plain_python(spark, seed):
    events = drawn(seed)
    frame = spark.createDataFrame([*events, *events[:50], (None, "route", 1, "start", DAY, *[None] * 4), ("run0", "route", 7, "start", None, *[None] * 4)], runs.EVENTS)
    assert rows(runs.stages(frame, QUIET)) == plain(events)
    assert runs.stages(frame.where("false"), QUIET).collect() == []


def test_a_questions_stages_join_other_runs(spark):
    monitor = Monitor()
    with monitor.stage("route", scope="full"):
        pass
    with pytest.raises(OSError), monitor.stage("plan"):
        raise OSError
    both = monitor.events(spark, "a").unionByName(monitor.events(spark, "b", 100))
    got = {(r["run"], r["stage"]): (r["status"], dict(r["details"])) for r in runs.stages(both, QUIET).collect()}
    assert got == {(run, stage): x for run in "ab" for stage, x in (("route", ("done", {"scope": "full"})), ("plan", ("failed", {})))}


def test_open_stretches_join_in_any_order():
    us = lambda m: m * 60_000_000
    for order in ([0, 8, 16, 40], [16, 0, 40, 8], [40, 16, 8, 0]):
        s = runs.Stretches(us(10))
        for k in order:
            s.add(k, runs.TOKENS, us(k), None, None, None, 1)
            s.add(k, runs.TOKENS, us(k), None, None, None, 1)  # again
        assert sorted((x["first"] // us(1), x["last"] // us(1), x["tokens"]) for x in s.held) == [(0, 16, 3), (40, 40, 1)]
        assert [x["last"] for x in s.closed(us(26))] == [us(16)] and s.due_ms() == [50 * 60_000]


def test_stream_equals_batch(spark, tmp_path):
    """Batches of events out of order, some again, each at most an hour late."""
    before = spark.conf.get(runs.STORE[0], None)
    spark.conf.set(*runs.STORE)
    try:
        rng = random.Random(7)
        events = sorted(drawn(7), key=lambda e: e[4] + dt.timedelta(minutes=rng.randrange(60)))
        events += [("run0", "last", 10_000, runs.START, DAY + dt.timedelta(days=2), *[None] * 4)]
        incoming, out = tmp_path / "in", str(tmp_path / "out")
        incoming.mkdir()
        size = 90
        parts = [events[i : i + size] + events[max(0, i - 20) : i] for i in range(0, len(events), size)]
        parts.append([("run0", "last", 10_001, runs.START, DAY + dt.timedelta(days=2, minutes=1), *[None] * 4)])  # the watermark of the part before closes all else
        stream = spark.readStream.schema(runs.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(incoming))
        for k, part in enumerate(parts):
            one = str(tmp_path / f"part{k}")
            spark.createDataFrame(part, runs.EVENTS).coalesce(1).write.parquet(one)
            (name,) = (tmp_path / f"part{k}").glob("part-*.parquet")
            shutil.copy(name, incoming / f"{k:03d}.parquet")
        query = runs.kept(stream, QUIET, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        got = rows(spark.read.parquet(out))
    finally:
        spark.conf.unset(runs.STORE[0]) if before is None else spark.conf.set(runs.STORE[0], before)
    want = rows(runs.stages(spark.createDataFrame(events, runs.EVENTS), QUIET))
    assert got == [r for r in want if r[1] != "last"] and len(got) > 20
