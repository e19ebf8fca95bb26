"""Stages of many runs at once, from their events: as a batch, or kept by a stream.

An event is of a run and a stage: ``start``; ``end`` with a status; ``detail`` with a name and a value;
``tokens`` used. Events come in any order and may come again. A row of the result is a stretch of a
stage's events in which none is ``quiet`` or more after the one before it; what comes later
is the stage begun anew. Its start is its first start event's time, its end and status those of its last
end event, or where it has none it is ``abandoned`` at its last event. Tokens add up, each
event once; of a detail's values the last stays. Events at one time go by their ids.

The batch uses session windows. The stream keeps each stage's open stretches as state, joins those
that a late event brings together, and closes a stretch by a timer once the watermark is ``quiet``
past its last event. So the closed rows of both are the same, whatever order events came in, as long
as none is later than the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliosift.packaged import ship

EVENTS = "run string, stage string, event_id long, kind string, ts timestamp, status string, name string, value string, tokens long"
STAGES = "run string, stage string, first_ts timestamp, last_ts timestamp, start_ts timestamp, end_ts timestamp, status string, tokens long, events long, details map<string, string>"
START, END, DETAIL, TOKENS = "start", "end", "detail", "tokens"
ABANDONED = "abandoned"
#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stages(events: DataFrame, quiet: timedelta) -> DataFrame:
    """One row for each stretch, columns ``STAGES``; events without a run, a stage or a time are left out."""
    known = events.where("run IS NOT NULL AND stage IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").dropDuplicates(["run", "stage", "event_id"])
    is_kind = lambda k, c: F.when(F.col("kind") == k, c)
    values = F.collect_list(F.when((F.col("kind") == DETAIL) & F.col("name").isNotNull(), F.struct("ts", "event_id", "name", "value")))
    found = known.groupBy("run", "stage", F.session_window("ts", f"{int(quiet.total_seconds() * 1000)} milliseconds")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min(is_kind(START, F.col("ts"))).alias("start_ts"),
        F.max(is_kind(END, F.struct("ts", "event_id", "status"))).alias("end"), F.coalesce(F.sum(is_kind(TOKENS, F.col("tokens"))), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("events"), F.array_sort(values).alias("values"),
    )
    none = F.create_map().cast("map<string, string>")
    details = F.aggregate("values", none, lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["name"]), F.create_map(x["name"], x["value"])))
    return found.select(
        "run", "stage", "first_ts", "last_ts", "start_ts", F.coalesce("end.ts", "last_ts").alias("end_ts"),
        F.when(F.col("end").isNull(), ABANDONED).otherwise(F.col("end.status")).alias("status"), "tokens", "events", details.alias("details"),
    )


class Stretches:
    """A stage's open stretches. Each keeps its events' bounds, what decides its row, and the ids it has seen."""

    def __init__(self, quiet_us: int, held: list[dict] | None = None):
        self.quiet, self.held = quiet_us, held or []

    def add(self, event_id: int, kind: str, us: int, status, name, value, tokens) -> None:
        if any(str(event_id) in s["seen"] for s in self.held):
            return
        new = {
            "first": us, "last": us, "start": us if kind == START else None, "end": [us, event_id, status] if kind == END else None, "tokens": int(tokens or 0) if kind == TOKENS else 0,
            "details": {name: [us, event_id, value]} if kind == DETAIL and name is not None else {}, "seen": {str(event_id): 1},
        }
        apart = []
        for s in self.held:
            if s["last"] + self.quiet > new["first"] and new["last"] + self.quiet > s["first"]:
                new = self._joined(s, new)
            else:
                apart.append(s)
        self.held = [*apart, new]

    @staticmethod
    def _joined(a: dict, b: dict) -> dict:
        details = dict(a["details"])
        for name, at in b["details"].items():
            if name not in details or details[name][:2] < at[:2]:
                details[name] = at
        starts = [x["start"] for x in (a, b) if x["start"] is not None]
        ends = [x["end"] for x in (a, b) if x["end"] is not None]
        return {
            "first": min(a["first"], b["first"]), "last": max(a["last"], b["last"]), "start": min(starts, default=None), "end": max(ends, key=lambda e: e[:2], default=None),
            "tokens": a["tokens"] + b["tokens"], "details": details, "seen": a["seen"] | b["seen"],
        }

    def closed(self, watermark_us: int) -> list[dict]:
        """Takes out the stretches that nothing can be added to any more."""
        done = [s for s in self.held if s["last"] + self.quiet <= watermark_us]
        self.held = [s for s in self.held if s["last"] + self.quiet > watermark_us]
        return done

    def due_ms(self) -> list[int]:
        return sorted({-(-(s["last"] + self.quiet) // 1000) for s in self.held})


ROW = ["run", "stage", "first_ts", "last_ts", "start_ts", "end_ts", "status", "tokens", "events", "details"]


class Keeper(StatefulProcessor):
    def __init__(self, quiet_us: int):
        self.quiet = quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stretches", "held string")

    def _held(self) -> Stretches:
        return Stretches(self.quiet, json.loads(self.state.get()[0]) if self.state.exists() else None)

    def _keep(self, now: Stretches, timers: set[int]) -> None:
        for ms in timers - set(now.due_ms()):
            self.handle.deleteTimer(ms)
        for ms in set(now.due_ms()) - timers:
            self.handle.registerTimer(ms)
        if now.held:
            self.state.update((json.dumps(now.held),))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self._held()
        timers = set(now.due_ms())
        for frame in rows:
            plain = frame.astype(object).where(frame.notna(), None)
            for r in plain.itertuples(index=False):
                now.add(int(r.event_id), r.kind, int(r.us), r.status, r.name, r.value, r.tokens)
        self._keep(now, timers)
        yield pd.DataFrame(columns=ROW)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self._held()
        timers = set(now.due_ms()) - {expiredTimerInfo.getExpiryTimeInMs()}
        done = now.closed(timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(now, timers)
        rows = []
        for s in done:
            end, status = (s["end"][0], s["end"][2]) if s["end"] else (s["last"], ABANDONED)
            rows.append((*key, s["first"], s["last"], s["start"], end, status, s["tokens"], len(s["seen"]), json.dumps({n: v for n, (_, _, v) in sorted(s["details"].items())})))
        yield pd.DataFrame(rows, columns=ROW).astype({"start_ts": "Int64"})

    def close(self) -> None:
        pass


def kept(events: DataFrame, quiet: timedelta, late: str) -> DataFrame:
    """The stream's closed rows, columns ``STAGES``, for output mode append. ``late`` is how late events may come."""
    ship(events.sparkSession)
    known = events.where("run IS NOT NULL AND stage IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    raw = "run string, stage string, first_ts long, last_ts long, start_ts long, end_ts long, status string, tokens long, events long, details string"
    rows = known.groupBy("run", "stage").transformWithStateInPandas(
        statefulProcessor=Keeper(round(quiet.total_seconds() * 1e6)), outputStructType=raw, outputMode="Append", timeMode="EventTime"
    )
    times = {c: F.timestamp_micros(c) for c in ("first_ts", "last_ts", "start_ts", "end_ts")}
    return rows.withColumns(times).withColumn("details", F.from_json("details", "map<string, string>")).select(*ROW)
