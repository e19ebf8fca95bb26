"""A question's stages as rows; restarting a name adds a row."""

from __future__ import annotations

import itertools
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from foliosift import schemas
from foliosift.streaming import runs


class Monitor:
    def __init__(self, enabled: bool = True):
        self.enabled, self.rows = enabled, []

    @contextmanager
    def stage(self, name: str, **details):
        row = [name, datetime.now(UTC), None, "running", {k: str(v) for k, v in details.items()}]
        if self.enabled:
            self.rows.append(row)
        try:
            yield row[4]
            row[3] = "done"
        except BaseException:
            row[3] = "failed"
            raise
        finally:
            row[2] = datetime.now(UTC)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], schemas.STAGE)

    def events(self, spark: SparkSession, run: str, first_id: int = 0) -> DataFrame:
        """The same as events of a run, for ``foliosift.streaming.runs`` to put together with other runs'."""
        rows, number = [], itertools.count(first_id)
        for name, start, end, status, details in self.rows:
            rows.append((run, name, next(number), runs.START, start, None, None, None, None))
            rows += [(run, name, next(number), runs.DETAIL, start, None, k, v, None) for k, v in details.items()]
            if end is not None:
                rows.append((run, name, next(number), runs.END, end, status, None, None, None))
        return spark.createDataFrame(rows, runs.EVENTS)
