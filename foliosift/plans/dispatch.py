"""Work on several sources at once: what has ended is told as it ends, and a failure stays its source's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed


def as_they_end(jobs: dict[str, Callable], workers: int = 5) -> Iterator[tuple[str, object, str | None]]:
    """(key, result, error) of each job in the order in which they end. Jobs are Spark actions on few
    rows, so the threads only wait."""
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(jobs)))) as pool:
        running = {pool.submit(job): key for key, job in jobs.items()}
        for done in as_completed(running):
            error = done.exception()
            yield running[done], None if error else done.result(), f"{type(error).__name__}: {error}".splitlines()[0] if error else None
