"""Progress of a running action, told to a callback."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession


def watched(spark: SparkSession, action: Callable, progress: Callable[[float, str], None], every: float = 0.5):
    """Run ``action()`` and give its result; meanwhile ``progress(share, message)`` hears of the tasks that are done.

    The share is that of the tasks of all stages begun so far. It never falls,
    starts with 0 and ends with 1 if the action succeeds.
    """
    tracker, over = spark.sparkContext.statusTracker(), threading.Event()
    seen: dict[int, tuple[int, int]] = {}
    best = 0.0

    def look() -> None:
        nonlocal best
        for stage in {*tracker.getActiveStageIds(), *seen}:
            info = tracker.getStageInfo(stage)
            if info:
                seen[stage] = info.numCompletedTasks, info.numTasks
        done, total = (sum(x[k] for x in seen.values()) for k in (0, 1))
        if total and done / total > best:
            best = min(done / total, 0.99)
            progress(best, f"{done} of {total} tasks")

    def loop() -> None:
        while not over.wait(every):
            look()

    progress(0.0, "")
    watcher = threading.Thread(target=loop, daemon=True)
    watcher.start()
    try:
        result = action()
    finally:
        over.set()
        watcher.join()
    progress(1.0, "")
    return result
