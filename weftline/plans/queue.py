"""Jobs that run side by side in one application: a bounded queue that refuses what it can't hold."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark.sql import SparkSession

#: Jobs that may wait, and that run at a time (fixed values).
CAPACITY, WORKERS = 100, 5


class BoundedJobs:
    """``submit`` gives a future, or None where the queue is full. Each job runs in a pool of its own, so that under the
    FAIR scheduler a large one doesn't hold back the others. Jobs left when it is closed are still run."""

    def __init__(self, spark: SparkSession, capacity: int = CAPACITY, workers: int = WORKERS):
        self.spark = spark
        self._waiting: queue.Queue = queue.Queue(capacity)
        self._threads = [threading.Thread(target=self._work, args=(f"jobs-{n}",), daemon=True) for n in range(workers)]
        for t in self._threads:
            t.start()

    def submit(self, job: Callable[[SparkSession], Any]) -> Future | None:
        future: Future = Future()
        try:
            self._waiting.put_nowait((job, future))
        except queue.Full:
            return None
        return future

    def _work(self, pool: str) -> None:
        while (item := self._waiting.get()) is not None:
            job, future = item
            if not future.set_running_or_notify_cancel():
                continue
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
            try:
                future.set_result(job(self.spark))
            except BaseException as e:  # the job's fault is its future's
                future.set_exception(e)

    def close(self) -> None:
        """Ends the workers when all that waits has run."""
        for _ in self._threads:
            self._waiting.put(None)
        for t in self._threads:
            t.join()
