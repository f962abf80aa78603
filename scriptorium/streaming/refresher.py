"""Keep an index current beside its readers.

A refresh runs at start and then on request, one at a time. Requests made before
a refresh starts are one; refreshes begin `interval` seconds apart at least. A
refresh that takes longer than `limit` seconds has its Spark jobs cancelled,
which fails it and leaves the index as it was: nothing is published before the
last step of a build. So does `stop`, which then waits.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Refresher:
    def __init__(self, spark: SparkSession, build: Callable[[], dict], interval: float = 10, limit: float = 120):
        self.spark, self.build, self.interval, self.limit = spark, build, interval, limit
        self.reports: list[dict | Exception] = []
        self._asked, self._stopped = threading.Event(), threading.Event()
        self._group: str | None = None
        self._lock = threading.Lock()
        self._asked.set()
        self._thread = threading.Thread(target=self._run, name="refresher", daemon=True)
        self._thread.start()

    @property
    def running(self) -> bool:
        return self._group is not None

    def request(self) -> None:
        """Ask for a refresh, without waiting for it."""
        self._asked.set()

    def stop(self, timeout: float | None = None) -> bool:
        """Cancel a running refresh and wait; whether the refresher has ended."""
        self._stopped.set()
        self._asked.set()
        self._cancel()
        self._thread.join(timeout)
        return not self._thread.is_alive()

    def _cancel(self) -> None:
        with self._lock:
            if self._group is not None:
                self.spark.sparkContext.cancelJobGroup(self._group)

    def _run(self) -> None:
        while not self._stopped.is_set():
            self._asked.wait()
            self._asked.clear()
            if self._stopped.is_set():
                return
            self._once()
            self._stopped.wait(self.interval)

    def _once(self) -> None:
        group = f"refresh-{uuid.uuid4().hex}"
        with self._lock:
            self._group = group
        # Jobs of this thread alone carry the group. The next one is cancelled too, should the limit pass between two jobs.
        self.spark.sparkContext.setJobGroup(group, "index refresh", interruptOnCancel=True)
        over = threading.Event()
        clock = threading.Thread(target=self._watch, args=(over,), daemon=True)
        clock.start()
        try:
            self.reports.append(self.build())
        except Exception as e:  # a refresh that fails leaves readers what they have
            self.reports.append(e)
        finally:
            over.set()
            with self._lock:
                self._group = None

    def _watch(self, over: threading.Event) -> None:
        wait = self.limit
        while not over.wait(wait):
            self._cancel()
            wait = 0.5
