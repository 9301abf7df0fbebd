"""Runs jobs one beside the other, keeps their states as rows, and cancels them by tag."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from .store import Store


class Cancelled(Exception):
    """A job that was told to end."""


class Jobs:
    """Jobs of one store. A job is a function of (session, check); check() raises once the job is cancelled, and Spark work
    under way is interrupted by the job's tag. States go PENDING, RUNNING, then DONE, FAILED or CANCELLED: also a job that
    is cancelled in the midst of its work ends as CANCELLED."""

    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store
        self.told: dict[str, threading.Event] = {}
        self.threads: dict[str, threading.Thread] = {}
        self.stats: dict[str, dict[str, int]] = {}
        self.lock = threading.Lock()

    def submit(self, mode: str, query: str, work: Callable, profile: str = "medium") -> str:
        """Starts a job and returns its id."""
        id_ = uuid.uuid4().hex[:8]
        self._set(id_, mode, query, "PENDING", profile)
        self.told[id_], self.stats[id_] = threading.Event(), {}
        self.threads[id_] = threading.Thread(target=self._run, args=(id_, mode, query, profile, work), daemon=True)
        self.threads[id_].start()
        return id_

    def _set(self, id_, mode, query, status, profile, error=None):
        with self.lock:
            self.store.set_job(id_, mode, query, status, profile, error)

    def _run(self, id_, mode, query, profile, work):
        def check(**stats: int):
            self.stats[id_].update(stats)
            if self.told[id_].is_set():
                raise Cancelled(id_)

        status, error = "DONE", None
        try:
            check()
            self._set(id_, mode, query, "RUNNING", profile)
            self.spark.addTag(f"job-{id_}")
            work(self.spark, check)
            check()
        except Cancelled:
            status = "CANCELLED"
        except Exception as e:  # the state tells why, and an interrupted action raises Spark's own error
            status, error = ("CANCELLED", None) if self.told[id_].is_set() else ("FAILED", f"{type(e).__name__}: {e}"[:500])
        finally:
            self.spark.clearTags()
        self._set(id_, mode, query, status, profile, error)

    def cancel(self, id_: str) -> str:
        """Tells a job to end: at its next check, or at once where Spark works for it. An unknown id counts as cancelled."""
        if id_ in self.told:
            self.told[id_].set()
            self.spark.interruptTag(f"job-{id_}")
        return "CANCELLED"

    def detail(self, id_: str) -> dict | None:
        """The job's row with its live stats; null if there is none."""
        row = self.store.job(id_)
        return None if row is None else row | {"stats": dict(self.stats.get(id_, {}))}

    def wait(self, id_: str, seconds: float | None = None) -> None:
        self.threads[id_].join(seconds)
