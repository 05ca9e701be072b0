"""Tasks: submitted work with states, revisions, waits, idempotent keys and cancellation by Spark's job tags."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import InheritableThread
from pyspark.sql import SparkSession

TERMINAL = {"completed", "partial", "failed", "cancelled"}
KEPT, MOST_WAIT = 128, 55.0


@dataclass(frozen=True)
class Snapshot:
    id: str
    state: str = "queued"
    revision: int = 1
    progress: float = 0.0
    message: str = ""
    result: object = None
    error: str | None = None
    created: float = field(default_factory=time.time)
    updated: float = field(default_factory=time.time)


class Tasks:
    """Runs functions of (session, report) on driver threads; each thread's Spark jobs carry the task's tag."""

    def __init__(self, spark: SparkSession, kept: int = KEPT) -> None:
        self.spark, self.kept = spark, kept
        self._jobs: dict[str, Snapshot] = {}
        self._keys: dict[str, str] = {}
        self._changed = threading.Condition()

    def _set(self, id_: str, **values) -> Snapshot:
        with self._changed:
            old = self._jobs[id_]
            if old.state in TERMINAL:
                return old
            new = self._jobs[id_] = replace(old, revision=old.revision + 1, updated=time.time(), **values)
            self._changed.notify_all()
            return new

    def submit(self, work: Callable[[SparkSession, Callable[[float, str], None]], object], key: str | None = None) -> Snapshot:
        """Starts work; the same key gives the task that it gave before."""
        with self._changed:
            if key is not None and key in self._keys:
                return self._jobs[self._keys[key]]
            while len(self._jobs) >= self.kept:
                done = [j for j in self._jobs.values() if j.state in TERMINAL]
                if not done:
                    raise RuntimeError("too many tasks")
                oldest = min(done, key=lambda j: j.created).id
                del self._jobs[oldest]
                self._keys = {k: v for k, v in self._keys.items() if v != oldest}
            snap = Snapshot(uuid.uuid4().hex)
            self._jobs[snap.id] = snap
            if key is not None:
                self._keys[key] = snap.id

        def report(progress: float, message: str = "") -> None:
            self._set(snap.id, progress=progress, message=message)

        def run() -> None:
            self.spark.sparkContext.addJobTag(snap.id)
            self._set(snap.id, state="running")
            try:
                result = work(self.spark, report)
                state = result.get("status", "completed") if isinstance(result, dict) else "completed"
                self._set(snap.id, state=state if state in TERMINAL else "completed", progress=1.0, result=result)
            except Exception as e:  # noqa: BLE001  a task's failure is its state
                self._set(snap.id, state="failed", error=f"{type(e).__name__}: {e}"[:2048])

        InheritableThread(target=run, daemon=True, session=self.spark).start()
        return snap

    def get(self, id_: str) -> Snapshot:
        with self._changed:
            return self._jobs[id_]

    def wait(self, id_: str, after: int | None = None, seconds: float = 30.0) -> Snapshot:
        """The task once it has ended (or, with ``after``, once its revision is higher); or as it is when time is up."""
        end = time.monotonic() + min(seconds, MOST_WAIT)
        with self._changed:
            while (left := end - time.monotonic()) > 0:
                now = self._jobs[id_]
                if now.state in TERMINAL or (after is not None and now.revision > after):
                    return now
                self._changed.wait(left)
            return self._jobs[id_]

    def cancel(self, id_: str) -> Snapshot:
        out = self._set(id_, state="cancelled")
        self.spark.sparkContext.cancelJobsWithTag(id_)
        return out

    def __iter__(self):
        with self._changed:
            return iter(sorted(self._jobs.values(), key=lambda j: j.created))
