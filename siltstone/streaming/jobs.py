"""The job runner: a first-in queue, bounded concurrency, and a state machine that emits events."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

ACTIVE = ("queued", "running", "cancelling")
ENDED = ("completed", "failed", "cancelled")
#: States a job may go to.
NEXT = {
    "queued": {"running", "cancelled"},
    "running": {"completed", "failed", "cancelling", "cancelled"},
    "cancelling": {"cancelled", "failed"},
}


class Bus:
    """Publish to all who subscribed before. A subscriber that lags keeps the last ``capacity`` events and is told how many it lost."""

    def __init__(self, capacity: int = 256):
        self.capacity, self._all, self._lock = capacity, [], threading.Lock()

    def subscribe(self) -> deque:
        with self._lock:
            self._all.append(deque(maxlen=self.capacity))
            return self._all[-1]

    def unsubscribe(self, queue: deque) -> None:
        with self._lock:
            self._all = [q for q in self._all if q is not queue]

    def emit(self, kind: str, payload: dict) -> None:
        with self._lock:
            for q in self._all:
                if len(q) == self.capacity:  # the two oldest make room, for the new event and the note
                    first, _ = q.popleft(), q.popleft()
                    lost = 1 + (first["payload"]["events"] if first["type"] == "LAGGED" else 1)
                    q.appendleft({"type": "LAGGED", "payload": {"events": lost}})
                q.append({"type": kind, "payload": payload})


@dataclass
class Job:
    library: str
    version: str
    url: str
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    status: str = "queued"
    error: str | None = None
    created_at: int = field(default_factory=lambda: int(time.time() * 1000))
    started_at: int | None = None
    finished_at: int | None = None
    cancel: threading.Event = field(default_factory=threading.Event, repr=False)


class Manager:
    """Runs jobs by ``work(job)`` in threads of the driver, each a Spark job group of its own.

    A finished job starts the next in the queue. ``on_status(job)`` sees every
    change, so the catalog's version status follows the job's.
    """

    def __init__(self, work: Callable[[Job], None], concurrency: int = 5, bus: Bus | None = None, on_status: Callable[[Job], None] = lambda _: None):
        self.work, self.bus, self.on_status = work, bus or Bus(), on_status
        self.jobs: dict[str, Job] = {}
        self._futures: dict[str, Future] = {}
        self._pool = ThreadPoolExecutor(concurrency)
        self._lock = threading.RLock()

    def _set(self, job: Job, status: str, error: str | None = None) -> bool:
        with self._lock:
            if status not in NEXT.get(job.status, ()):
                return False
            job.status, job.error = status, error
            now = int(time.time() * 1000)
            if status == "running":
                job.started_at = now
            if status in ENDED:
                job.finished_at = now
        self.on_status(job)
        self.bus.emit("JOB_STATUS_CHANGE", {"id": job.id, "status": status, "error": error})
        return True

    def enqueue(self, library: str, version: str, url: str) -> Job:
        job = Job(library.lower(), version, url)
        with self._lock:
            self.jobs[job.id] = job
            self._futures[job.id] = self._pool.submit(self._run, job)
        self.bus.emit("JOB_LIST_CHANGE", {})
        return job

    def _run(self, job: Job) -> None:
        if not self._set(job, "running"):
            return
        try:
            self.work(job)
        except Exception as error:
            self._set(job, "failed", str(error))
        else:  # a cancelled job may end without an error, too
            self._set(job, "cancelled" if job.cancel.is_set() else "completed")
        finally:
            if job.cancel.is_set() and job.status not in ENDED:
                self._set(job, "cancelled")

    def cancel(self, job_id: str) -> bool:
        job = self.jobs[job_id]
        job.cancel.set()
        return self._set(job, "cancelled") if job.status == "queued" else self._set(job, "cancelling")

    def wait(self, job_id: str, timeout: float | None = None) -> Job:
        """The job when it has ended; an error if it failed, was cancelled or is unknown."""
        job = self.jobs[job_id]
        self._futures[job_id].result(timeout)
        if job.status != "completed":
            raise RuntimeError(f"job {job_id} {job.status}: {job.error or ''}")
        return job

    def by_status(self, status: str) -> list[Job]:
        return [j for j in self.jobs.values() if j.status == status]

    def clear_completed(self) -> int:
        with self._lock:
            gone = [k for k, j in self.jobs.items() if j.status in ENDED]
            for k in gone:
                del self.jobs[k], self._futures[k]
        if gone:
            self.bus.emit("JOB_LIST_CHANGE", {})
        return len(gone)

    def stop(self) -> None:
        for job in self.by_status("running"):
            self.cancel(job.id)
        self._pool.shutdown(wait=True, cancel_futures=True)
