"""File changes as a stream, and the first-come job queue as a state machine, in batch and as a stream."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.session import shared_folder

#: Path parts of files that no event is taken of.
IGNORED = ["/.build/", "/DerivedData/", "/Pods/"]
#: Finished jobs that are remembered.
RECENT = 10
JOBS = "worker string, job_id string, project string, status string, total long, current long, position int, chunks_ahead long, created_at double, started_at double, completed_at double, error string, place int"
EVENTS = "worker string, seq long, at double, op string, job_id string, project string, total long, current long, error string"


def relevant(path: Column, suffix: str = ".swift") -> Column:
    """Source files that are not hidden and not in a folder of built or foreign code."""
    out = path.endswith(suffix) & ~F.substring_index(path, "/", -1).startswith(".")
    for part in IGNORED:
        out = out & ~F.concat(F.lit("/"), path).contains(part)
    return out


def coalesced(events: DataFrame) -> DataFrame:
    """(path, kind): the last event of each path of a batch."""
    return events.filter(relevant(F.col("path"))).groupBy("path").agg(F.max_by("kind", F.struct("at", "kind")).alias("kind"))


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, at) of the change files (JSON lines) that come into *folder*; kind is created, modified or deleted."""
    return spark.readStream.schema("path string, kind string, at double").json(folder)


def watch(changes: DataFrame, on_change: Callable[[DataFrame, int], None], checkpoint: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Calls *on_change* with the coalesced changes of each batch that has any; one batch after the other, so what comes during a long one waits.

    Without *interval* what is there is read and the query ends; stop() ends it in any case. A batch that failed
    is called again with the same changes.
    """
    root = checkpoint or f"{shared_folder(changes.sparkSession)}/watch-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        found = coalesced(batch).persist()
        if found.take(1):
            on_change(found, number)
        found.unpersist()

    w = changes.writeStream.foreachBatch(each).option("checkpointLocation", root)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


class Queue:
    """One worker's jobs: queued, active, and the last ones that ended."""

    def __init__(self, state: dict | None = None, workers: int = 1):
        s = state or {"jobs": {}, "queue": [], "active": [], "recent": [], "chunks": 0, "seconds": 0.0}
        self.jobs, self.queue, self.active, self.recent, self.chunks, self.seconds = (s[k] for k in ("jobs", "queue", "active", "recent", "chunks", "seconds"))
        self.workers = workers

    def state(self) -> dict:
        return {"jobs": self.jobs, "queue": self.queue, "active": self.active, "recent": self.recent, "chunks": self.chunks, "seconds": self.seconds}

    def step(self, e: dict) -> bool:
        """Takes one event; whether it had any effect."""
        op, job_id, at = e["op"], e["job_id"], e["at"]
        job = self.jobs.get(job_id)
        if op == "register" and job is None:
            self.jobs[job_id] = {"job_id": job_id, "project": e["project"], "total": int(e["total"] or 0), "current": 0, "status": "queued", "created_at": at, "started_at": None, "completed_at": None, "error": None}
            self.queue.append(job_id)
        elif op == "clear":
            self.recent.clear()
        elif job is None or (op == "progress" and job["status"] != "active"):
            return False
        elif op == "progress":
            job["current"] = int(e["current"] or 0)
        elif op in ("complete", "fail", "cancel"):
            self._end(job, op, at, e.get("error"))
        else:
            return False
        while len(self.active) < self.workers and self.queue:
            nxt = self.jobs[self.queue.pop(0)]
            nxt["status"], nxt["started_at"] = "active", at
            self.active.append(nxt["job_id"])
        return True

    def _end(self, job: dict, op: str, at: float, error: str | None) -> None:
        for held in (self.queue, self.active):
            if job["job_id"] in held:
                held.remove(job["job_id"])
        del self.jobs[job["job_id"]]
        if op == "cancel":
            return
        job["completed_at"] = at
        if op == "complete":
            job["status"], job["current"] = "completed", job["total"]
            if job["started_at"] is not None:
                self.chunks, self.seconds = self.chunks + job["total"], self.seconds + at - job["started_at"]
        else:
            job["status"], job["error"] = "failed", error
        self.recent.insert(0, job)
        del self.recent[RECENT:]

    def rows(self, worker: str) -> list[dict]:
        """A row for each job: active ones at position 0, queued ones with the chunks before them, ended ones from the last."""
        ahead = sum(self.jobs[j]["total"] - self.jobs[j]["current"] for j in self.active)
        out = [self.jobs[j] | {"position": 0, "chunks_ahead": 0} for j in self.active]
        for i, j in enumerate(self.queue):
            out.append(self.jobs[j] | {"position": i + 1, "chunks_ahead": ahead})
            ahead += self.jobs[j]["total"]
        out += [j | {"position": -1, "chunks_ahead": 0} for j in self.recent]
        return [r | {"worker": worker, "place": i} for i, r in enumerate(out)]

    def wait(self, ahead: int) -> float | None:
        """Seconds until *ahead* chunks are done, at the rate so far."""
        return ahead * self.seconds / self.chunks if self.chunks and self.seconds else None


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in JOBS.split(", ")])


def _clean(e: dict) -> dict:
    return {k: None if v is None or v != v else v for k, v in e.items()}


def replay(events: DataFrame, workers: int = 1) -> DataFrame:
    """The jobs of each worker after all its events (EVENTS), in order of seq. A queue is sequential: a worker's events are one group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        q = Queue(workers=workers)
        for e in rows.sort_values("seq").to_dict("records"):
            q.step(_clean(e))
        return _frame(q.rows(key[0]))

    return events.groupBy("worker").applyInPandas(run, JOBS)


def stream_jobs(events: DataFrame, workers: int = 1) -> DataFrame:
    """The same as a stream: after each batch the jobs of every worker that had an event. The state is kept by Spark."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q = Queue(json.loads(state.get[0]) if state.exists else None, workers)
        rows = [e for b in batches for e in b.to_dict("records")]
        for e in sorted(rows, key=lambda e: e["seq"]):
            q.step(_clean(e))
        state.update((json.dumps(q.state()),))
        yield _frame(q.rows(key[0]))

    return events.groupBy("worker").applyInPandasWithState(run, JOBS, "state string", "update", GroupStateTimeout.NoTimeout)


def progress(jobs: DataFrame, now: float) -> DataFrame:
    """*jobs* with elapsed seconds, rate, percent and the seconds left of active ones."""
    run = F.lit(now) - F.col("started_at")
    rate = F.when((F.col("current") > 0) & (run > 0), F.col("current") / run)
    live = F.col("status") == "active"
    return jobs.withColumns({
        "elapsed": F.round(F.coalesce(F.col("completed_at") - F.col("started_at"), F.when(live, run)), 1), "rate": F.round(F.when(live, rate), 1),
        "percent": F.when(F.col("total") > 0, F.expr("current * 100 div total")), "eta": F.round(F.when(live, (F.col("total") - F.col("current")) / rate), 1),
    })


def new_id() -> Column:
    """Eight characters that no other job has."""
    return F.substring(F.expr("uuid()"), 1, 8)
