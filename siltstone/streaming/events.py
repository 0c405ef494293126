"""Events of jobs: envelopes, windows, throttled progress, final states, micro-batch indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The envelope's type and the payload's tag of each event.
TAGS = {
    "JOB_STATUS_CHANGE": "JobStatusChange",
    "JOB_PROGRESS": "JobProgress",
    "LIBRARY_CHANGE": "LibraryChange",
    "JOB_LIST_CHANGE": "JobListChange",
}


def envelope(kind: Column, payload: Column) -> Column:
    """{"type": …, "payload": {"type": …, "payload": …}} as JSON."""
    tag = F.lit(None).cast("string")
    for name, variant in TAGS.items():
        tag = F.when(kind == name, variant).otherwise(tag)
    return F.to_json(F.struct(kind.alias("type"), F.struct(tag.alias("type"), payload.alias("payload")).alias("payload")))


def tumbling(events: DataFrame, at: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """Counts per window and keys; with ``late``, a watermark for streams."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if late:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if late:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def shown(times: list[float], first: int = 5, gap: float = 0.05) -> list[bool]:
    """Which of a job's progress events are sent: the first few, then those ``gap`` seconds after the last sent."""
    out, last = [], float("-inf")
    for i, t in enumerate(times):
        ok = i < first or t - last >= gap
        out.append(ok)
        last = t if ok else last
    return out


def throttle(events: DataFrame, key: str, at: str, first: int = 5, gap: float = 0.05) -> DataFrame:
    """Batch form of the throttle: events (key, at in seconds, …) that are sent."""
    schema = events.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        return pdf[shown(pdf[at].tolist(), first, gap)]

    return events.groupBy(key).applyInPandas(run, schema)


def throttle_stream(events: DataFrame, key: str, at: str, first: int = 5, gap: float = 0.05) -> DataFrame:
    """Streaming form: state per key is how many events came and when one was last sent."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, float("-inf"))
        out = []
        for t in sorted(x for b in batches for x in b["at"]):
            if n < first or t - last >= gap:
                out.append(t)
                last = t
            n += 1
        state.update((n, last))
        yield pd.DataFrame({"key": [k[0]] * len(out), "at": out})

    rows = events.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"))
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, at double", "n long, last double", "append", GroupStateTimeout.NoTimeout)


def final_state(events: DataFrame, key: str, at: str, tie: str, state: str) -> DataFrame:
    """The last state of each key: partial maxima, so a busy key costs a row per task."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, tie)).alias("state"))


def job_states_stream(events: DataFrame, key: str, status: str) -> DataFrame:
    """Streaming form of the job state machine: (key, status) of each allowed change, in order of arrival.

    State per job is its status; a change that the machine does not allow is
    ignored, so events that come twice change nothing.
    """
    from .jobs import NEXT

    kind = events.schema[key].dataType.simpleString()
    allowed = {k: set(v) for k, v in NEXT.items()}

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        out = []
        for new in (s for b in batches for s in b["status"]):
            if now is None and new == "queued" or now is not None and new in allowed.get(now, ()):
                out.append(new)
                now = new
        if now is not None:
            state.update((now,))
        yield pd.DataFrame({"key": [k[0]] * len(out), "status": out})

    rows = events.select(F.col(key).alias("key"), F.col(status).alias("status"))
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, status string", "status string", "append", GroupStateTimeout.NoTimeout)


def server_sent(json: Column) -> Column:
    """An event as a server-sent message."""
    return F.concat(F.lit("data: "), json, F.lit("\n\n"))


def index_stream(pages: DataFrame, index: Callable[[DataFrame], None], checkpoint: str):
    """Index each micro-batch of a page stream. ``index`` must be idempotent: a batch may come twice."""
    return (
        pages.writeStream.foreachBatch(lambda batch, _: index(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
