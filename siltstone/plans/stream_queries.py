"""Event, job and indexing queries, and their SQL. Streams run the same expressions (see tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import engine
from ..functions import text
from ..operators import embedding
from ..session import load, spread
from ..streaming import events
from . import markup_sql

#: The job status that each event type of the fixture stands for.
STATUS = {"click": "queued", "view": "running", "purchase": "completed", "signup": "cancelled", "error": "failed"}


def _texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of long texts, on all cores."""
    return spread(load(spark, sf, name))


def _status():
    out = F.lit(None).cast("string")
    for kind, status in STATUS.items():
        out = F.when(F.col("event_type") == kind, status).otherwise(out)
    return out


def event_json(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "JOB_STATUS_CHANGE").when(F.col("event_type") == "view", "JOB_PROGRESS").otherwise("LIBRARY_CHANGE")
    return load(spark, sf, "events").select("event_id", events.envelope(kind, F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("name"))).alias("json"))


def progress_estimate(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = load(spark, sf, "events").select("event_id", n.alias("n"))
    return rows.select("event_id", "n", *text.progress(F.col("n"), 40))


def job_final_state(spark: SparkSession, sf: str) -> DataFrame:
    return events.final_state(load(spark, sf, "events").withColumn("status", _status()), "user_id", "ts", "event_id", "status")


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("jobs"))


def jobs_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return job_final_state(spark, sf).filter("state = 'running'")


def jobs_clear(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("state").isin("completed", "failed", "cancelled")
    return job_final_state(spark, sf).agg(F.count(F.when(done, 1)).alias("cleared"), F.count(F.when(~done, 1)).alias("left"))


def job_queue_head(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").filter("event_type = 'click'").orderBy("ts", "event_id").limit(5).select("event_id", "user_id", "ts")


def job_durations(spark: SparkSession, sf: str) -> DataFrame:
    millis = lambda c: (F.unix_micros(c.cast("timestamp")) / 1000).cast("long")
    rows = load(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("finished"))
    return rows.select("user_id", "started", "finished", (millis(F.col("finished")) - millis(F.col("started"))).alias("ms"))


def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = events.tumbling(load(spark, sf, "events"), "ts", "1 day", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def events_session(spark: SparkSession, sf: str) -> DataFrame:
    out = events.sessions(load(spark, sf, "events"), "ts", "30 minutes", "user_id")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def progress_throttle(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return events.throttle(rows, "user_id", "at", 5, 7200.0).select("user_id", "at")


def rate_limit_sim(spark: SparkSession, sf: str) -> DataFrame:
    rows = _texts(spark, sf, "documents").select("source", (F.col("doc_id") * 0.05).alias("at"), text.estimate_tokens(F.col("text")).alias("tokens"))
    out = embedding.simulate_limits(rows, "source", "at", "tokens", 60, 20_000, 0.1)
    return out.select("key", F.round("at", 2).alias("at"), "tokens", F.round("waited", 3).alias("waited"))


def index_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages converted, split and embedded: the rows that indexing stores."""
    return engine.index_rows(_texts(spark, sf, "pages"), embedding.create("hash:hash-64")).select("page_id", "sort_order", "content", "level", F.size("embedding").cast("long").alias("dim"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}

_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
_FINAL = f"SELECT user_id, arg_max({_STATUS}, struct_pack(ts := ts, id := event_id)) AS state FROM events GROUP BY user_id"

SQL = markup_sql.STREAMS | {
    "event_json": """SELECT event_id, to_json({type: k, payload: {type: v, payload: {id: user_id, name: event_type}}})::VARCHAR AS json FROM (
      SELECT *, CASE event_type WHEN 'click' THEN 'JOB_STATUS_CHANGE' WHEN 'view' THEN 'JOB_PROGRESS' ELSE 'LIBRARY_CHANGE' END AS k,
        CASE event_type WHEN 'click' THEN 'JobStatusChange' WHEN 'view' THEN 'JobProgress' ELSE 'LibraryChange' END AS v FROM events)""",
    "progress_estimate": """WITH e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      q AS (SELECT *, CASE WHEN n < 5 THEN greatest(3, n * 2) ELSE greatest(1, n // 3) END::BIGINT AS queue_length FROM e)
      SELECT event_id, n, queue_length, (n + queue_length)::BIGINT AS discovered, greatest(least(n + queue_length, 40), 1)::BIGINT AS total_pages,
        CASE WHEN n < 3 THEN 'discovering' ELSE 'scraping' END AS phase FROM q""",
    "job_final_state": _FINAL,
    "event_counts": "SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS jobs FROM events GROUP BY event_type",
    "jobs_by_status": f"SELECT * FROM ({_FINAL}) WHERE state = 'running'",
    "jobs_clear": f"SELECT count(*) FILTER (state IN ('completed', 'failed', 'cancelled'))::BIGINT AS cleared, count(*) FILTER (state NOT IN ('completed', 'failed', 'cancelled'))::BIGINT AS left FROM ({_FINAL})",
    "job_queue_head": "SELECT event_id, user_id, ts FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 5",
    "job_durations": "SELECT user_id, min(ts) AS started, max(ts) AS finished, (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000)::BIGINT AS ms FROM events GROUP BY user_id",
    "events_tumbling": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL",
    "events_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
      SELECT min(ts) AS start, user_id, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""",
}
