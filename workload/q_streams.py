"""Feeds: presence, job state, stuck work, captions as they arrive, stages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import ledger, stages
from lectern.operators.stage import shared_folder
from lectern.sources.captions import write_captions
from lectern.streaming import captions as caption_stream, jobs, presence
from lectern.streaming.run import run_available

from . import fixtures as fx
from .q_library import patches
from .registry import cte, query

GAP = 6 * 3600
_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_STAGE = """CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'transcribe'
  WHEN 'purchase' THEN 'done' ELSE 'error' END"""


def stream_events(spark, sf):
    """The events table as a stream."""
    schema = fx.table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def pings(rows):
    return rows.select(F.col("user_id").alias("agent"), "ts")


def stage_events(rows):
    return rows.selectExpr("user_id AS job", "event_id", "ts", f"{_STAGE} AS stage")


SESSIONS = f"""
SELECT agent, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS online_from, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ping, count(*) AS pings
FROM (SELECT *, sum(n) OVER (PARTITION BY agent ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT user_id AS agent, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= {GAP * 1000000} THEN 0 ELSE 1 END AS n FROM events))
GROUP BY agent, s"""


def _shown(sessions):
    return sessions.select(
        "agent", F.date_format("online_from", _FMT).alias("online_from"),
        F.date_format("last_ping", _FMT).alias("last_ping"), "pings",
    )


@query("s1_presence_sessions", SESSIONS)
def s1(spark, sf):
    return _shown(presence.presence_sessions(pings(fx.events(spark, sf)), GAP))


@query("s1_presence_stream", SESSIONS)
def s1s(spark, sf):
    """All sessions: those the watermark has passed as they close, the others at the end of the feed."""
    return _shown(presence.all_sessions(pings(stream_events(spark, sf)), "1 hour", GAP))


@query("s1_agent_status", f"""
SELECT user_id AS agent, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) // 1000000 AS seconds_ago,
  (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) // 1000000 <= {GAP} AS online FROM events GROUP BY user_id""")
def s1a(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    out = presence.agent_status(pings(fx.events(spark, sf)), now, GAP)
    return out.select("agent", "seconds_ago", "online")


CURRENT = cte(fx.JOBS) + """
SELECT id, CASE WHEN provider <> 'openrouter' AND k % 2 = 0 THEN 'done' ELSE 'running' END AS status,
  CASE WHEN provider <> 'openrouter' AND k % 5 = 0 THEN 'late' END AS error,
  CASE WHEN (provider <> 'openrouter' AND k % 5 = 0) OR k % 3 = 0 THEN 'status,error' ELSE 'status' END AS touched FROM jobs"""


@query("s2_current_jobs", CURRENT)
def s2(spark, sf):
    out = jobs.current_jobs(patches(spark, sf), ["status", "error"])
    return out.select("id", "status", "error", F.array_join("touched", ",").alias("touched"))


@query("s2_current_jobs_stream", CURRENT)
def s2s(spark, sf):
    folder = f"{shared_folder(spark)}/patches-{uuid.uuid4().hex}"
    feed = patches(spark, sf)
    feed.write.parquet(folder)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    out = run_available(jobs.current_jobs(stream, ["status", "error"]), "update", ["id"])
    return out.select("id", "status", "error", F.array_join("touched", ",").alias("touched"))


STUCK_AFTER = 3600
STUCK = f"""
SELECT job, stage, strftime(since, '%Y-%m-%d %H:%M:%S') AS since FROM (
  SELECT user_id AS job, max(ts) AS since, max_by({_STAGE}, ts) AS stage FROM events GROUP BY user_id), (SELECT max(ts) AS now FROM events)
WHERE stage IN ('queued', 'running') AND epoch_us(now) - epoch_us(since) > {STUCK_AFTER * 1000000}"""


@query("s3_stuck_jobs", STUCK)
def s3(spark, sf):
    rows = fx.events(spark, sf)
    now = rows.agg(F.max("ts")).scalar()
    out = jobs.stuck_at(jobs.last_stages(stage_events(rows)), now, STUCK_AFTER)
    return out.select("job", "stage", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("s3_stuck_stream", STUCK)
def s3s(spark, sf):
    out = run_available(jobs.stuck_jobs(stage_events(stream_events(spark, sf)), "0 seconds", STUCK_AFTER))
    return out.select("job", "stage", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("s4_stream_captions", cte(fx.SEGMENTS) + r"""
SELECT CAST(source_id AS VARCHAR) AS source_id, CAST(trunc(start * 1000) AS DOUBLE) / 1000 AS start,
  trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM segments""")
def s4(spark, sf):
    folder = f"{shared_folder(spark)}/captions-{uuid.uuid4().hex}"
    announced = f"{folder}-announced"
    write_captions(fx.segments(spark, sf), folder).select("path").write.parquet(announced)
    out = run_available(caption_stream.stream_captions(spark, folder, announced=announced))
    return out.select("source_id", "start", "text")


@query("s5_stage_durations", cte(fx.EVENTS) + f"""
SELECT user_id AS job, event_id, {_STAGE} AS stage, seconds, lead(seconds) OVER (PARTITION BY user_id ORDER BY seconds, event_id) - seconds AS lasted FROM ev""")
def s5(spark, sf):
    rows = fx.events(spark, sf).selectExpr("user_id AS job", "event_id", "seconds", f"{_STAGE} AS stage")
    return stages.stage_durations(rows)


@query("s5_stage_totals", cte(fx.EVENTS) + f"""
SELECT stage, count(*) AS changes, CAST(sum(lasted) AS BIGINT) AS seconds, count(lasted) AS completed FROM (
  SELECT {_STAGE} AS stage, lead(seconds) OVER (PARTITION BY user_id ORDER BY seconds, event_id) - seconds AS lasted FROM ev) GROUP BY stage""")
def s5t(spark, sf):
    rows = fx.events(spark, sf).selectExpr("user_id AS job", "event_id", "seconds", f"{_STAGE} AS stage")
    return stages.stage_totals(stages.stage_durations(rows))


FUNNEL = f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, {_STAGE} AS stage, count(*) AS changes FROM events GROUP BY ALL"""


def _funnel(out):
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("s5_stage_funnel", FUNNEL)
def s5f(spark, sf):
    return _funnel(jobs.stage_funnel(stage_events(fx.events(spark, sf)), "1 hour"))


@query("s5_stage_funnel_stream", FUNNEL)
def s5s(spark, sf):
    funnel = jobs.stage_funnel(stage_events(stream_events(spark, sf)), "1 hour", "10 minutes")
    return _funnel(run_available(funnel, "update", ["window_start", "stage"]))


@query("e13_processing_seconds", cte(fx.EVENTS) + f"""
SELECT * FROM (SELECT user_id AS job, max(seconds) FILTER (WHERE event_type = 'purchase') - min(seconds) FILTER (WHERE event_type = 'view') AS processing_seconds FROM ev GROUP BY user_id)
WHERE processing_seconds IS NOT NULL""")
def e13(spark, sf):
    rows = fx.events(spark, sf).selectExpr("user_id AS job", "seconds", f"{_STAGE} AS stage")
    return ledger.processing_seconds(rows)
