"""Agent presence from heartbeat pings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import labels
from ..operators import scan
from ..operators.stage import shared_folder, stage
from .run import run_available

# Fixed value: a time that no ping has.
_END_OF_TIME = "9999-12-31 00:00:00"


def presence_sessions(pings: DataFrame, gap_seconds: int = labels.ONLINE_SECONDS) -> DataFrame:
    """Uninterrupted presence: pings at most ``gap_seconds`` apart form a session.

    ``pings`` has agent and ts (TIMESTAMP). Pings of one stretch of ``gap_seconds`` belong
    together, so they are added up where they lie; what is left, one row a stretch, is put
    into sessions by a block scan. No task holds an agent, however many pings it sends.
    """
    gap = gap_seconds * 1_000_000
    us = F.unix_micros("ts")
    cells = pings.where(F.col("ts").isNotNull()).groupBy("agent", F.floor(us / gap).cast("long").alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    cut = stage(cells.withColumn("_block", scan.block_of(F.col("_cell"))))
    linked = scan.previous_value(cut, ["agent"], ["_cell"], "_block", {"_to": "_before"})
    pause = F.unix_micros("_from") - F.unix_micros("_before")
    opened = linked.withColumn("_new", F.coalesce(pause > gap, F.lit(True)).cast("int"))
    numbered = scan.running_sum(opened, ["agent"], ["_cell"], "_block", "_new", "_session")
    return numbered.groupBy("agent", "_session").agg(
        F.min("_from").alias("online_from"), F.max("_to").alias("last_ping"), F.sum("_n").alias("pings"),
    ).drop("_session")


def closed_sessions(
    pings: DataFrame, watermark: str, gap_seconds: int = labels.ONLINE_SECONDS
) -> DataFrame:
    """The sessions of a stream, each given out once, when no ping can extend it any more.

    ``watermark`` is the lateness the stream tolerates. A session is closed when the
    watermark has passed its last ping by the gap, and its state goes then, so the state
    is that of the agents now online. Pings later than the watermark are refused;
    ``run_available`` counts them.
    """
    sessions = pings.withWatermark("ts", watermark).groupBy(
        "agent", F.session_window("ts", f"{gap_seconds} seconds"))
    return sessions.agg(
        F.count(F.lit(1)).alias("pings"), F.min("ts").alias("online_from"),
        F.max("ts").alias("last_ping"),
    ).select("agent", "online_from", "last_ping", "pings")


def all_sessions(
    pings: DataFrame, watermark: str, gap_seconds: int = labels.ONLINE_SECONDS, report: dict | None = None
) -> DataFrame:
    """Every session of a feed that has ended, those open at its end too.

    Sessions are given out as they close, as by ``closed_sessions``. When all there is has
    been read, one ping of nobody at the end of time moves the watermark past the open ones;
    its own session is never given out.
    """
    spark = pings.sparkSession
    feed = pings.select("agent", "ts")
    folder = f"{shared_folder(spark)}/end-{uuid.uuid4().hex}"
    spark.createDataFrame([], feed.schema).write.parquet(folder)

    def close() -> None:
        last = [F.lit(None).cast(feed.schema["agent"].dataType).alias("agent"),
                F.lit(_END_OF_TIME).cast("timestamp").alias("ts")]
        spark.range(1).select(*last).write.mode("append").parquet(folder)

    ended = feed.unionByName(spark.readStream.schema(feed.schema).parquet(folder))
    return run_available(closed_sessions(ended, watermark, gap_seconds), report=report, ending=close)


def agent_status(pings: DataFrame, now, gap_seconds: int = labels.ONLINE_SECONDS) -> DataFrame:
    """Whether each agent is online at ``now`` (a timestamp column or literal)."""
    at = F.lit(now) if not hasattr(now, "alias") else now
    age = F.timestamp_diff("SECOND", F.col("last_ping"), at)
    return pings.groupBy("agent").agg(F.max("ts").alias("last_ping")).select(
        "agent", "last_ping", age.alias("seconds_ago"), (age <= gap_seconds).alias("online")
    )
