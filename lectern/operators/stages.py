"""Time spent per stage, from stage-change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan


def stage_durations(events: DataFrame, block_seconds: int = 600) -> DataFrame:
    """Seconds from each stage change to the job's next one; NULL for the last.

    ``events`` has job, event_id, ts (timestamp), ``seconds`` (epoch seconds) and
    stage.
    """
    cut = events.withColumn("_block", scan.block_of(F.col("seconds"), block_seconds))
    linked = scan.next_value(cut, ["job"], ["seconds", "event_id"], "_block", {"seconds": "_next"})
    return linked.select(
        "job", "event_id", "stage", "seconds", (F.col("_next") - F.col("seconds")).alias("lasted")
    )


def stage_totals(durations: DataFrame) -> DataFrame:
    """Funnel over all jobs: changes into each stage and time spent there."""
    return durations.groupBy("stage").agg(
        F.count(F.lit(1)).alias("changes"), F.sum("lasted").alias("seconds"),
        F.count("lasted").alias("completed"),
    )
