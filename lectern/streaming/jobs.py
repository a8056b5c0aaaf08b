"""Job state and stuck work from change feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import labels


def current_jobs(patches: DataFrame, fields: list[str]) -> DataFrame:
    """Latest value of every patched field per job, batch or stream (update/complete).

    ``patches`` has id, seq, at and ``fields``, a map of field to text. A field that
    was set to NULL explicitly is NULL; one never patched is NULL too and listed in
    no ``touched`` entry.
    """
    values, touched = [], []
    for name in fields:
        has = F.map_contains_key("fields", name)
        cell = F.struct(F.element_at("fields", name).alias("v"))
        values.append(F.max_by(cell, F.when(has, F.col("seq"))).alias(name))
        touched.append(F.when(F.max(has), F.lit(name)))
    state = patches.groupBy("id").agg(
        *values, F.array_compact(F.array(*touched)).alias("touched"),
        F.max_by("at", "seq").alias("updated_at"),
    )
    return state.select(
        "id", *[F.col(f"{n}.v").alias(n) for n in fields], "touched", "updated_at"
    )


def last_stages(events: DataFrame) -> DataFrame:
    """Latest stage of every job and when it began."""
    return events.groupBy("job").agg(
        F.max("ts").alias("since"), F.max_by("stage", "ts").alias("stage")
    )


def stuck_at(
    last: DataFrame, now: Column, timeout_seconds: int = labels.SWEEP_SECONDS
) -> DataFrame:
    """Batch twin of the detector: queued or running for longer than the timeout at ``now``."""
    idle = F.timestamp_diff("MICROSECOND", F.col("since"), now)
    waiting = F.col("stage").isin("queued", "running")
    return last.where(waiting & (idle > timeout_seconds * 1_000_000)).select(
        "job", "stage", "since"
    )


def stuck_jobs(
    events: DataFrame, watermark: str, timeout_seconds: int = labels.SWEEP_SECONDS
) -> DataFrame:
    """Streaming detector: a row when a queued or running job makes no progress in time.

    State per job is its last stage and time. The timer runs on event time, so the
    result does not depend on when batches happen to arrive. Events later than the
    ``watermark`` are not seen; how late they may come is for the caller to say.
    """
    wait = timeout_seconds * 1000
    kind = events.schema["job"].dataType.simpleString()

    def follow(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            stage, since = state.get
            state.remove()
            yield pd.DataFrame(
                {"job": [key[0]], "stage": [stage], "since": [pd.Timestamp(since, unit="ms")]}
            )
            return
        stage, since = state.get if state.exists else (None, -1)
        for rows in batches:
            times = rows["ts"].astype("datetime64[ms]").astype("int64")
            latest = times.idxmax()
            if int(times[latest]) >= since:
                stage, since = rows["stage"][latest], int(times[latest])
        if stage in ("queued", "running"):
            state.update((stage, since))
            state.setTimeoutTimestamp(max(since + wait, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return (
        events.withWatermark("ts", watermark)
        .groupBy("job")
        .applyInPandasWithState(
            follow, f"job {kind}, stage string, since timestamp", "stage string, since long",
            "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


def stage_funnel(events: DataFrame, window: str, watermark: str | None = None) -> DataFrame:
    """Stage changes per tumbling window, batch or stream."""
    timed = events if watermark is None else events.withWatermark("ts", watermark)
    counted = timed.groupBy(F.window("ts", window), "stage").agg(F.count(F.lit(1)).alias("changes"))
    return counted.select(F.col("window.start").alias("window_start"), "stage", "changes")
