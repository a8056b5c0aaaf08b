"""Interval joins and coverage on a shared timeline.

Coverage is a running maximum of ends (``scan.running_max``). In the joins both sides carry an equality key and a time bucket, so the join hashes on
``(key, bucket)``: one long source is spread over its buckets, a hot bucket can be
split by adaptive execution, and no plan falls back to a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

BUCKET = 600.0


def _bucket(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("long")


def spread(
    intervals: DataFrame, rows: DataFrame, keys: list[str], t: str, lo: str, hi: str,
    width: float = BUCKET,
) -> DataFrame:
    """One row per interval and bucket it covers, clamped to where rows exist.

    The clamp makes open ends (infinity) and far-off ends cost nothing.
    """
    extent = rows.groupBy(*keys).agg(
        F.min(_bucket(F.col(t), width)).alias("_from"),
        F.max(_bucket(F.col(t), width)).alias("_to"),
    )
    first = F.greatest(_bucket(F.col(lo), width), F.col("_from"))
    last = F.least(_bucket(F.col(hi), width), F.col("_to"))
    return (
        intervals.join(extent, keys)
        .withColumn("_first", first)
        .withColumn("_last", last)
        .where(F.col("_first") <= F.col("_last"))
        .withColumn("_bucket", F.explode(F.sequence("_first", "_last")))
        .drop("_from", "_to", "_first", "_last")
    )


def point_in_interval(
    rows: DataFrame, intervals: DataFrame, keys: list[str], t: str, lo: str, hi: str,
    how: str = "left", closed: bool = False, width: float = BUCKET,
) -> DataFrame:
    """Join each row to the intervals of its key that contain its time.

    Intervals are half open unless ``closed``. Interval columns must not clash
    with row columns other than the keys.
    """
    spans = spread(intervals, rows, keys, t, lo, hi, width)
    left = rows.withColumn("_bucket", _bucket(F.col(t), width))
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*keys, "_bucket"]]
    inside = (F.col(t) <= F.col(hi)) if closed else (F.col(t) < F.col(hi))
    condition = (F.col(t) >= F.col(lo)) & inside
    for clause in same:
        condition = condition & clause
    joined = left.alias("l").join(spans.alias("r"), condition, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bucket")
    extra = [F.col(f"r.{c}") for c in intervals.columns if c not in keys]
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], *extra)


def flag_inside(
    rows: DataFrame, intervals: DataFrame, keys: list[str], t: str, lo: str, hi: str,
    name: str, block_seconds: float = scan.BLOCK_SECONDS,
) -> DataFrame:
    """Boolean: does any closed interval of the key contain the row's time?

    One does exactly where the largest end of all intervals begun by then is not over, so
    intervals are neither joined nor repeated however many overlap.
    """
    spans = intervals.where(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    reached = scan.running_max(rows, spans, keys, t, lo, F.col(hi).cast("double"), "_reach", block_seconds)
    inside = F.coalesce(F.col("_reach") >= F.col(t), F.lit(False))
    return reached.withColumn(name, inside).drop("_reach")


def coalesced(
    intervals: DataFrame, keys: list[str], lo: str, hi: str, block_seconds: float = scan.BLOCK_SECONDS,
) -> DataFrame:
    """Disjoint intervals (keys, lo, hi) that cover what the closed ``intervals`` cover.

    An interval opens a new stretch where it begins after the largest end before it; that
    end and the number of stretches are carried from block to block.
    """
    cut = intervals.select(*keys, lo, hi, scan.block_of(F.col(lo), block_seconds).alias("_block")).where(
        F.col(lo).isNotNull() & F.col(hi).isNotNull())
    seen = scan.with_carry(cut, keys, "_block", {"_m": F.max(hi)}, {"_before": (F.max("_m"), "before")})
    inside = Window.partitionBy(*keys, "_block").orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max(hi).over(inside), F.col("_before"))
    opened = seen.withColumn("_new", F.coalesce(F.col(lo) > reach, F.lit(True)).cast("int")).drop("_before")
    numbered = scan.running_sum(opened, keys, [lo, hi], "_block", "_new", "_stretch")
    return numbered.groupBy(*keys, "_stretch").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_stretch")
