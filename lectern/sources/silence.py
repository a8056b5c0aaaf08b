"""Silence windows from detector log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scan


def silence_windows(log: DataFrame, block_rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """``(source_id, start, end)`` from ``(source_id, line_no, line)``.

    A start pairs with the next end; a later start replaces a pending one, an end
    without a start is ignored, and a last open start lasts for ever.
    """
    start = F.regexp_extract("line", r"silence_start:\s*(-?[\d.]+)", 1).try_cast("double")
    end = F.regexp_extract("line", r"silence_end:\s*([\d.]+)", 1).try_cast("double")
    kept = (
        log.select(
            "source_id", "line_no",
            F.when(start.isNotNull(), F.greatest(start, F.lit(0.0))).alias("_start"),
            F.when(start.isNull(), end).alias("_end"),
        )
        .where(F.col("_start").isNotNull() | F.col("_end").isNotNull())
        .withColumn("_block", scan.block_of(F.col("line_no"), block_rows))
    )
    # Only the following line matters: a start is paired exactly when an end follows.
    linked = scan.next_value(
        kept.withColumn("_here", F.lit(True)), ["source_id"], ["line_no"], "_block",
        {"_end": "_next_end", "_here": "_more"},
    )
    starts = linked.where(F.col("_start").isNotNull())
    closed = F.when(F.col("_more").isNull(), F.lit(float("inf"))).otherwise(F.col("_next_end"))
    return starts.select("source_id", F.col("_start").alias("start"), closed.alias("end")).where(
        F.col("end").isNotNull()
    )
