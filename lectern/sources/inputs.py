"""Input splits and numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stage import stage


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(source_id, line_no, line)`` of a folder of logs, one file per source.

    Files are read in splits, so a log of any length is many tasks. A line's number is its
    place in its split plus the lines of all earlier splits of the file; the lines are
    written once for that, since numbers and counts must come from one reading.
    """
    stem = F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?\z", 1)
    rows = stage(spark.read.text(path).select(
        stem.alias("source_id"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line")))
    splits = rows.groupBy("_file", "_split").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("_file", "_split", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(placed, ["_file", "_split"]).select(
        "source_id", (F.col("_before") + F.col("_id") - F.col("_first")).cast("long").alias("line_no"), "line")
