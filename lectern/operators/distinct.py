"""Distinct values in order of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_in_order(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """``(key, value, first)``: each value once with its first position.

    The aggregate combines on the map side, so repeats never travel.
    """
    return df.groupBy(key, value).agg(F.min(position).alias("first"))
