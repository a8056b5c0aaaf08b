"""Reading the jobs table and source metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from ..operators.library import LISTING


def parse_jobs(jobs: DataFrame) -> DataFrame:
    """The listing columns with ``meta`` as a variant; unreadable meta is NULL."""
    return jobs.select(*LISTING, F.try_parse_json("meta").alias("meta"))


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``; those an older table lacks are added as NULL."""
    have = set(df.columns)
    return df.select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name)
            if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def read_evolving(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet folder whose files may predate some columns of ``schema``."""
    return evolve(spark.read.option("mergeSchema", "true").parquet(path), schema)


def read_jobs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The jobs table at ``path`` with parsed meta."""
    return parse_jobs(read_evolving(spark, path, schema))


def normalise_sources(jobs: DataFrame, infos: DataFrame) -> DataFrame:
    """One row per source with title, url and duration from the best place.

    ``jobs`` has id, source, origin_url and title; ``infos`` has id, title,
    webpage_url, duration and measured.
    """
    info = infos.select(
        "id", F.col("title").alias("_title"), "webpage_url", "duration", "measured", "uploader"
    )
    return jobs.join(info, "id", "left").select(
        F.col("id").alias("source_id"),
        F.coalesce(
            blank_to_null(F.col("title")), blank_to_null(F.col("_title")), F.col("source")
        ).alias("title"),
        F.coalesce(
            blank_to_null(F.col("origin_url")), blank_to_null(F.col("webpage_url")),
            F.col("source"),
        ).alias("url"),
        F.coalesce(F.nullif("duration", F.lit(0.0)), "measured").alias("duration"),
        "uploader",
    )
