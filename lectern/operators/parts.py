"""Splitting long sources into parts that succeed or fail on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import labels
from ..functions.naming import page_part_title, time_part_title
from . import scan
from .intervals import point_in_interval


def plan_time_parts(
    sources: DataFrame, part_seconds: float = labels.PART_SECONDS, at_least: int = 2
) -> DataFrame:
    """Equal parts of long sources: ``(source_id, part, part_start, part_end, part_len)``.

    The count is the duration over the part length, rounded half to even. Sources
    with fewer than ``at_least`` parts are not split and give no rows; with
    ``at_least`` 1 every source gets at least one (speech chunks).
    """
    parts = F.bround(F.col("duration") / part_seconds, 0).cast("int")
    if at_least <= 1:
        parts = F.greatest(F.lit(1), parts)
    planned = sources.withColumn("parts", parts).where(F.col("parts") >= max(at_least, 1))
    length = F.col("duration") / F.col("parts")
    return planned.select(
        "source_id", "parts", length.alias("part_len"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    ).select(
        "source_id", "parts", "part", "part_len",
        (F.col("part") * F.col("part_len")).alias("part_start"),
        (F.col("part") * F.col("part_len") + F.col("part_len")).alias("part_end"),
    )


def assign_parts(rows: DataFrame, parts: DataFrame, t: str = "start") -> DataFrame:
    """Rows with the part whose half-open span holds their time."""
    spans = parts.select("source_id", "part", "part_start", "part_end")
    return point_in_interval(
        rows, spans, ["source_id"], t, "part_start", "part_end", how="inner"
    ).drop("part_start", "part_end")


def unassigned_rows(rows: DataFrame, parts: DataFrame, t: str = "start") -> DataFrame:
    """Rows of split sources that lie outside every part, reported rather than lost."""
    split = rows.join(parts.select("source_id").distinct(), "source_id", "left_semi")
    spans = parts.select("source_id", "part", "part_start", "part_end")
    return point_in_interval(
        split, spans, ["source_id"], t, "part_start", "part_end", how="left_anti"
    )


def number_parts(
    segments: DataFrame, keys: tuple[str, ...] = ("source_id",), start: int = 0
) -> DataFrame:
    """Add ``number``: the position of each row of a source along ``(start, seq)``."""
    cut = segments.withColumn("_block", scan.block_of(F.col("start"), scan.BLOCK_SECONDS))
    return scan.number_rows(cut, list(keys), ["start", "seq"], "_block", "number", start=start)


def empty_parts(parts: DataFrame, assigned: DataFrame) -> DataFrame:
    """Error rows for parts that received nothing."""
    missing = parts.join(
        assigned.select("source_id", "part").distinct(), ["source_id", "part"], "left_anti"
    )
    return missing.select("source_id", "part", F.lit(labels.EMPTY_PART).alias("error"))


def titled_time_parts(parts: DataFrame, sources: DataFrame) -> DataFrame:
    """Parts with their library titles."""
    return parts.join(sources.select("source_id", "title"), "source_id").withColumn(
        "part_title",
        time_part_title(F.col("title"), F.col("part"), F.col("part_start"), F.col("part_len")),
    )


def plan_page_parts(
    pages: DataFrame, per: int = labels.PART_PAGES, block_rows: int = scan.BLOCK_ROWS
) -> DataFrame:
    """Pages of long sources with their part: equal slices by position."""
    counts = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("_pages"))
    wanted = F.bround(F.col("_pages") / per, 0).cast("long")
    sized = counts.withColumn("_n", wanted).where(F.col("_n") >= 2).select(
        "source_id", F.expr("(_pages + _n - 1) div _n").alias("_per")
    )
    placed = scan.number_rows(
        pages.withColumn("_block", scan.block_of(F.col("number"), block_rows)),
        ["source_id"], ["number"], "_block", "_pos",
    )
    return (
        placed.join(sized, "source_id")
        .withColumn("part", F.expr("_pos div _per"))
        .drop("_pos", "_per", "_block")
    )


def page_part_table(parted: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per page part: span, title, and an error when nothing is readable."""
    table = parted.groupBy("source_id", "part").agg(
        F.min("number").alias("first_page"), F.max("number").alias("last_page"),
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.trim("text") != "").alias("readable"),
    )
    title = page_part_title(
        F.col("title"), F.col("part"), F.col("first_page"), F.col("last_page")
    )
    error = F.when(F.col("readable") == 0, F.lit(labels.UNREADABLE_PART))
    return table.join(sources.select("source_id", "title"), "source_id").select(
        "source_id", "part", "first_page", "last_page", "pages",
        title.alias("part_title"), error.alias("error"),
    )


def parent_rollup(parts: DataFrame) -> DataFrame:
    """Parent facts from its parts: counts, and labels of the first good part.

    ``parts`` has parent_id, part, ok, learning_type, tur and topics.
    """
    good = F.when(F.col("ok"), F.col("part"))
    first = F.min_by(F.struct("learning_type", "tur", "topics"), good)
    return parts.groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("parts"), F.count_if(~F.col("ok")).alias("parts_failed"),
        F.when(F.count(good) > 0, first).alias("_first"),
    ).select(
        "parent_id", "parts", "parts_failed",
        F.coalesce("_first.learning_type", F.lit(labels.DEFAULT_TYPE)).alias("learning_type"),
        F.coalesce("_first.tur", F.lit(labels.DEFAULT_TYPE)).alias("tur"),
        F.coalesce("_first.topics", F.array().cast("array<string>")).alias("topics"),
    )


def progress(parts: DataFrame) -> DataFrame:
    """``k/n parça bitti`` per parent from per-part completion flags."""
    return parts.groupBy("parent_id").agg(
        F.concat(
            F.count_if("ok").cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string"),
            F.lit(" parça bitti"),
        ).alias("stage"),
        (F.count_if("ok") / F.count(F.lit(1))).alias("fraction"),
    )


def stage_fraction(stage):
    """Fraction done in a ``k/n ...`` or ``pages:k/n`` stage; NULL for any other."""
    done = F.regexp_extract(stage, r"(\d+)/(\d+)", 1).try_cast("double")
    total = F.regexp_extract(stage, r"(\d+)/(\d+)", 2).try_cast("double")
    return done / F.nullif(total, F.lit(0.0))
