"""Topic sections: windows, marks, assignment and oversize splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import labels
from ..functions.text import ends_sentence
from ..functions.timecode import stamped_line
from . import scan
from .folds import Rule, assign_groups, group_rows, keep_spaced
from .stage import stage
from .transcripts import join_ordered

SOURCE = ["source_id"]


def line_cost(text: Column) -> Column:
    """Budget a segment uses: its characters plus the time stamp."""
    return F.length(text) + labels.LINE_OVERHEAD


def boundary_windows(
    segments: DataFrame, limit: int, block_rows: int = scan.BLOCK_ROWS
) -> DataFrame:
    """Segments with the ``window_id`` of their boundary request.

    A window closes once it reaches ``limit``; a last window under a third of the
    limit joins the one before.
    """
    rule = Rule("after", limit, merge_below=limit // 3)
    slim = segments.select(*SOURCE, "seq", line_cost(F.col("text")).alias("cost"))
    pieces = group_rows(slim, SOURCE, "seq", F.col("cost"), rule, block_rows=block_rows)
    return assign_groups(segments, pieces, SOURCE, "seq", block_rows)


def repair_windows(
    segments: DataFrame, limit: int, gap: float = 0.8, block_rows: int = scan.BLOCK_ROWS
) -> DataFrame:
    """Segments with the ``window_id`` of their repair request.

    Past ``limit`` a window closes at a sentence end, before a pause longer than
    ``gap``, at the end of the source, or when it exceeds one and a half limits.
    """
    slim = segments.select(
        *SOURCE, "seq", "start", "end", line_cost(F.col("text")).alias("cost"),
        ends_sentence(F.col("text")).alias("stop"),
        scan.block_of(F.col("seq"), block_rows).alias("_block"),
    )
    ahead = scan.next_value(slim, SOURCE, ["seq"], "_block", {"start": "next_start"})
    pause = F.coalesce(F.col("next_start") - F.col("end") > gap, F.lit(True))
    rule = Rule("after", limit, hard=limit * 1.5)
    pieces = group_rows(
        ahead, SOURCE, "seq", F.col("cost"), rule, ok=F.col("stop") | pause,
        block_rows=block_rows,
    )
    return assign_groups(segments, pieces, SOURCE, "seq", block_rows)


def window_table(windowed: DataFrame) -> DataFrame:
    """One row per window: span and stamped text."""
    line = stamped_line(F.col("start"), F.col("text"))
    return windowed.groupBy("source_id", "window_id").agg(
        F.min_by("start", "seq").alias("first_start"),
        F.max_by("end", "seq").alias("last_end"),
        F.count(F.lit(1)).alias("segments"),
        join_ordered(["seq"], line, "\n").alias("text"),
    )


def valid_marks(marks: DataFrame, windows: DataFrame, ends: DataFrame) -> DataFrame:
    """Marks inside their own window and before the end of the source."""
    spans = windows.select("source_id", "window_id", "first_start", "last_end")
    return (
        marks.join(spans, ["source_id", "window_id"])
        .where(F.col("ts").between(F.col("first_start"), F.col("last_end")))
        .join(ends, "source_id")
        .where(F.col("ts") < F.col("end_of_source"))
        .select(*marks.columns)
    )


def thin_marks(
    marks: DataFrame, min_gap: float = labels.MIN_SECTION_SECONDS,
    block_seconds: float = scan.BLOCK_SECONDS,
) -> DataFrame:
    """Drop marks closer than ``min_gap`` to the last kept mark of their source."""
    return keep_spaced(marks, SOURCE, "ts", ["ts", "seq"], min_gap, block_seconds)


def section_skeleton(marks: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source_id, title, sec_start, sec_end)`` that covers every source.

    ``sources`` has ``title`` and ``end_of_source``. A source without marks is one
    section; a first mark after zero gets an introduction before it.
    """
    first = marks.groupBy("source_id").agg(F.min("ts").alias("_first"))
    lead_in = (
        sources.join(first, "source_id", "left")
        .where(F.col("_first").isNull() | (F.col("_first") > 0))
        .select(
            "source_id",
            F.when(F.col("_first").isNull(), F.col("title"))
            .otherwise(F.lit(labels.INTRO_TITLE)).alias("title"),
            F.lit(0.0).alias("sec_start"),
        )
    )
    starts = lead_in.unionByName(
        marks.select("source_id", "title", F.col("ts").cast("double").alias("sec_start"))
    ).withColumn("_block", scan.block_of(F.col("sec_start"), scan.BLOCK_SECONDS))
    linked = scan.next_value(starts, SOURCE, ["sec_start"], "_block", {"sec_start": "_next"})
    return linked.join(sources.select("source_id", "end_of_source"), "source_id").select(
        "source_id", "title", "sec_start",
        F.coalesce("_next", F.col("end_of_source") + 1).alias("sec_end"),
    )


def _as_of_section(segments: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Segments with ``_s``, the last section that begins by then."""
    cell = F.struct("sec_start", "sec_end", "title")
    return scan.running_max(segments, skeleton, SOURCE, "start", "sec_start", cell, "_s")


def assign_sections(segments: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Segments with the title and start of the section they fall into: an as-of join."""
    return _as_of_section(segments, skeleton).where(F.col("start") < F.col("_s.sec_end")).select(
        *segments.columns, F.col("_s.title").alias("sec_title"), "_s.sec_start")


def outside_sections(segments: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Segments that no section takes: those ``assign_sections`` leaves out."""
    within = F.coalesce(F.col("start") < F.col("_s.sec_end"), F.lit(False))
    return _as_of_section(segments, skeleton).where(~within).drop("_s")


def section_table(assigned: DataFrame, keys: tuple[str, ...] = ("sec_start",)) -> DataFrame:
    """One row per non-empty section; its span is that of its own segments."""
    return assigned.groupBy("source_id", *keys).agg(
        F.first("sec_title").alias("title"),
        F.min_by("start", F.struct("start", "seq")).alias("start"),
        F.max_by("end", F.struct("start", "seq")).alias("end"),
        F.count(F.lit(1)).alias("segments"),
    )


def _distinct_starts(sections: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` (source_id, sec_start, window_id, _first) with ``_own``, a start no other row has.

    Ties are spread over the gap up to the next start of the source, a microsecond apart
    or, at large times, a few steps of the number format.
    """
    keys = ["source_id", "sec_start"]
    marks = sections.select("source_id", F.col("sec_start").alias("_v")).unionByName(
        parts.select("source_id", F.col("_first").alias("_v"))).distinct()
    linked = scan.next_value(
        marks.withColumn("_block", scan.block_of(F.col("_v"), scan.BLOCK_SECONDS)), SOURCE, ["_v"], "_block",
        {"_v": "_next"})
    alike = Window.partitionBy(*keys, "_first")
    rank = F.row_number().over(alike.orderBy("window_id")) - F.when(
        F.col("_first") == F.col("sec_start"), 0).otherwise(1)
    placed = parts.withColumn("_rank", rank).withColumn("_ties", F.count(F.lit(1)).over(alike))
    room = (F.col("_next") - F.col("_first")) / (F.col("_ties") + 1)
    step = F.least(F.greatest(F.lit(1e-6), F.abs("_first") * 1e-15), room)
    return placed.join(
        linked.select("source_id", F.col("_v").alias("_first"), "_next"), ["source_id", "_first"]
    ).select(*keys, "window_id", F.when(F.col("_rank") == 0, F.col("_first")).otherwise(
        F.col("_first") + F.col("_rank") * step).alias("_own"))


def split_oversized(
    assigned: DataFrame, limit: int, block_rows: int = scan.BLOCK_ROWS
) -> DataFrame:
    """Add ``part_no`` and a numbered title where a section's text exceeds ``limit``.

    A part is a section of its own from here on: the first keeps the section's
    ``sec_start``, later ones start where their first segment does, so that requests,
    notes and ledgers have one row per part. Parts that begin at the same instant, or with
    their section, are told apart by a microsecond, or less where the next start is nearer.
    Sections that fit keep ``part_no`` NULL, their start and their title.
    """
    keys = ["source_id", "sec_start"]
    line = F.length(stamped_line(F.col("start"), F.col("text")))
    big = (
        assigned.groupBy(*keys)
        .agg((F.sum(line) + F.count(F.lit(1)) - 1).alias("_chars"))
        .where(F.col("_chars") > limit)
        .select(*keys)
    )
    slim = assigned.select(*keys, "seq", line_cost(F.col("text")).alias("cost"))
    pieces = stage(group_rows(
        slim.join(big, keys, "left_semi"), keys, "seq", F.col("cost"), Rule("before", limit),
        block_rows=block_rows,
    ))
    # the starts of parts are looked up by the pieces, so that texts are dealt once
    times = assigned.select(*keys, "seq", "start").join(pieces.select(*keys).distinct(), keys, "left_semi")
    opened = assign_groups(times, pieces.where(F.col("window_id") > 0), keys, "seq", block_rows).groupBy(
        *keys, "window_id").agg(F.min("start").alias("_first"))
    own = _distinct_starts(assigned.select(*keys).distinct(), opened)
    placed = assign_groups(
        assigned, pieces.join(own, [*keys, "window_id"], "left"), keys, "seq", block_rows, how="left", more=("_own",))
    suffix = F.concat(
        F.lit(" ("),
        F.replace(
            F.lit(labels.SPLIT_SUFFIX), F.lit("{k}"), (F.col("window_id") + 1).cast("string")
        ),
        F.lit(")"),
    )
    title = F.concat("sec_title", F.coalesce(suffix, F.lit("")))
    return (
        placed.withColumn("sec_start", F.coalesce("_own", "sec_start"))
        .withColumn("sec_title", title)
        .select(*[c for c in assigned.columns], F.col("window_id").alias("part_no"))
    )


def close_ends(repaired: DataFrame, windows: DataFrame) -> DataFrame:
    """Set ``end`` to the next start in the window, or to the window's end."""
    keys = ["source_id", "window_id"]
    marked = repaired.withColumn("_block", scan.block_of(F.col("start"), scan.BLOCK_SECONDS))
    linked = scan.next_value(marked, keys, ["start", "seq"], "_block", {"start": "_next"})
    return linked.join(windows.select(*keys, "last_end"), keys).select(
        *[c for c in repaired.columns if c != "end"],
        F.coalesce("_next", "last_end").alias("end"),
    )
