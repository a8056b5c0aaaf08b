"""Whole plans: from segments and model responses to sections and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import compression_tier
from ..operators import ledger, sections
from ..operators.stage import stage


def sectioned(segments: DataFrame, marks: DataFrame, sources: DataFrame) -> DataFrame:
    """Segments with their topic section, from raw marks to assignment.

    Marks and the skeleton are small beside the segments but read repeatedly, so
    both are written on the way.
    """
    kept = stage(sections.thin_marks(marks))
    skeleton = stage(sections.section_skeleton(kept, sources))
    return sections.assign_sections(segments, skeleton)


def first_line_notes(assigned: DataFrame) -> DataFrame:
    """A stand-in note per section: its first line. Used where no model ran."""
    return assigned.groupBy("source_id", "sec_start").agg(
        F.min_by("text", F.struct("start", "seq")).alias("summary")
    )


def compression_report(segments: DataFrame, marks: DataFrame, sources: DataFrame) -> DataFrame:
    """Compression of every measurable section, with its reading aid."""
    assigned = stage(sectioned(segments, marks, sources))
    notes = first_line_notes(assigned)
    none = notes.select("source_id", "sec_start", F.col("summary").alias("text")).where("false")
    measured = ledger.section_compression(assigned, notes, none)
    return measured.select(
        "source_id", "title", "ts", "words_in", "words_out",
        F.bround("ratio", 1).alias("ratio"), compression_tier(F.col("ratio")).alias("tier"),
    )
