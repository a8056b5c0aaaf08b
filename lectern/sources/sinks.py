"""Writing transcripts, notes and the library to text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..functions.timecode import stamped_line
from .textfiles import write_text_files


def transcript_lines(segments: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(source_id, ord, line)``: stamped lines, or with ``sources`` the plain variant.

    The plain variant opens with the title and a blank line and skips blank text.
    """
    if sources is None:
        return segments.select(
            "source_id", F.struct("start", "seq").alias("ord"),
            stamped_line(F.col("start"), F.col("text")).alias("line"),
        )
    head = sources.select(
        "source_id", F.explode(F.array(
            F.struct(F.lit(-2).cast("long").alias("seq"), F.concat(F.lit("# "), "title").alias("line")),
            F.struct(F.lit(-1).cast("long").alias("seq"), F.lit("").alias("line")),
        )).alias("h"),
    ).select("source_id", F.lit(float("-inf")).alias("start"), "h.seq", "h.line")
    body = segments.where(~is_blank(F.col("text"))).select(
        "source_id", "start", F.col("seq").cast("long").alias("seq"),
        strip(F.col("text")).alias("line"),
    )
    return head.unionByName(body).select(
        "source_id", F.struct("start", "seq").alias("ord"), "line"
    )


def write_lines(lines: DataFrame, path: str, key: str = "source_id") -> None:
    """Ordered line rows to text files, one folder per ``key`` value.

    Rows are range partitioned on key and order, so one huge source is written by
    many tasks into several files whose names sort in reading order.
    """
    (
        lines.repartitionByRange(key, "ord")
        .sortWithinPartitions(key, "ord")
        .select(key, "line")
        .write.partitionBy(key).mode("overwrite").text(path)
    )


def write_transcripts(
    segments: DataFrame, path: str, repaired: DataFrame | None = None
) -> None:
    """Stamped transcripts; where a repair ran, the raw ones go next to them."""
    final = segments if repaired is None else repaired
    write_lines(transcript_lines(final), f"{path}/transcript")
    if repaired is not None:
        write_lines(transcript_lines(segments), f"{path}/raw")


def write_library(layout: DataFrame, notes: DataFrame, path: str) -> DataFrame:
    """One file per note at its path of ``layout``, lines in order; (path, lines) of the files.

    ``notes`` has id, ord and line. A note of any length is written by many tasks.
    """
    named = notes.join(layout.select("id", "path"), "id")
    return write_text_files(named.select("path", "ord", "line"), path)
