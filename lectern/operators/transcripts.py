"""Segments: ordering, assembly and choice between transcript producers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels
from ..functions.text import is_blank, strip
from ..functions.timecode import stamped_line
from . import scan

# Segments per stored transcript piece. A note is read piece by piece, so one
# endless source never has to fit into one string.
PIECE_ROWS = 4096


def join_ordered(order: list[str], text: Column, separator: str) -> Column:
    """Aggregate: texts of a bounded group joined in the given order."""
    cells = F.collect_list(F.struct(*[F.col(o) for o in order], text.alias("_text")))
    return F.array_join(F.transform(F.sort_array(cells), lambda c: c["_text"]), separator)


def assemble_text(
    segments: DataFrame, keys: list[str], stamped: bool = True, name: str = "text"
) -> DataFrame:
    """One text per group, a ``[time] text`` line per segment.

    Meant for sections, windows and pieces, which are bounded by their budgets.
    """
    line = stamped_line(F.col("start"), F.col("text")) if stamped else strip(F.col("text"))
    return segments.groupBy(*keys).agg(join_ordered(["start", "seq"], line, "\n").alias(name))


def with_piece(segments: DataFrame, rows: int = PIECE_ROWS) -> DataFrame:
    """Number the pieces a whole-source transcript is stored in, along ``(start, seq)``."""
    cut = segments.withColumn("_block", scan.block_of(F.col("start"), scan.BLOCK_SECONDS))
    numbered = scan.number_rows(cut, ["source_id"], ["start", "seq"], "_block", "_at")
    return numbered.select(
        *segments.columns, F.floor(F.col("_at") / rows).cast("long").alias("piece")
    )


def transcript_pieces(
    segments: DataFrame, stamped: bool = True, rows: int = PIECE_ROWS
) -> DataFrame:
    """``(source_id, piece, text)``; pieces in order, joined by newlines, are the whole."""
    return assemble_text(with_piece(segments, rows), ["source_id", "piece"], stamped)


def sort_segments(segments: DataFrame) -> DataFrame:
    """All sources by start; list position breaks ties."""
    return segments.orderBy("source_id", "start", "seq")


def source_ends(segments: DataFrame) -> DataFrame:
    """End of each source: the end of its last segment."""
    return segments.groupBy("source_id").agg(F.max_by("end", "seq").alias("end_of_source"))


def choose_transcript(candidates: dict[str, DataFrame]) -> DataFrame:
    """Segments of the first producer, in the given order, that has any for a source.

    A failed or empty producer has no rows and so falls through to the next one.
    """
    tables = [
        df.where(~is_blank(F.col("text")))
        .withColumn("producer", F.lit(name))
        .withColumn("_rank", F.lit(rank))
        for rank, (name, df) in enumerate(candidates.items())
    ]
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table, allowMissingColumns=True)
    best = every.groupBy("source_id").agg(F.min("_rank").alias("_rank"))
    return every.join(best, ["source_id", "_rank"], "left_semi").drop("_rank")


def require_segments(
    sources: DataFrame, segments: DataFrame, reason: str = labels.EMPTY_TRANSCRIPT
) -> DataFrame:
    """Error rows for sources with no usable segment."""
    usable = segments.where(~is_blank(F.col("text"))).select("source_id")
    return (
        sources.select("source_id")
        .join(usable, "source_id", "left_anti")
        .withColumn("error", F.lit(reason))
    )
