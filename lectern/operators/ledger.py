"""The honest ledger: what was added, compressed, read and left unread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import labels
from ..functions.text import coerce_enum, is_blank, strip, tr_sort_key, word_count
from ..functions.text import glossary_key
from ..functions.timecode import fmt_ts, stamped_line

SECTION = ["source_id", "sec_start"]


def admit_critic(items: DataFrame) -> DataFrame:
    """Items with text; unknown kinds and origins are kept but unlabelled."""
    return (
        items.where(~is_blank(F.col("text")))
        .withColumn("text", strip(F.col("text")))
        .withColumn("kind", coerce_enum(F.col("kind"), labels.CRITIC_KINDS))
        .withColumn("origin", coerce_enum(F.col("origin"), labels.CRITIC_ORIGINS))
    )


def critic_ledger(items: DataFrame) -> DataFrame:
    """Counts per kind in fixed order, from the screen, and in total."""
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.count_if(F.col("kind") == k).alias("n"))
            for k in labels.CRITIC_KINDS
        ]
    )
    return items.groupBy("source_id").agg(
        F.map_from_entries(F.filter(kinds, lambda e: e["n"] > 0)).alias("critic_types"),
        F.count_if(F.col("origin") == labels.ORIGIN_SCREEN).alias("critic_from_screen"),
        F.count(F.lit(1)).alias("critic_added"),
    )


def measurable(df: DataFrame, words_in: str = "words_in", words_out: str = "words_out"):
    """Add ``ratio``; NULL where it would be noise rather than a measurement."""
    enough = (F.col(words_out) > 0) & (F.col(words_in) >= labels.MIN_COMPRESSION_INPUT)
    return df.withColumn("ratio", F.when(enough, F.col(words_in) / F.col(words_out)))


def section_compression(
    assigned: DataFrame, notes: DataFrame, points: DataFrame, frames: DataFrame | None = None
) -> DataFrame:
    """Words in per word out of every measurable section.

    ``assigned`` are segments with ``sec_start`` and ``sec_title``; their rendered
    line counts one extra word for the time stamp. ``notes`` has summary, ``points``
    text, ``frames`` text, all by section.
    """
    spoken = assigned.groupBy(*SECTION).agg(
        F.min("sec_title").alias("title"),
        F.min_by("start", F.struct("start", "seq")).alias("start"),
        F.sum(word_count(stamped_line(F.col("start"), F.col("text")))).alias("_in"),
    )
    said = notes.groupBy(*SECTION).agg(F.sum(word_count(F.col("summary"))).alias("_sum"))
    listed = points.groupBy(*SECTION).agg(F.sum(word_count(F.col("text"))).alias("_points"))
    table = spoken.join(said, SECTION, "left").join(listed, SECTION, "left")
    words_in = F.col("_in")
    if frames is not None:
        shown = frames.groupBy(*SECTION).agg(F.sum(word_count(F.col("text"))).alias("_shown"))
        table = table.join(shown, SECTION, "left")
        words_in = words_in + F.coalesce("_shown", F.lit(0))
    table = table.withColumn("words_in", words_in).withColumn(
        "words_out", F.coalesce("_sum", F.lit(0)) + F.coalesce("_points", F.lit(0))
    )
    return (
        measurable(table)
        .where(F.col("ratio").isNotNull())
        .select(*SECTION, "title", fmt_ts(F.col("start")).alias("ts"), "words_in", "words_out",
                "ratio")
    )


def screen_ledger(frames: DataFrame) -> DataFrame:
    """Screens read, read from silences, and quarantined, per source."""
    read = ~F.col("quarantined")
    return frames.groupBy("source_id").agg(
        F.count_if(read).alias("frames_used"),
        F.count_if(read & F.col("in_silence")).alias("frames_from_silence"),
        F.count_if("quarantined").alias("frames_quarantined"),
    )


def screen_evidence(frames: DataFrame) -> DataFrame:
    """Every quarantined screen with its measured confidence and image path."""
    return frames.where("quarantined").select("source_id", "frame_idx", "ts", "conf", "path")


def merge_points(points: DataFrame, critic: DataFrame) -> DataFrame:
    """Section points with the critic's additions, in time order.

    Ties keep the original points first. ``rank`` columns give the order, so the
    table needs no sort until it is written.
    """
    base = points.select(*SECTION, "ts", "text", "seq", F.lit(0).alias("added"))
    more = critic.select(*SECTION, "ts", "text", "seq", F.lit(1).alias("added"))
    return base.unionByName(more)


def merge_glossary(terms: DataFrame, synth_terms: DataFrame) -> DataFrame:
    """One entry per source and term key; later wins and synthesis overrides sections.

    Both inputs have source_id, pos, term and definition. ``sort_key`` then ``pos``
    (first appearance) give the Turkish alphabetical order.
    """
    both = terms.withColumn("_stage", F.lit(0)).unionByName(
        synth_terms.withColumn("_stage", F.lit(1)), allowMissingColumns=True
    )
    rank = F.struct("_stage", "pos")
    return (
        both.withColumn("key", glossary_key(F.col("term")))
        .groupBy("source_id", "key")
        .agg(F.max_by(F.struct("term", "definition"), rank).alias("_last"),
             F.min(rank).alias("_first"))
        .select(
            "source_id", "key", "_last.term", "_last.definition",
            F.col("_first._stage").alias("stage"), F.col("_first.pos").alias("pos"),
            tr_sort_key(F.col("_last.term")).alias("sort_key"),
        )
    )


def union_terms(terms: DataFrame, *more: DataFrame) -> DataFrame:
    """Glossary rows of several tables, every row kept; a column one lacks is NULL there."""
    for table in more:
        terms = terms.unionByName(table, allowMissingColumns=True)
    return terms


def sort_terms(terms: DataFrame) -> DataFrame:
    """Terms in Turkish alphabetical order within each source."""
    return terms.orderBy("source_id", tr_sort_key(F.col("term")), "pos")


def processing_seconds(events: DataFrame) -> DataFrame:
    """Whole seconds from the first ``running`` to the last ``done`` stage of a job."""
    started = F.min(F.when(F.col("stage") == "running", F.col("seconds")))
    finished = F.max(F.when(F.col("stage") == "done", F.col("seconds")))
    return events.groupBy("job").agg(
        F.bround(finished - started, 0).cast("long").alias("processing_seconds")
    ).where(F.col("processing_seconds").isNotNull())
