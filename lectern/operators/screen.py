"""Screen captures: OCR reads, rotation, quarantine, sampling, capping, silence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels
from ..functions.text import strip, strip_word
from ..functions.timecode import fmt_ts
from . import scan
from .intervals import flag_inside, point_in_interval
from .transcripts import join_ordered

SOURCE = ["source_id"]
# Positions of words on one screen are far below this, so the group is bounded
# by what fits on a screen.
_FRAME = ["source_id", "frame_idx"]


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _middle(confs: Column) -> Column:
    """Median of a sorted list."""
    last = F.size(confs) - 1
    two = F.get(confs, F.floor(last / 2).cast("int")) + F.get(confs, F.ceil(last / 2).cast("int"))
    return F.when(last >= 0, two / 2).cast("double")


def _usable_words(words: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """``(*keys, _word)``: the stripped word with its fields, NULL where it is none.

    The struct is made before words are gathered: there it is compiled and each word is
    stripped once, while an expression inside ``collect_list`` is interpreted row by row.
    """
    stripped = words.withColumn("word", strip_word(F.col("word")))
    usable = (F.col("conf") >= 0) & (F.col("word") != "")
    return stripped.select(*keys, F.when(usable, F.struct(*fields)).alias("_word"))


def _word_lists(words: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the usable words in order and their median confidence."""
    # a screen's words are few, so one small list serves both text and median
    grouped = _usable_words(words, keys, "widx", "word", "conf").groupBy(*keys).agg(
        F.sort_array(F.collect_list("_word")).alias("words")
    ).withColumn("_confs", F.sort_array(F.col("words")["conf"]))
    return grouped.select(*keys, "words", _middle(F.col("_confs")).alias("conf"))


def _joined(words: str) -> Column:
    return F.array_join(F.col(words)["word"], " ").alias("text")


def ocr_read(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One read per frame and rotation: joined words and median confidence.

    Rows with negative confidence or blank text are layout records, not words. A
    read without words has empty text and NULL confidence.
    """
    keys = keys or [*_FRAME, "rotation"]
    return _word_lists(words, keys).select(*keys, _joined("words"), "conf")


def best_rotation(
    reads: DataFrame, min_conf: float = labels.OCR_CONF_MIN, content: str = "text"
) -> DataFrame:
    """Per frame: the upright read, or the best of all angles when it is weak.

    A weak read has a confidence below ``min_conf``; ties go to the smaller angle.
    A NULL upright confidence means no words and stays as it is. ``content`` is the
    column a read carries.
    """
    upright = F.col("rotation") == 0
    read = F.struct(content, "conf", "rotation")
    per_frame = reads.groupBy(*_FRAME).agg(
        F.max(F.when(upright, read)).alias("_base"),
        F.max_by(read, F.when(F.col("conf").isNotNull(), F.struct("conf", -F.col("rotation"))))
        .alias("_best"),
    )
    weak = F.col("_base.conf") < min_conf
    chosen = F.when(weak, F.col("_best")).otherwise(F.col("_base"))
    return per_frame.select(*_FRAME, chosen.alias("r")).select(
        *_FRAME, f"r.{content}", "r.conf", "r.rotation"
    )


def read_frames(words: DataFrame, min_conf: float = labels.OCR_CONF_MIN) -> DataFrame:
    """Best read of every frame: ``best_rotation`` of its ``ocr_read``.

    All words of a frame, at every angle, are gathered by one aggregate; reads and the
    choice between them are made on that list, and only the chosen read is made a text. A
    frame is one screen of words. The read is a result of the aggregate, so a condition on
    it stays above and does not work it out again, word by word where it is named in a list.
    """
    usable = _usable_words(words, [*_FRAME, "rotation"], "rotation", "widx", "word", "conf")
    zero = F.lit(0).cast(words.schema["rotation"].dataType)

    def at(found: Column, rotation: Column) -> Column:
        return F.filter(found, lambda w: w["rotation"].eqNullSafe(rotation))

    def rated(found: Column) -> Column:
        turns = F.array_distinct(found["rotation"])
        return F.transform(turns, lambda r: _named(F.sort_array(at(found, r)["conf"]), lambda confs: F.struct(
            _middle(confs).alias("conf"), (-r).alias("rank"), r.alias("rotation"))))

    def choice(reads: Column, upright: Column) -> Column:
        base = F.get(F.filter(reads, lambda r: r["rotation"] == 0), 0)["conf"]
        stays = F.struct(base.alias("conf"), F.when(upright, zero).alias("rotation"))
        best = _named(F.array_max(reads), lambda r: F.struct(r["conf"].alias("conf"), r["rotation"].alias("rotation")))
        return F.when(base < min_conf, best).otherwise(stays)

    def read(frame: Column) -> Column:
        found, upright = frame["words"], frame["upright"]
        # a frame without an upright read has none
        return _named(_named(rated(found), lambda reads: choice(reads, upright)), lambda chosen: F.struct(
            F.when(upright, F.array_join(at(found, chosen["rotation"])["word"], " ")).alias("text"),
            chosen["conf"].alias("conf"), chosen["rotation"].alias("rotation")))

    frame = F.struct(
        F.sort_array(F.collect_list("_word")).alias("words"), F.max(F.col("rotation") == 0).alias("upright"))
    reads = usable.groupBy(*_FRAME).agg(_named(frame, read).alias("_read"))
    return reads.select(*_FRAME, "_read.text", "_read.conf", "_read.rotation")


def clean_lines(text: Column) -> Column:
    """Strip every line and drop the blank ones."""
    rows = F.transform(F.split(text, r"\r\n|\r|\n"), strip)
    return F.array_join(F.filter(rows, lambda row: row != ""), "\n")


def quarantine_frames(
    reads: DataFrame, min_conf: float = labels.OCR_CONF_MIN, min_chars: int = labels.MIN_OCR_CHARS
) -> DataFrame:
    """Drop frames without text; blank, but keep, the ones that cannot be trusted."""
    bad = F.col("conf") < min_conf
    return (
        reads.withColumn("text", clean_lines(F.col("text")))
        .where(F.col("conf").isNotNull() & (F.length("text") >= min_chars))
        .withColumn("quarantined", bad)
        .withColumn("text", F.when(bad, F.lit("")).otherwise(F.col("text")))
        .withColumn("conf", F.bround("conf", 1))
    )


def flag_silence(rows: DataFrame, silences: DataFrame, t: str = "ts") -> DataFrame:
    """Add ``in_silence``: the time lies in a silent window, both ends included."""
    spans = silences.select(
        "source_id", F.col("start").alias("sil_start"), F.col("end").alias("sil_end")
    )
    return flag_inside(rows, spans, SOURCE, t, "sil_start", "sil_end", "in_silence")


def sampling_grid(
    samples: DataFrame, silences: DataFrame, interval: float = labels.SAMPLE_INTERVAL,
    density: int = labels.SILENCE_DENSITY,
) -> DataFrame:
    """Frames to keep: the base grid, denser inside silences.

    ``samples`` has ``frame_idx`` counted on the dense step for sources with
    silences and on the base step for all others. Adds ``ts``.
    """
    dense = interval / density
    loud = silences.select("source_id").distinct().withColumn("_sil", F.lit(True))
    timed = samples.join(loud, SOURCE, "left").withColumn(
        "ts", F.col("frame_idx") * F.when(F.col("_sil"), F.lit(dense)).otherwise(F.lit(interval))
    )
    flagged = flag_silence(timed, silences)
    offset = F.col("ts") % F.lit(interval)
    on_grid = (offset < dense / 2) | (interval - offset < dense / 2)
    keep = F.col("_sil").isNull() | on_grid | F.col("in_silence")
    return flagged.where(keep).drop("_sil")


def cap_frames(frames: DataFrame, n: int | None = None, block_rows: int = scan.BLOCK_ROWS):
    """All frames; with ``n``, sources with more are thinned to at most ``n``, spread evenly.

    The source is cut into ``n`` equal stretches; each keeps its first frame from a
    silence, else its first frame.
    """
    if n is None:
        return frames
    counts = frames.groupBy("source_id").agg(F.count(F.lit(1)).alias("_total"))
    numbered = scan.number_rows(
        frames.withColumn("_block", scan.block_of(F.col("frame_idx"), block_rows)),
        SOURCE, ["frame_idx"], "_block", "_pos",
    )
    step = F.col("_total") / F.lit(float(n))
    # stretch i holds positions from int(i*step) up to int((i+1)*step)
    guess = F.floor(F.col("_pos") / step).cast("long")

    def opens(i: Column) -> Column:
        return F.floor(i * step).cast("long")

    stretch = (
        F.when(opens(guess + 1) <= F.col("_pos"), guess + 1)
        .when(opens(guess) > F.col("_pos"), guess - 1)
        .otherwise(guess)
    )
    placed = numbered.join(counts, SOURCE).withColumn("_slot", stretch)
    chosen = (
        placed.where(F.col("_total") > n)
        .groupBy("source_id", "_slot")
        .agg(F.min_by("frame_idx", F.struct(~F.col("in_silence"), "_pos")).alias("frame_idx"))
        .select("source_id", "frame_idx")
    )
    small = counts.where(F.col("_total") <= n).select("source_id")
    return frames.join(small, SOURCE, "left_semi").unionByName(
        frames.join(chosen, ["source_id", "frame_idx"], "left_semi")
    )


def frames_left_out(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """Frames that a cap thinned away, with the reason."""
    gone = frames.join(kept.select("source_id", "frame_idx"), ["source_id", "frame_idx"], "left_anti")
    return gone.withColumn("reason", F.lit("over the frame cap"))


def frames_to_sections(frames: DataFrame, sections: DataFrame) -> DataFrame:
    """Frames with the ``sec_start`` of their section; the last section is open ended."""
    last = sections.groupBy("source_id").agg(F.max("start").alias("_last"))
    spans = sections.join(last, SOURCE).select(
        "source_id", "sec_start", F.col("start").alias("_lo"),
        F.when(F.col("start") == F.col("_last"), F.lit(float("inf")))
        .otherwise(F.col("end")).alias("_hi"),
    )
    return point_in_interval(frames, spans, SOURCE, "ts", "_lo", "_hi", how="inner").drop(
        "_lo", "_hi"
    )


def frames_to_windows(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Frames with the ``window_id`` whose speech they accompany."""
    spans = windows.select("source_id", "window_id", "first_start", "last_end")
    return point_in_interval(
        frames, spans, SOURCE, "ts", "first_start", "last_end", how="inner"
    ).drop("first_start", "last_end")


def screen_text(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Trusted screen text of each section or window, in time order."""
    trusted = frames.where(~F.col("quarantined") & (F.col("text") != ""))
    entry = F.concat(F.lit("["), fmt_ts(F.col("ts")), F.lit(" ekran]\n"), F.col("text"))
    return trusted.groupBy(*keys).agg(
        join_ordered(["ts", "frame_idx"], entry, "\n\n").alias("screen")
    )


def screen_pieces(frames: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``(keys, piece, screen)``: trusted screen text in pieces of about ``limit`` characters.

    An entry belongs to the piece in which the text before it ends, so a piece is at most
    one entry longer than the limit, and pieces joined by blank lines are ``screen_text``.
    Lengths are added up block by block: a section of any length is many tasks.
    """
    trusted = frames.where(~F.col("quarantined") & (F.col("text") != ""))
    entry = F.concat(F.lit("["), fmt_ts(F.col("ts")), F.lit(" ekran]\n"), F.col("text"))
    cut = trusted.select(
        *keys, "ts", "frame_idx", entry.alias("_entry"), (F.length(entry) + 2).alias("_cost"),
        scan.block_of(F.col("ts"), scan.BLOCK_SECONDS).alias("_block"))
    placed = scan.running_sum(cut, keys, ["ts", "frame_idx"], "_block", "_cost", "_before", inclusive=False)
    return placed.withColumn("piece", F.floor(F.col("_before") / limit).cast("long")).groupBy(*keys, "piece").agg(
        join_ordered(["ts", "frame_idx"], F.col("_entry"), "\n\n").alias("screen"))
