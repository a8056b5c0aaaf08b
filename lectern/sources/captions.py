"""Caption JSON: reading, writing and choosing a track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import labels
from ..functions.naming import language_base, safe_name
from ..functions.text import is_blank, squeeze, strip
from ..operators import scan
from .textfiles import write_text_files

# The caption file contract.
EVENTS = (
    "events array<struct<tStartMs:double,dDurationMs:double,aAppend:string,"
    "segs:array<struct<utf8:string>>>>"
)


def parse_captions(tracks: DataFrame, body: str = "body") -> DataFrame:
    """Segments of caption JSON texts; ``tracks`` has source_id and ``body``.

    Events without pieces and rolling repeats are skipped; ``seq`` is the event's
    position in the file.
    """
    events = tracks.select(
        "source_id", F.posexplode(F.from_json(F.col(body), EVENTS)["events"]).alias("seq", "e")
    )
    repeats = F.coalesce(F.lower("e.aAppend"), F.lit("")).isin("", "0", "false")
    text = squeeze(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.coalesce("e.tStartMs", F.lit(0.0)) / 1000
    return (
        events.where((F.coalesce(F.size("e.segs"), F.lit(0)) > 0) & repeats)
        .select(
            "source_id", "seq", start.alias("start"),
            (start + F.coalesce("e.dDurationMs", F.lit(0.0)) / 1000).alias("end"),
            text.alias("text"),
        )
        .where(F.col("text") != "")
    )


def _stem(path):
    return F.regexp_extract(path, r"([^/]+?)(?:\.subs)?\.json3?\z", 1)


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a folder of caption files, named by source."""
    files = spark.read.text(path, wholetext=True).select(
        _stem(F.col("_metadata.file_path")).alias("source_id"), F.col("value").alias("body")
    )
    return parse_captions(files)


def caption_errors(tracks: DataFrame, segments: DataFrame) -> DataFrame:
    """Error rows for caption files without a usable line."""
    return tracks.select("source_id").distinct().join(
        segments.select("source_id"), "source_id", "left_anti"
    ).withColumn("error", F.lit(labels.EMPTY_CAPTIONS))


def caption_events(segments: DataFrame) -> DataFrame:
    """One caption event per non-blank segment as JSON text, in whole milliseconds."""
    length = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    event = F.struct(
        (F.col("start") * 1000).cast("long").alias("tStartMs"),
        (length * 1000).cast("long").alias("dDurationMs"),
        F.array(F.struct(strip(F.col("text")).alias("utf8"))).alias("segs"),
    )
    return segments.where(~is_blank(F.col("text"))).select(
        "source_id", "seq", "start", F.to_json(event).alias("event")
    )


PIECE_EVENTS = 65_536  # of one cell, many hours of speech


def caption_json(segments: DataFrame, events: int = PIECE_EVENTS) -> DataFrame:
    """``(source_id, piece, body)``: the caption document of each source, events by start.

    Long documents come in pieces of ``events`` events, whose texts joined in order are
    the document.
    """
    placed = scan.number_rows(
        caption_events(segments).withColumn("_block", scan.block_of(F.col("start"), scan.BLOCK_SECONDS)),
        ["source_id"], ["start", "seq"], "_block", "_n",
    ).withColumn("piece", F.floor(F.col("_n") / events).cast("long"))
    cells = F.sort_array(F.collect_list(F.struct("_n", "event")))
    joined = F.array_join(F.transform(cells, lambda c: c["event"]), ",")
    last = placed.groupBy("source_id").agg(F.max("piece").alias("_last"))
    return placed.groupBy("source_id", "piece").agg(joined.alias("_text")).join(last, "source_id").select(
        "source_id", "piece", F.concat(
            F.when(F.col("piece") == 0, F.lit('{"events":[')).otherwise(F.lit(",")), "_text",
            F.when(F.col("piece") == F.col("_last"), F.lit("]}")).otherwise(F.lit(""))).alias("body"),
    )


def caption_lines(segments: DataFrame) -> DataFrame:
    """``(source_id, ord, line)``: the lines of each source's caption document, an event a line."""
    place = lambda side, start, seq: F.struct(
        F.lit(side).alias("side"), start.cast("double").alias("start"), seq.cast("long").alias("seq"))
    events = caption_events(segments)
    # the comma stands before every event but the first of its source
    first = events.groupBy("source_id").agg(F.min(F.struct("start", "seq")).alias("_first"))
    rows = events.join(first, "source_id").select(
        "source_id", place(1, F.col("start"), F.col("seq")).alias("ord"),
        F.concat(F.when(F.struct("start", "seq") == F.col("_first"), F.lit("")).otherwise(F.lit(",")), "event").alias("line"))
    none = F.lit(0)
    frame = [first.select("source_id", place(side, none, none).alias("ord"), F.lit(line).alias("line"))
             for side, line in ((0, '{"events":['), (2, "]}"))]
    return rows.unionByName(frame[0]).unionByName(frame[1])


def write_captions(segments: DataFrame, path: str) -> DataFrame:
    """One caption file per source below ``path``, of any length; (path, lines) of the files."""
    name = F.concat(safe_name(F.col("source_id").cast("string")), F.lit(".subs.json3"))
    return write_text_files(caption_lines(segments).select(name.alias("path"), "ord", "line"), path)


def choose_track(tracks: DataFrame, prefs: DataFrame, allow_auto: bool = True) -> DataFrame:
    """The caption track of each source, if any.

    ``tracks`` has source_id, kind (manual/auto), lang and pos; ``prefs`` has
    source_id, pos, lang and ``original``. Preferred languages are tried in order
    on manual tracks: the exact code, else the shortest code of the same base, in
    listing order. Automatic tracks count only in the original language.
    """
    wanted = prefs.where(F.coalesce(F.col("lang"), F.lit("")) != "").select(
        "source_id", F.col("pos").alias("pref"), F.col("lang").alias("want"),
        F.lit("manual").alias("kind"),
    )
    if allow_auto:
        original = prefs.where(F.coalesce(F.col("original"), F.lit("")) != "").select(
            "source_id", F.lit(0).alias("pref"), F.col("original").alias("want"),
            F.lit("auto").alias("kind"),
        ).distinct()
        wanted = wanted.unionByName(original)
    keyed = wanted.withColumn("base", language_base(F.col("want")))
    options = tracks.withColumn("base", language_base(F.col("lang"))).join(
        keyed, ["source_id", "kind", "base"]
    )
    rank = F.struct(
        (F.col("kind") == "auto").alias("auto"), "pref", (F.col("lang") != F.col("want")).alias("x"),
        F.length("lang").alias("size"), "pos",
    )
    return options.groupBy("source_id").agg(
        F.min_by(F.struct("lang", (F.col("kind") == "auto").alias("is_auto")), rank).alias("_t")
    ).select("source_id", "_t.lang", "_t.is_auto")
