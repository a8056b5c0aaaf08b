"""Paged sources: the text gate, capping, numbering and the page ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import labels
from ..functions.text import is_blank, real_word_ratio, strip, word_count
from .screen import clean_lines


def pages_to_segments(pages: DataFrame) -> DataFrame:
    """Readable pages on a timeline where page N lasts from N to N + 1."""
    number = F.col("number")
    return pages.where(~is_blank(F.col("text"))).select(
        "source_id", number.cast("long").alias("seq"),
        number.cast("double").alias("start"), (number.cast("double") + 1).alias("end"), "text",
    )


def gate_pages(
    page_inputs: DataFrame, min_chars: int = labels.MIN_TEXT_LAYER_CHARS,
    min_ratio: float = labels.MIN_WORD_RATIO, min_conf: float = labels.OCR_CONF_MIN,
) -> DataFrame:
    """Choose the text layer or the OCR read of each page; quarantine the unreadable.

    The layer is used when it is long enough and does not look garbled. Otherwise
    the OCR read is used, quarantined when its confidence is low or unknown.
    """
    layer = strip(F.coalesce("text_layer", F.lit("")))
    # given out by a generator, the ratio is worked out once a page: as a plain column it
    # would be repeated in every filter on the text that follows
    once = F.struct(layer.alias("layer"), real_word_ratio(layer).alias("ratio"))
    rated = page_inputs.withColumn("_once", F.explode(F.array(once))).withColumns(
        {"_layer": F.col("_once.layer"), "_ratio": F.col("_once.ratio")}
    )
    good = (F.length("_layer") >= min_chars) & (
        F.col("_ratio").isNull() | (F.col("_ratio") >= min_ratio)
    )
    bad = F.coalesce(F.col("ocr_conf") < min_conf, F.lit(True))
    return rated.select(
        "source_id", "number",
        F.when(good, F.col("_layer"))
        .when(bad, F.lit(""))
        .otherwise(clean_lines(F.col("ocr_text"))).alias("text"),
        F.when(good, labels.SOURCE_TEXT_LAYER).otherwise(labels.SOURCE_OCR).alias("source"),
        F.when(~good, F.bround(F.col("ocr_conf").cast("double"), 1)).alias("conf"),
        (~good & bad).alias("quarantined"),
        F.bround("_ratio", 3).alias("word_ratio"),
    )


def cap_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """All pages, or the first ``max_pages`` of each source where a caller asks for a cut.

    ``page_coverage`` reports what a cut leaves out.
    """
    if max_pages is None:
        return pages
    return pages.where(F.col("number") <= max_pages)


def page_coverage(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """How many pages a source has and how many are processed."""
    return pages.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(
            F.lit(True) if max_pages is None else F.col("number") <= max_pages
        ).alias("processed"),
    ).withColumn("truncated", F.col("processed") < F.col("total"))


def page_ledger(pages: DataFrame) -> DataFrame:
    """What became of the pages of each source."""
    return pages.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(~F.col("quarantined") & ~is_blank(F.col("text"))).alias("pages_read"),
        F.count_if(F.col("source") == labels.SOURCE_TEXT_LAYER).alias("pages_text_layer"),
        F.count_if((F.col("source") == labels.SOURCE_OCR) & ~F.col("quarantined"))
        .alias("pages_ocr"),
        F.count_if("quarantined").alias("pages_quarantined"),
        F.min("word_ratio").alias("min_word_ratio"),
    )


def text_volume(pages: DataFrame) -> DataFrame:
    """Words and blocks per source."""
    return pages.groupBy("source_id").agg(
        F.sum(word_count(F.col("text"))).alias("words"), F.count(F.lit(1)).alias("blocks")
    )
