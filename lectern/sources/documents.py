"""Markdown and plain text as numbered blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import labels
from ..functions.text import is_blank, strip


def read_text_blocks(
    docs: DataFrame, size: int = labels.BLOCK_CHARS, single: int = labels.SINGLE_BLOCK_CHARS
) -> DataFrame:
    """Blocks of each text: ``(source_id, number, text, source, quarantined)``.

    A first or second level heading opens a block unless only blank lines precede
    it. A text without such a split is cut into windows of ``size`` characters when
    longer than ``single``. Works row by row, without a shuffle.
    """
    body = F.regexp_replace(F.col("text"), r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    pieces = F.transform(F.split(body, r"(?m)^(?=#{1,2}(?U:[^\S\n]))"), strip)
    blocks = F.filter(pieces, lambda b: b != "")
    whole = strip(F.col("text"))
    starts = F.sequence(F.lit(0), F.floor((F.length(whole) - 1) / size).cast("int"))
    windows = F.when(
        F.length(whole) > single,
        F.transform(starts, lambda i: F.substr(whole, i * size + 1, F.lit(size))),
    ).otherwise(F.array(whole))
    chosen = F.when(F.size(blocks) > 1, blocks).otherwise(windows)
    return (
        docs.select("source_id", F.posexplode(chosen).alias("pos", "text"))
        .where(~is_blank(F.col("text")))
        .select(
            "source_id", (F.col("pos") + 1).alias("number"), "text",
            F.lit(labels.SOURCE_TEXT_LAYER).alias("source"), F.lit(False).alias("quarantined"),
        )
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a folder of text files, named by source."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?\z", 1).alias("source_id"),
        F.col("value").alias("text"),
    )
    return read_text_blocks(files)
