"""Speech-recognition payloads and their chunk offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import labels
from ..functions.text import is_blank, strip
from ..operators import scan

# Fixed value: the payload contract.
PAYLOAD = "segments array<struct<start:double,end:double,text:string>>"


def chunk_offsets(
    listing: DataFrame, chunks: DataFrame, chunk_seconds: float = labels.CHUNK_SECONDS,
    block_rows: int = scan.BLOCK_ROWS,
) -> DataFrame:
    """Start of every chunk: ``(source_id, chunk_idx, offset)``.

    ``listing`` has source_id, line_no and ``line`` (``file,start,end``); ``chunks``
    has source_id and chunk_idx. Lines with too few fields or an unreadable start
    are skipped. If the count of usable lines differs from the count of chunks, the
    whole source takes nominal offsets.
    """
    fields = F.split(strip(F.col("line")), ",")
    usable = listing.select(
        "source_id", "line_no", F.size(fields).alias("_n"),
        F.get(fields, F.lit(1)).try_cast("double").alias("_start"),
    ).where((F.col("_n") >= 3) & F.col("_start").isNotNull())
    numbered = scan.number_rows(
        usable.withColumn("_block", scan.block_of(F.col("line_no"), block_rows)),
        ["source_id"], ["line_no"], "_block", "chunk_idx",
    ).select("source_id", "chunk_idx", "_start")
    listed = usable.groupBy("source_id").agg(F.count(F.lit(1)).alias("_listed"))
    counted = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("_chunks"))
    trusted = counted.join(listed, "source_id", "left").select(
        "source_id", F.coalesce(F.col("_chunks") == F.col("_listed"), F.lit(False)).alias("_ok")
    )
    keyed = chunks.select("source_id", F.col("chunk_idx").cast("long"))
    return (
        keyed.join(trusted, "source_id")
        .join(numbered, ["source_id", "chunk_idx"], "left")
        .select(
            "source_id", "chunk_idx",
            F.when(F.col("_ok"), F.col("_start"))
            .otherwise(F.col("chunk_idx") * F.lit(float(chunk_seconds))).alias("offset"),
        )
    )


def merge_payloads(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary producer's payload of each chunk; the fallback's where it failed or has none."""
    keys = ["source_id", "chunk_idx"]
    spare = fallback.select(*keys, F.col("body").alias("_spare"))
    return primary.join(spare, keys, "full").select(
        *keys, F.coalesce("body", "_spare").alias("body"),
        F.when(F.col("body").isNotNull(), "primary")
        .when(F.col("_spare").isNotNull(), "fallback").alias("producer"),
    )


def asr_segments(payloads: DataFrame, offsets: DataFrame) -> DataFrame:
    """Segments on the source's own timeline; chunk-local times are shifted.

    ``seq`` orders by chunk, then by position in the payload.
    """
    keys = ["source_id", "chunk_idx"]
    rows = payloads.select(
        *keys, F.posexplode(F.from_json("body", PAYLOAD)["segments"]).alias("pos", "s")
    ).where(~is_blank(F.col("s.text")))
    placed = rows.join(offsets, keys)
    return placed.select(
        "source_id", "chunk_idx", "pos",
        (F.col("s.start") + F.col("offset")).alias("start"),
        (F.col("s.end") + F.col("offset")).alias("end"),
        strip(F.col("s.text")).alias("text"),
    )
