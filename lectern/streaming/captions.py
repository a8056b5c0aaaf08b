"""Caption files picked up as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.captions import parse_captions
from ..sources.textfiles import place, spread

BATCH_BYTES = 1 << 30  # of caption files read in one micro-batch
PASS_BYTES = 8 << 20  # of files handed on together, or one larger file


def _bodies(root: str, glob: str):
    """The bytes of each named file that ``glob`` takes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = place(root)
        for frame in batches:
            paths, bodies, size = [], [], 0
            for path in frame["path"]:
                if not fnmatchcase(path.rpartition("/")[2], glob):
                    continue
                with files.open_input_stream(f"{folder}/{path}") as text:
                    body = text.read()
                if paths and size + len(body) > PASS_BYTES:
                    yield pd.DataFrame({"_path": paths, "value": bodies})
                    paths, bodies, size = [], [], 0
                paths.append(f"{folder}/{path}")
                bodies.append(body)
                size += len(body)
            if paths:
                yield pd.DataFrame({"_path": paths, "value": bodies})

    return run


def stream_captions(
    spark: SparkSession, path: str, max_files: int | None = None, glob: str = "*.subs.json3",
    max_bytes: int = BATCH_BYTES, announced: str | None = None,
) -> DataFrame:
    """Segments of caption files as a stream; each file is read once.

    The source is the file's stem, or the ``source_id=`` folder it lies in. A micro-batch
    takes ``max_bytes`` of files, or ``max_files`` where a caller counts them: files are
    small, and a fixed number of them would make batches as many as the files are.

    A listed folder is kept in the driver, file by file. With ``announced``, a folder of
    Parquet tables whose ``path`` names the files below ``path`` once they are whole, the
    driver sees the tables only, the limits count them, and tasks open the files by name. A
    file is read as often as it is announced, so a table names it once.
    """
    limit = ("maxBytesPerTrigger", max_bytes) if max_files is None else ("maxFilesPerTrigger", max_files)
    if announced is None:
        files = (
            spark.readStream.format("text").option("wholetext", "true")
            .option(*limit)
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(path)
        )
        where = F.col("_metadata.file_path")
    else:
        names = spark.readStream.schema("path string").option(*limit).parquet(announced)
        files = spread(names).mapInPandas(_bodies(path, glob), "_path string, value binary")
        where = F.col("_path")
    folder = F.nullif(F.regexp_extract(where, r"source_id=([^/]+)/", 1), F.lit(""))
    stem = F.regexp_extract(where, r"([^/]+?)(?:\.subs)?\.[^./]+\z", 1)
    named = files.select(
        F.coalesce(folder, stem).alias("source_id"), F.col("value").cast("string").alias("body"))
    return parse_captions(named)
