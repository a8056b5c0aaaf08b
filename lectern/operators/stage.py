"""Written stages between operators that read their input several times.

Block scans and folds look at their input more than once. Chaining many of them
lazily would repeat everything upstream, so plans write the result of a stage to
the shared folder named by ``spark.checkpoint.dir`` and go on from there. The copy
is columnar and packed, cuts the lineage, and survives the loss of any executor. What was
shuffled to make a copy goes as soon as the copy is whole; copies go with ``unstage`` or at
the end of the application.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only for local sessions."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _remove_at_end(spark: SparkSession, path: str) -> None:
    """Scratch files go when the application ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, *cluster_by: str) -> DataFrame:
    """Write ``df`` and read it back; with ``cluster_by``, grouped by those columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    out = df.repartition(*cluster_by) if cluster_by else df
    with _shuffles_dropped(spark):
        out.write.option("compression", "zstd").parquet(path)
    _remove_at_end(spark, path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._staged = path
    return copy


def unstage(*copies: DataFrame) -> None:
    """Remove written copies that nothing will read any more; other tables are left as they are."""
    for copy in copies:
        path = getattr(copy, "_staged", None)
        if path is not None:
            place = copy.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(copy.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
