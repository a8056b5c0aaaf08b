"""Running a stream over what is there now, into a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stage import shared_folder

COMPACT_EVERY = 16  # micro-batches whose folders are merged into one


class ChangedRows:
    """A table of keyed rows kept as folders: a base, and one folder per later micro-batch.

    A repeated batch replaces its folder and no other. Every ``every`` batches the folders
    are merged into a new base that keeps the last version of each key; only when that
    is whole do the folders it stands for go. The number of folders is bounded by ``every``,
    and what a restart finds is whole at any moment.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], every: int = COMPACT_EVERY):
        self.spark, self.path, self.schema, self.keys, self.every = spark, path, schema, keys, every

    def _folders(self) -> dict[str, list[int]]:
        """Numbers of the bases that are whole and of the batches."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = place(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"base": [], "batch": []}
        if files.exists(place(self.path)):
            for status in files.listStatus(place(self.path)):
                kind, _, number = status.getPath().getName().partition("=")
                if kind in found and files.exists(place(status.getPath(), "_SUCCESS")):
                    found[kind].append(int(number))
        return {k: sorted(v) for k, v in found.items()}

    def _remove(self, kind: str, number: int) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={number}")
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def rows(self) -> DataFrame:
        """The last version of every key."""
        found = self._folders()
        base = found["base"][-1:]
        named = [("base", n) for n in base] + [("batch", n) for n in found["batch"] if not base or n > base[0]]
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}={n}").withColumn("_batch", F.lit(n))
                 for kind, n in named]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        names = self.schema.names
        last = rows.groupBy(*self.keys).agg(
            F.max_by(F.struct(*[c for c in names if c not in self.keys]), "_batch").alias("_row"))
        return last.select(*[c if c in self.keys else F.col(f"_row.{c}") for c in names])

    def add(self, batch: DataFrame, number: int) -> None:
        """Write the rows that a micro-batch changed; merge when it is time."""
        found = self._folders()
        if found["base"] and found["base"][-1] >= number:
            return  # a repeated batch that the base holds already
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if (number + 1) % self.every == 0:
            self.rows().write.mode("overwrite").parquet(f"{self.path}/base={number}")
            for kind, numbers in found.items():
                for n in numbers:
                    self._remove(kind, n)
            self._remove("batch", number)


def run_available(
    stream: DataFrame, mode: str = "append", keys: list[str] | None = None, report: dict | None = None,
    compact_every: int = COMPACT_EVERY, ending: Callable[[], None] | None = None,
) -> DataFrame:
    """Process all input available now and return the result as a stored table.

    Append output is written by the file sink. ``update`` output is kept as
    ``ChangedRows``: the last version of each of ``keys`` is the result. ``complete``
    output replaces the table's only batch. ``report`` takes the number of batches and of
    rows that came later than the watermark and were refused. ``ending`` is called when all
    has been processed; input that it adds is processed too, from the same checkpoint.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/offsets")
    target = f"{base}/table"
    changed = ChangedRows(spark, target, stream.schema, keys or [], compact_every)
    if mode == "append":
        writer = writer.format("parquet").option("path", target)
    elif mode == "update":
        writer = writer.foreachBatch(changed.add)
    else:
        writer = writer.foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}"))
    progress = []
    for again in (False, True) if ending is not None else (False,):
        if again:
            ending()
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        progress += query.recentProgress
    if report is not None:
        report["batches"] = len(progress)
        report["late"] = sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(target)
    if mode == "update":
        return changed.rows()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(target)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")
