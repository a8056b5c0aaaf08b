"""A sink that writes one text file per path, from as many tasks as the rows take.

Rows are range partitioned on path and order, so a path may begin in one task and end in
another. Each task writes its share of a path as a *part* in a staging folder and lists its
parts in a manifest; the data source's commit names the manifests of the tasks that
succeeded, and its abort removes them. A second job then publishes: a path with one part is
moved into place, one with several is copied together, part by part in order, and moved.
Files appear under their final name whole or not at all, whichever task or executor is lost,
and publishing can be repeated. Texts never pass through the driver.

Files are reached with ``pyarrow.fs``: local and mounted folders and the object stores and
file systems it knows. Rows need ``path`` (relative, with ``/``), ``ord`` and ``line``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

COPY_BYTES = 1 << 20
MANIFEST = "path string, place long, part string, task string, lines long"
_STAGING = "_staging"


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and folder of a path or URI."""
    if "://" not in uri:
        uri = uri.removeprefix("file:")
    file_system, folder = pafs.FileSystem.from_uri(uri)
    return file_system, folder.rstrip("/")


@dataclass
class TaskParts(WriterCommitMessage):
    task: str
    lines: int


class PartWriter(DataSourceArrowWriter):
    """Writes the parts of one task and lists them in its manifest."""

    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskParts:
        files, folder = place(self.staging)
        task, number = uuid.uuid4().hex, TaskContext.get().partitionId()
        files.create_dir(f"{folder}/parts/{task}")
        listed, out, total = [], None, 0
        for batch in iterator:
            paths, lines = batch.column("path").to_pylist(), batch.column("line").to_pylist()
            for path, line in zip(paths, lines):
                if not listed or listed[-1]["path"] != path:
                    if out is not None:
                        out.close()
                    part = f"parts/{task}/{len(listed)}"
                    listed.append({"path": path, "place": number, "part": part, "task": task, "lines": 0})
                    out = files.open_output_stream(f"{folder}/{part}")
                out.write(f"{'' if line is None else line}\n".encode())
                listed[-1]["lines"] += 1
                total += 1
        if out is not None:
            out.close()
        with files.open_output_stream(f"{folder}/manifests/{task}.json") as manifest:
            for row in listed:
                manifest.write(f"{json.dumps(row)}\n".encode())
        return TaskParts(task, total)

    def commit(self, messages: list[TaskParts | None]) -> None:
        files, folder = place(self.staging)
        with files.open_output_stream(f"{folder}/committed/tasks.json") as out:
            for m in messages:
                if m is not None:
                    out.write(f"{json.dumps({'task': m.task})}\n".encode())

    def abort(self, messages: list[TaskParts | None]) -> None:
        files, folder = place(self.staging)
        if files.get_file_info(folder).type != pafs.FileType.NotFound:
            files.delete_dir(folder)


class TextParts(DataSource):
    """``df.write.format("text_parts").option("path", staging)``: rows (path, line) to parts."""

    @classmethod
    def name(cls) -> str:
        return "text_parts"

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(self.options["path"])


def _publisher(target: str, staging: str):
    """Moves or joins the parts of each path into place."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = place(target)
        _, scratch = place(staging)
        exists = lambda p: files.get_file_info(p).type == pafs.FileType.File
        for frame in batches:
            for path, parts in zip(frame["path"], frame["parts"]):
                final = f"{folder}/{path}"
                files.create_dir(final.rpartition("/")[0])
                ready = f"{scratch}/{parts[0]}"
                if len(parts) > 1:
                    if not all(exists(f"{scratch}/{p}") for p in parts) and exists(final):
                        continue
                    ready = f"{scratch}/joined/{uuid.uuid4().hex}"
                    with files.open_output_stream(ready) as out:
                        for p in parts:
                            with files.open_input_stream(f"{scratch}/{p}") as part:
                                while chunk := part.read(COPY_BYTES):
                                    out.write(chunk)
                elif not exists(ready) and exists(final):
                    continue  # an earlier attempt has moved it
                files.move(ready, final)
            yield frame[["path", "lines"]]

    return run


def _digester(root: str):
    """The sha256 of each file, read in chunks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = place(root)
        for frame in batches:
            found = []
            for path in frame["path"]:
                digest = hashlib.sha256()
                with files.open_input_stream(f"{folder}/{path}") as text:
                    while chunk := text.read(COPY_BYTES):
                        digest.update(chunk)
                found.append(digest.hexdigest())
            yield frame.assign(content=found)

    return run


def file_digests(written: DataFrame, path: str) -> DataFrame:
    """(path, lines, content) of the files that ``write_text_files`` has written below ``path``.

    ``content`` is the sha256 of the file as it is stored. Tasks open the files by the names
    in ``written``: no folder is listed, so millions of files cost the driver nothing.
    """
    return spread(written).mapInPandas(_digester(path), "path string, lines long, content string")


def spread(paths: DataFrame) -> DataFrame:
    """Rows that stand for files, dealt to all cores: their bytes say nothing of the work."""
    spark = paths.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return paths.repartition(parts, "path")


def committed_parts(spark: SparkSession, staging: str) -> DataFrame:
    """(path, parts, lines) of a staging folder: the parts of the tasks that succeeded, in order."""
    tasks = spark.read.schema("task string").json(f"{staging}/committed")
    rows = spark.read.schema(MANIFEST).json(f"{staging}/manifests")
    # a path has one part a task, so the list is as long as the tasks it took
    listed = F.sort_array(F.collect_list(F.struct("place", "part")))
    return rows.join(tasks, "task", "left_semi").groupBy("path").agg(
        F.transform(listed, lambda p: p["part"]).alias("parts"), F.sum("lines").alias("lines"))


def write_text_files(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` (path, ord, line) below ``path``; returns (path, lines) of the files.

    Files of the same name are replaced, others stay. The result is read from a written copy.
    """
    from ..operators.stage import stage

    spark = rows.sparkSession
    files, folder = place(path)
    staging = f"{path.rstrip('/')}/{_STAGING}-{uuid.uuid4().hex}"
    _, scratch = place(staging)
    for name in ("parts", "manifests", "committed", "joined"):
        files.create_dir(f"{scratch}/{name}")
    spark.dataSource.register(TextParts)
    (
        rows.repartitionByRange("path", "ord").sortWithinPartitions("path", "ord").select("path", "line")
        .write.format("text_parts").option("path", staging).mode("append").save()
    )
    done = stage(spread(committed_parts(spark, staging)).mapInPandas(
        _publisher(path, staging), "path string, lines long"))
    files.delete_dir(scratch)
    return done
