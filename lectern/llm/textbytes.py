"""Whole texts as byte arrays inside tasks, and the shared folder between jobs.

Python operators of this package see a partition as Arrow batches. ``row_chunks``
cuts them into runs of rows with a bounded number of text bytes (one longer text
is a run of its own), so the numpy arrays of an operator are bounded by the chunk
or by the longest text, never by the partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK = 1 << 19  # text bytes a task looks at together

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; set here only for a local session without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/lectern-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe from lost executors.

    The files go when the application ends, or with ``drop_scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    _SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path)


_SCRATCH: list[str] = []  # folders written by this session, oldest first


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_mark() -> int:
    return len(_SCRATCH)


def scratch_since(mark: int) -> list[str]:
    """Folders that ``written`` has made since the mark was taken."""
    return _SCRATCH[mark:]


def drop_scratch(docs: DataFrame, paths: list[str]) -> None:
    """Remove those of the written folders ``paths`` that ``docs`` does not read."""
    used = docs.inputFiles() if paths else []
    for path in paths:
        name = f"/{path.rpartition('/')[2]}/"
        if not any(name in f for f in used):
            place, files = _place(docs.sparkSession, path)
            files.delete(place, True)


def short_batches(df: DataFrame, rows: int = 1_000) -> None:
    """Let whole texts travel to Python in short Arrow batches: both sides hold two at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def row_chunks(
    batch: pa.RecordBatch, column: str = "text", most: int = CHUNK
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in runs of at most ``most`` text bytes, one row at least."""
    if not batch.num_rows:
        return
    raw, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield (
            batch.slice(first, last - first),
            raw[offsets[first]: offsets[last]],
            offsets[first: last + 1] - offsets[first],
        )
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the rolling base and of its inverse, grown on demand."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK + 1)
            with np.errstate(over="ignore"):
                for name, step in (("up", self.base), ("down", self.inverse)):
                    out = np.empty(n, np.uint64)
                    out[0], size, power = 1, 1, step
                    while size < n:  # doubling: x[size:2*size] = x[:size] * step**size
                        take = min(size, n - size)
                        out[size: size + take] = out[:take] * np.uint64(power)
                        size, power = size + take, power * power % (1 << 64)
                    setattr(self, name, out)


_POWERS: dict[int, Powers] = {}


def powers(n: int, base: int = BASE) -> Powers:
    p = _POWERS.setdefault(base, Powers(base))
    p.upto(n)
    return p


def prefix_hash(codes: np.ndarray, base: int = BASE) -> tuple[np.ndarray, Powers]:
    """Running polynomial sums; ``span_hash`` turns them into the hash of any span."""
    p = powers(len(codes) + 1, base)
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p.up[: len(codes)], out=sums[1:])
    return sums, p


def span_hash(sums: np.ndarray, p: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end]: equal spans have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        return (sums[end] - sums[start]) * p.down[start]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words ``[^\\x20\\x09-\\x0D]+``: byte spans of all texts,
    and ``first[d]`` the number of words before text ``d``."""
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    start = inside[1:] & ~inside[:-1]
    end = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    both = cuts[inside[cuts] & inside[cuts + 1]]  # a word of one text touches a word of the next
    start[both] = True
    end[both] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    first = np.searchsorted(starts, offsets)
    return starts, ends, first


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash for each word."""
    sums, p = prefix_hash(raw)
    with np.errstate(over="ignore"):
        return mixed(span_hash(sums, p, starts, ends) + (ends - starts).astype(np.uint64) * MIX)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for every i up to len(x) - width."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def anchored_runs(
    grams: np.ndarray, gram: int, width: int, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that share their smallest gram.

    ``grams[i]`` hashes the ``gram`` units from i, ``bounds`` are the texts' unit bounds.
    Returns (text number, anchor hash, first window, number of windows): a window is
    given by the place of its first unit, and equal windows have equal anchors.
    """
    least = sliding_min(grams, width - gram + 1)
    count = np.maximum(np.diff(bounds) - width + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    at = ranges(bounds[:-1], count)
    anchor = least[at] if len(at) else np.empty(0, grams.dtype)
    head = np.ones(len(at), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(head)
    return text[first], anchor[first], at[first], np.diff(np.append(first, len(at)))
