"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

Every byte that is covered by a ``width``-byte string starting somewhere else too is a
repeat. Windows of ``width`` bytes are filed under anchors (the smallest hash of any
``GRAM`` bytes in them), so equal windows meet under one anchor, and consecutive windows
mostly share theirs: such a run travels as one string, and equal strings under an anchor
travel once, with their number. A run alone under its anchor repeats nothing, unless the
anchor stands in it twice. The strings of all other anchors are put into suffix order:

* strings of a crowded anchor, a passage in very many different contexts, are filed again
  window by window, by their first and last bytes; windows nobody may share stay out, and
  equal ones (128 bits of hash) travel once, with their number;
* a task takes whole anchors up to a bounded number of bytes and cuts their strings into
  shards; each shard gets its suffix order and its Burrows-Wheeler transform, over
  symbols of fifty bytes at every phase, told apart and ordered by 64 bits of hash;
* the shards' transforms are merged without sorting suffixes again: the interleave, one
  shard number per slot, is refined symbol by symbol. A pass reads each slot's symbol from
  its shard's transform and deals the slots stably by symbol, which sorts the suffixes by
  one symbol more;
* two neighbours share as many symbols as passes have not parted them, so after
  ``width / 50`` passes the unparted intervals are the strings of ``width`` bytes that
  occur more than once, counted with the numbers of their strings.

Windows found this way become byte intervals of their documents; overlapping ones merge,
and what they cover is removed.

Defined results: a null text is empty; texts shorter than a window stay whole; equal rows
are documents of their own and repeat each other; null identifiers are allowed; other
columns are not used. Removing bytes may cut a character in two: outputs are bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import (
    CHUNK, anchored_runs, mixed, prefix_hash, ranges, row_chunks, short_batches,
    sliding_min, span_hash, written,
)

WIDTH = 200
GRAM = 32
SYMBOL = 50  # bytes of a symbol at most; the largest divisor of the width up to it is taken
SHARD = 1 << 18  # bytes of a shard
TOGETHER = 1 << 21  # bytes whose shards are merged at once
CROWDED = 1 << 22  # bytes of different strings under one anchor from which windows go apart: their
# arrays take some hundred times that in a task
MARKS = 1 << 16  # windows of a string that a batch or a task holds together
SECOND = 0x2545F4914F6CDD1D  # base of a second hash of windows
BROADCAST_ROWS = 300_000  # of (identifier, hash): 7 MB


def _byte_grams(raw: np.ndarray, gram: int):
    sums, p = prefix_hash(raw)
    n = len(raw) - gram + 1
    if n <= 0:
        return sums, p, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        hashes = (sums[gram:] - sums[:n]) * p.down[:n]
    return sums, p, mixed(hashes)


def _own_repeats(
    grams: np.ndarray, anchor: np.ndarray, first: np.ndarray, count: np.ndarray, width: int
) -> np.ndarray:
    """Whether a run's anchor stands in it twice, so that it may repeat a window of its own."""
    if not len(first):
        return np.zeros(0, bool)
    reach = width - GRAM
    least = sliding_min(grams, reach + 1)
    # the places that are smallest in some window: where the largest of its windows' minima is theirs
    padded = np.full(len(least) + 2 * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[reach: reach + len(least)] = ~least
    places = np.flatnonzero(~sliding_min(padded, reach + 1) == grams)
    low = np.searchsorted(places, first)
    size = np.searchsorted(places, first + count + reach) - low
    run = np.repeat(np.arange(len(first)), size)
    same = grams[places[ranges(low, size)]] == anchor[run]
    return np.bincount(run[same], minlength=len(first)) > 1


def run_table(docs: DataFrame, width: int, id_column: str, text: str) -> DataFrame:
    """(rid, id, tx, n_bytes, sha256, runs) of each row.

    A run is (anchor, string, first, count, own): its anchor, the hash of its string, its
    first window, the number of its windows, and whether it may repeat itself.
    """
    short_batches(docs)
    schema = T.StructType([
        T.StructField("rid", T.LongType()), T.StructField("id", docs.schema[id_column].dataType),
        T.StructField("tx", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("runs", T.ArrayType(T.StructType([
            T.StructField("anchor", T.LongType()), T.StructField("string", T.LongType()),
            T.StructField("first", T.LongType()), T.StructField("count", T.LongType()),
            T.StructField("own", T.BooleanType())]))),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
                k = rows.num_rows
                sums, p, grams = _byte_grams(raw, GRAM)
                doc, anchor, at, count = anchored_runs(grams, GRAM, width, offsets)
                string = mixed(span_hash(sums, p, at, at + count + width - 1) + count.astype(np.uint64))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=k))]), pa.int32()),
                    pa.StructArray.from_arrays([
                        pa.array(anchor.view(np.int64)), pa.array(string.view(np.int64)),
                        pa.array(at - offsets[doc]), pa.array(count),
                        pa.array(_own_repeats(grams, anchor, at, count, width))],
                        names=["anchor", "string", "first", "count", "own"]))
                view = memoryview(np.ascontiguousarray(raw))
                shas = [hashlib.sha256(view[a:b]).hexdigest()
                        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(rid, rid + k)), rows.column("id"), rows.column("tx"),
                    pa.array(np.diff(offsets)), pa.array(shas, pa.string()), lists], names=schema.names)
                rid += k

    return _rows(docs, id_column, text).mapInArrow(scan, schema)


def _rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tx"),
        F.col(f"`{text}`").alias("text"))


def with_texts(
    keyed: DataFrame, table: DataFrame, docs: DataFrame, id_column: str, text: str
) -> DataFrame:
    """``keyed`` (rid, ...) with the texts of its rows; only texts it names travel."""
    named = written(keyed.join(table.select("rid", "id", "tx"), "rid").withColumnsRenamed(
        {"id": "i", "tx": "t"}))
    names = named.select(F.col("i").alias("ni"), F.col("t").alias("nt")).distinct()
    if named.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    rows = _rows(docs, id_column, text)
    here = rows.join(names, rows.id.eqNullSafe(F.col("ni")) & (rows.tx == F.col("nt")), "left_semi")
    here = here.dropDuplicates(["id", "tx"])
    return named.join(here, F.col("i").eqNullSafe(here.id) & (F.col("t") == here.tx)).drop("i", "t", "id", "tx")


# --- suffix order inside a task ---------------------------------------------------


def _dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    _, rank = np.unique(values, return_inverse=True)
    return rank.astype(np.int64), int(rank.max()) + 1 if len(rank) else 0


def _stable_order(symbols: np.ndarray) -> np.ndarray:
    """Stable order by symbol, in passes of 16 bits (a counting sort each)."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if symbols.max(initial=0) > 0xFFFF:
        high = (symbols >> 16).astype(np.uint16)[order]
        order = order[np.argsort(high, kind="stable")]
    return order


class Shard:
    """Suffix order and transform of some strings laid end to end.

    Each string of length L owns L + size places: one a byte, and one end mark a phase.
    ``symbol[i]`` is the rank of the hash of the ``size`` bytes from place i, 0 at end marks; the suffix before
    the one at i starts ``size`` bytes earlier, or is the end mark of i's phase.
    """

    def __init__(
        self, symbol: np.ndarray, size: int, starts: np.ndarray, ends: np.ndarray, depth: int
    ):
        n = len(symbol)
        # a multiple of ``size`` further on in the same phase, stopping at the phase's end mark
        rank, step = symbol, size
        place = np.arange(n)
        stop = np.repeat(ends, ends + size - starts)  # first end mark of each place's string
        phase = (place - stop) % size
        while step < depth:
            further = np.minimum(place + step, stop + phase)
            rank, _ = _dense(rank * (int(rank.max()) + 1) + rank[further])
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        own = np.repeat(starts, ends + size - starts)
        before = np.where(place - own >= size, symbol[np.maximum(place - size, 0)], 0)
        self.transform = before[self.order].astype(np.uint32)


def merge(shards: list[Shard], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, interval): the shard of each slot, and intervals not parted by ``passes``."""
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.order) for s in shards])
    interval = np.zeros(len(interleave), np.int32)
    symbols = np.empty(len(interleave), np.uint32)
    transforms = np.concatenate([s.transform for s in shards])
    parts = 1
    for _ in range(passes):
        # the slots of each shard in turn read its transform from the start
        symbols[np.argsort(interleave, kind="stable")] = transforms
        order = _stable_order(symbols)
        interleave, dealt, lifted = interleave[order], symbols[order], interval[order]
        new = np.ones(len(order), bool)
        new[1:] = (dealt[1:] != dealt[:-1]) | (lifted[1:] != lifted[:-1])
        interval = (np.cumsum(new) - 1).astype(np.int32)
        if interval[-1] + 1 == parts:  # nothing was parted: nothing will be
            break
        parts = int(interval[-1]) + 1
    return interleave, interval


def symbol_size(width: int, most: int = SYMBOL) -> int:
    """The largest divisor of ``width`` from eight bytes up to ``most``."""
    return max((k for k in range(8, most + 1) if width % k == 0), default=0)


def repeated_windows(
    strings: list[bytes], numbers: np.ndarray, width: int, shard_bytes: int = SHARD,
    size: int | None = None,
) -> list[np.ndarray]:
    """For each string, which of its windows occur twice or more, counting ``numbers``."""
    size = size or symbol_size(width)
    lengths = np.array([len(s) for s in strings], np.int64)
    places = lengths + size
    starts = np.cumsum(places) - places
    ends = starts + lengths
    total = int(places.sum())
    flat = np.zeros(total + size, np.uint8)
    flat[ranges(starts, lengths)] = np.frombuffer(b"".join(strings), np.uint8)
    sums, p = prefix_hash(flat)
    at = np.arange(total)
    symbol, _ = _dense(mixed(span_hash(sums, p, at, at + size)))
    symbol += 1
    symbol[ranges(ends, np.full(len(ends), size, np.int64))] = 0
    weight = np.zeros(total, np.int64)
    count = np.maximum(lengths - width + 1, 0)
    weight[ranges(starts, count)] = np.repeat(numbers, count)

    cuts = np.searchsorted(starts, np.arange(0, total, max(shard_bytes, -(-total // 250))))
    cuts = np.unique(np.append(cuts, len(strings)))
    shards, suffixes = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        low, high = int(starts[a]), int(ends[b - 1] + size)
        shard = Shard(symbol[low:high], size, starts[a:b] - low, ends[a:b] - low, width)
        shards.append(shard)
        suffixes.append(shard.order + low)
    interleave, interval = merge(shards, width // size)
    suffix = np.empty(total, np.int64)
    suffix[np.argsort(interleave, kind="stable")] = np.concatenate(suffixes)
    held = np.bincount(interval, weights=weight[suffix])
    twice = np.zeros(total, bool)
    twice[suffix] = held[interval] >= 2
    return [twice[s: s + c] for s, c in zip(starts.tolist(), count.tolist())]


def _intervals(flags: np.ndarray, width: int) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"first": a, "end": b + width - 1} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


SPANS = "array<struct<first:bigint,end:bigint>>"


def strings_of(reps: DataFrame) -> DataFrame:
    """(anchor, string, n, bytes) of the runs that stand for their strings."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "string", "n", "bytes"]
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
                lists = rows.column("own")
                flat = lists.flatten()
                doc = np.repeat(np.arange(rows.num_rows), np.asarray(lists.value_lengths()))
                first = offsets[doc] + np.asarray(flat.field("first"))
                size = np.asarray(flat.field("size"))
                data = raw[ranges(first, size)].tobytes()
                places = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), len(size), [
                    None, pa.py_buffer(places), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [flat.field("anchor"), flat.field("string"), flat.field("n"), out], names=names)

    return reps.mapInArrow(cut, "anchor long, string long, n long, bytes binary")


def window_marks(strings: DataFrame, width: int) -> DataFrame:
    """(file, h1, h2, anchor, string, at, n): every window of some strings, by hashes only.

    A window is filed under its anchor, its first ``GRAM`` and its last ``GRAM`` bytes, so
    equal windows meet; h1 and h2 are 128 bits of hash of the whole window.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "h1", "h2", "anchor", "string", "at", "n"]
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "bytes", CHUNK):
                sums, p, grams = _byte_grams(raw, GRAM)
                sums2, p2 = prefix_hash(raw, SECOND)
                count = np.diff(offsets) - width + 1
                of_row = np.repeat(np.arange(rows.num_rows), count)
                every = ranges(np.zeros(rows.num_rows, np.int64), count)
                anchors = rows.column("anchor").to_numpy()
                for k in range(0, len(every), MARKS):
                    row, at = of_row[k: k + MARKS], every[k: k + MARKS]
                    place = offsets[row] + at
                    anchor = anchors[row]
                    with np.errstate(over="ignore"):
                        file = mixed(mixed(anchor.view(np.uint64) + grams[place]) + grams[place + width - GRAM])
                    h1 = mixed(span_hash(sums, p, place, place + width))
                    h2 = mixed(span_hash(sums2, p2, place, place + width))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([
                        *[pa.array(h.view(np.int64)) for h in (file, h1, h2)], pa.array(anchor),
                        rows.column("string").take(take), pa.array(at), rows.column("n").take(take)], names=names)

    return strings.mapInArrow(
        mark, "file long, h1 long, h2 long, anchor long, string long, at long, n long")


def window_classes(marks: DataFrame, width: int, together: int = TOGETHER) -> DataFrame:
    """(file, h1, h2, n, rep, part): the different windows of files that somebody shares.

    ``n`` is how often a window occurs, ``rep`` where it does once. ``part`` is its file, cut
    by hash where the different windows of a file have more than ``together`` bytes.
    """
    classes = written(marks.groupBy("file", "h1", "h2").agg(
        F.sum("n").alias("n"), F.min(F.struct("anchor", "string", "at")).alias("rep")))
    files = classes.groupBy("file").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("different"))
    parts = F.ceil(F.col("different") * width / together)
    part = F.when(parts > 1, F.xxhash64("file", F.pmod("h1", parts))).otherwise(F.col("file"))
    return classes.join(files.where(F.col("all") > 1), "file").select(
        "file", "h1", "h2", "n", "rep", part.alias("part"))


def windows_apart(strings: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(file, anchor, string, at, n, bytes): one window of each of ``classes``, cut out."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "anchor", "string", "at", "n", "bytes"]
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "bytes", CHUNK >> 3):
                lists = rows.column("cuts")
                flat = lists.flatten()
                of_row = np.repeat(np.arange(rows.num_rows), np.asarray(lists.value_lengths()))
                places = np.asarray(flat.field("at"))
                step = (CHUNK << 3) // width
                for k in range(0, len(of_row), step):
                    row, at, some = of_row[k: k + step], places[k: k + step], flat.slice(k, step)
                    data = raw[ranges(offsets[row] + at, np.full(len(row), width))].tobytes()
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([
                        some.field("file"), *[rows.column(c).take(take) for c in ("anchor", "string")],
                        some.field("at"), some.field("n"),
                        pa.array([data[k: k + width] for k in range(0, len(data), width)], pa.binary()),
                    ], names=names)

    # a row has the windows of at most ``MARKS`` places of a string
    chosen = classes.groupBy(
        F.col("rep.anchor").alias("anchor"), F.col("rep.string").alias("string"),
        F.floor(F.col("rep.at") / MARKS).alias("stretch")).agg(
        F.collect_list(F.struct(F.col("part").alias("file"), F.col("rep.at").alias("at"), "n")).alias("cuts"))
    return strings.drop("n").join(chosen.drop("stretch"), ["anchor", "string"]).mapInArrow(
        cut, "file long, anchor long, string long, at long, n long, bytes binary")


def crowded_repeats(strings: DataFrame, width: int) -> DataFrame:
    """(anchor, string, first, end): the repeats in strings of crowded anchors.

    Equal windows are one class; one of each is put into suffix order with its number, and
    the verdict goes to all windows of the class.
    """
    strings = written(strings)
    marks = window_marks(strings, width)
    classes = written(window_classes(marks, width))
    found = suffix_repeats(windows_apart(strings, classes, width), width).select(
        F.struct("anchor", "string", F.col("first").alias("at")).alias("rep"))
    verdict = written(classes.join(found, "rep").select("file", "h1", "h2"))
    if verdict.count() <= BROADCAST_ROWS:
        verdict = F.broadcast(verdict)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, string, at = (batch.column(c).to_numpy() for c in ("anchor", "string", "at"))
            cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(string) != 0) | (np.diff(at) != 1)) + 1
            first, last = np.append(0, cut), np.append(cut, len(at)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (anchor[first], string[first], at[first], at[last] + width)],
                names=["anchor", "string", "first", "end"])

    repeated = marks.join(verdict, ["file", "h1", "h2"]).select("anchor", "string", "at")
    return repeated.repartition("anchor", "string", F.floor(F.col("at") / MARKS)).sortWithinPartitions(
        "anchor", "string", "at").mapInArrow(merged, "anchor long, string long, first long, end long")


def suffix_repeats(rows: DataFrame, width: int, together: int = TOGETHER) -> DataFrame:
    """(anchor, string, first, end): the repeats in strings that meet in one file.

    ``rows`` is (file, anchor, string, at, n, bytes), ``at`` being where the bytes start in
    their string. Rows arrive sorted by file; whole files are taken up to ``together`` bytes.
    """
    names = ["anchor", "string", "first", "end"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            flags = repeated_windows([h[5] for h in held], np.array([h[4] for h in held]), width)
            found = [(h[1], h[2], h[3] + span["first"], h[3] + span["end"])
                     for h, f in zip(held, flags) for span in _intervals(f, width)]
            columns = list(zip(*found)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (
                    "file", "anchor", "string", "at", "n", "bytes"))):
                if size > together and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush()

    return rows.repartition("file").sortWithinPartitions("file", "string", "at").mapInArrow(
        solve, "anchor long, string long, first long, end long")


def repeats(
    docs: DataFrame, table: DataFrame, width: int, id_column: str, text: str, crowded: int = CROWDED
) -> DataFrame:
    """(rid, first, end): byte intervals of every row that repeat somewhere else."""
    runs = table.select("rid", F.explode("runs").alias("run")).select("rid", "run.*")
    shared = runs.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("n > 1 OR own").select("anchor")
    wanted = written(runs.drop("own").join(shared, "anchor"))
    classes = wanted.groupBy("anchor", "string").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first", "count")).alias("rep"))
    own = F.struct("anchor", "string", "n", F.col("rep.first").alias("first"),
                   (F.col("rep.count") + width - 1).alias("size"))
    reps = classes.groupBy(F.col("rep.rid").alias("rid")).agg(F.collect_list(own).alias("own"))
    strings = strings_of(with_texts(reps, table, docs, id_column, text))
    full = written(classes.groupBy("anchor").agg(
        F.sum(F.col("rep.count") + width - 1).alias("size")).where(F.col("size") > crowded).select("anchor"))
    whole_rows = lambda x: x.select(
        F.col("anchor").alias("file"), "anchor", "string", F.lit(0).cast("long").alias("at"), "n", "bytes")
    if full.limit(1).count():
        strings = written(strings)
        few = strings.join(full, "anchor", "left_anti")
        found = suffix_repeats(whole_rows(few), width).union(
            crowded_repeats(strings.join(full, "anchor", "left_semi"), width))
    else:
        found = suffix_repeats(whole_rows(strings), width)
    return wanted.select("rid", "anchor", "string", F.col("first").alias("from")).join(
        found, ["anchor", "string"]).select(
        "rid", (F.col("from") + F.col("first")).alias("first"), (F.col("from") + F.col("end")).alias("end"))


def cleaned(
    docs: DataFrame, table: DataFrame, intervals: DataFrame, id_column: str, text: str
) -> DataFrame:
    """(rid, n_removed, spans, kept, kept_sha256) of the rows with repeats.

    ``spans`` are the maximal removed byte runs, ``kept`` the bytes that are left.
    """
    by_row = intervals.groupBy("rid").agg(F.collect_set(F.struct("first", "end")).alias("cut"))
    schema = f"rid long, n_removed long, spans {SPANS}, kept binary, kept_sha256 string"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "n_removed", "spans", "kept", "kept_sha256"]
        spans_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
                lists = rows.column("cut")
                flat = lists.flatten()
                doc = np.repeat(np.arange(rows.num_rows), np.asarray(lists.value_lengths()))
                step = np.zeros(len(raw) + 1, np.int64)
                np.add.at(step, offsets[doc] + np.asarray(flat.field("first")), 1)
                np.add.at(step, offsets[doc] + np.asarray(flat.field("end")), -1)
                gone = np.cumsum(step[:-1]) > 0
                removed, spans, kept, shas = [], [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    mine = gone[a:b]
                    rest = raw[a:b][~mine].tobytes()
                    removed.append(b - a - len(rest))
                    spans.append(_intervals(mine, 1))
                    kept.append(rest)
                    shas.append(hashlib.sha256(rest).hexdigest())
                yield pa.RecordBatch.from_arrays([
                    rows.column("rid"), pa.array(removed, pa.int64()), pa.array(spans, spans_type),
                    pa.array(kept, pa.binary()), pa.array(shas, pa.string())], names=names)

    return with_texts(by_row, table, docs, id_column, text).mapInArrow(remove, schema)


def dedup_bytes(
    docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text: str = "text",
    crowded: int = CROWDED,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row."""
    if not symbol_size(width) or width < GRAM:
        raise ValueError(f"width must have a divisor from 8 to {SYMBOL} and be {GRAM} at least")
    table = written(run_table(docs, width, id_column, text))
    changed = cleaned(docs, table, repeats(docs, table, width, id_column, text, crowded), id_column, text)
    zero = F.lit(0).cast("long")
    return table.drop("runs").join(changed.drop("kept"), "rid", "left").select(
        "id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce(F.size("spans").cast("long"), zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "spans")
