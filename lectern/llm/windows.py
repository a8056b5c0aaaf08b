"""Substring dedup by Rabin-Karp hashes of fixed-length token windows.

Every window of ``width`` consecutive words has a rolling hash (96 bits of it travel). The
windows are counted in Spark by hash, and a window that also starts in a document with a
smaller identifier is a repeat; the repeats of a document merge into maximal intervals,
which are removed.

Counting is spared where it cannot matter. A window is filed under its anchor, the
smallest hash of any ``GRAM`` words in it, so equal windows have equal anchors, and
consecutive windows mostly share theirs. Anchors are few; one that stands in a single
document cannot hold a repeat, and the windows under it are not sent. All others are
counted to the last one. An anchor of very many windows is dealt over ``SALTS`` parts
by document; each part keeps its smallest document, and these few meet again.

Defined results: a null text has no words; texts shorter than a window stay as they are
with single spaces between words; documents with a null identifier neither lose words nor
take any from others, as null is not smaller than anything; rows with equal identifiers
do not remove each other's words; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import (
    CHUNK, anchored_runs, prefix_hash, ranges, row_chunks, short_batches, span_hash, mixed, word_codes,
    word_spans, written,
)

WIDTH = 50
GRAM = 12
SECOND_BASE = 0x2545F4914F6CDD1D
HOT = 20_000  # windows under one anchor from which it is dealt over parts
SALTS = 64
BROADCAST_ROWS = 300_000  # of (identifier, hash): 7 MB


def _grams(codes: np.ndarray, gram: int) -> np.ndarray:
    n = len(codes) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums, p = prefix_hash(codes)
    at = np.arange(n)
    return mixed(span_hash(sums, p, at, at + gram))


def _digests(raw: np.ndarray, starts, ends, first, keep: np.ndarray) -> list[str]:
    """sha256 of each text's kept words joined by one space."""
    starts, ends, text = starts[keep], ends[keep], np.repeat(
        np.arange(len(first) - 1), np.diff(first))[keep]
    sizes = ends - starts + 1  # with the space behind
    stream = np.full(int(sizes.sum()), 0x20, np.uint8)
    if len(starts):
        stream[ranges(np.cumsum(sizes) - sizes, sizes - 1)] = raw[ranges(starts, sizes - 1)]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, sizes, len(first) - 1))]).astype(np.int64)
    view = memoryview(stream)
    return [hashlib.sha256(view[a: max(a, b - 1)]).hexdigest()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tx"),
        F.col(f"`{text}`").alias("text"))


def anchor_table(docs: DataFrame, width: int, id_column: str, text: str) -> DataFrame:
    """(id, tx, n_words, sha256, runs) of each row: its words, joined, and its anchored runs."""
    short_batches(docs)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_column].dataType), T.StructField("tx", T.LongType()),
        T.StructField("n_words", T.LongType()), T.StructField("sha256", T.StringType()),
        T.StructField("runs", T.ArrayType(T.StructType([
            T.StructField("anchor", T.LongType()), T.StructField("first", T.IntegerType()),
            T.StructField("count", T.IntegerType())]))),
    ])
    gram = min(GRAM, width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
                starts, ends, first = word_spans(raw, offsets)
                codes = word_codes(raw, starts, ends)
                doc, anchor, at, count = anchored_runs(_grams(codes, gram), gram, width, first)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows.num_rows))]), pa.int32()),
                    pa.StructArray.from_arrays([
                        pa.array(anchor.view(np.int64)), pa.array(at - first[doc], pa.int32()),
                        pa.array(count, pa.int32())], names=["anchor", "first", "count"]))
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), rows.column("tx"), pa.array(np.diff(first), pa.int64()),
                    pa.array(_digests(raw, starts, ends, first, np.ones(len(starts), bool))), lists,
                ], names=schema.names)

    return _rows(docs, id_column, text).mapInArrow(scan, schema)


def with_texts(
    keyed: DataFrame, docs: DataFrame, id_column: str, text: str, *columns: str
) -> DataFrame:
    """``keyed`` (id, tx, ...) joined with the texts; only texts it names travel."""
    names = keyed.select(F.col("id").alias("i"), F.col("tx").alias("t")).distinct()
    if keyed.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    rows = _rows(docs, id_column, text)
    here = rows.join(names, (rows.id == F.col("i")) & (rows.tx == F.col("t")), "left_semi")
    return keyed.join(here.dropDuplicates(["id", "tx"]), ["id", "tx"]).select("id", "tx", *columns, "text")


def window_rows(candidates: DataFrame, width: int) -> DataFrame:
    """(h1, h2, salt, id, tx, at) of every window in the runs of ``candidates``."""
    schema = T.StructType([
        T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType()),
        T.StructField("salt", T.IntegerType()), candidates.schema["id"],
        T.StructField("tx", T.LongType()), T.StructField("at", T.IntegerType()),
    ])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
                starts, ends, words = word_spans(raw, offsets)
                codes = word_codes(raw, starts, ends)
                lists = rows.column("runs")
                flat, sizes = lists.flatten(), np.asarray(lists.value_lengths())
                first, count, salt = (np.asarray(flat.field(i)) for i in range(3))
                doc = np.repeat(np.arange(rows.num_rows), sizes)
                doc, salt = np.repeat(doc, count), np.repeat(salt, count)
                at = ranges(first.astype(np.int64), count.astype(np.int64))
                place = words[doc] + at
                s1, p1 = prefix_hash(codes)
                s2, p2 = prefix_hash(codes, SECOND_BASE)
                h1 = mixed(span_hash(s1, p1, place, place + width)).view(np.int64)
                h2 = (mixed(span_hash(s2, p2, place, place + width)) >> np.uint64(33)).astype(np.int32)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h1), pa.array(h2), pa.array(salt, pa.int32()),
                    rows.column("id").take(take), rows.column("tx").take(take),
                    pa.array(at, pa.int32())], names=schema.names)

    return candidates.mapInArrow(hashes, schema)


def counted(windows: DataFrame) -> DataFrame:
    """(h1, h2, id, tx, at, repeat): windows under one hash and salt, streamed by identifier.

    ``repeat`` is true where the smallest identifier of the group is smaller; of salted
    groups, the rows of the smallest one are returned too, as not yet settled.
    """
    schema = T.StructType([windows.schema[c] for c in ("h1", "h2", "id", "tx", "at")]
                          + [T.StructField("repeat", T.BooleanType())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (h1, h2, salt, smallest identifier) of the open group
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, salt = (batch.column(c).to_numpy() for c in ("h1", "h2", "salt"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            head = np.ones(len(h1), bool)
            head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (salt[1:] != salt[:-1])
            least = ids.copy()
            if last is not None and (h1[0], h2[0], salt[0]) == last[:3]:
                least[0] = last[3]
            least = least[np.maximum.accumulate(np.where(head, np.arange(len(h1)), 0))]
            repeat = ids > least
            out = np.flatnonzero(repeat | (salt > 0))
            last = (h1[-1], h2[-1], salt[-1], least[-1])
            take = pa.array(out)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(take) for c in ("h1", "h2", "id", "tx", "at")],
                 pa.array(repeat[out])], names=schema.names)

    return windows.repartition("h1", "h2", "salt").sortWithinPartitions(
        "h1", "h2", "salt", "id").mapInArrow(settle, schema)


def repeats(
    docs: DataFrame, table: DataFrame, width: int, id_column: str, text: str, hot: int = HOT
) -> DataFrame:
    """(id, tx, at): the first words of all windows that a smaller identifier has too."""
    runs = table.where("id IS NOT NULL").select("id", "tx", F.explode("runs").alias("run")).select(
        "id", "tx", "run.*")
    shared = runs.groupBy("anchor").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.sum("count").alias("n"),
    ).where("low < high").select("anchor", (F.col("n") > hot).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    wanted = written(runs.join(shared, "anchor").groupBy("id", "tx").agg(
        F.collect_set(F.struct("first", "count", salt.alias("salt"))).alias("runs")))
    found = written(counted(window_rows(
        with_texts(wanted, docs, id_column, text, "runs"), width)))
    settled = found.where("repeat").select("id", "tx", "at")
    waiting = found.where(~F.col("repeat")).withColumn("salt", F.lit(0))
    if not waiting.limit(1).count():
        return settled
    # the smallest documents of each part of a hot group meet again
    again = counted(waiting.select("h1", "h2", "salt", "id", "tx", "at"))
    return settled.union(again.where("repeat").select("id", "tx", "at"))


def cleaned(
    docs: DataFrame, places: DataFrame, width: int, id_column: str, text: str
) -> DataFrame:
    """(id, tx, spans, n_removed, kept_text) of the documents with repeats.

    ``spans`` are the maximal removed intervals of words, [first, end).
    """
    by_doc = written(places.groupBy("id", "tx").agg(F.collect_set("at").alias("at")))
    schema = T.StructType([
        by_doc.schema["id"], T.StructField("tx", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()),
        T.StructField("kept_sha256", T.StringType()),
    ])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
                starts, ends, first = word_spans(raw, offsets)
                lists = rows.column("at")
                doc = np.repeat(np.arange(rows.num_rows), np.asarray(lists.value_lengths()))
                at = first[doc] + np.asarray(lists.flatten())
                step = np.zeros(len(starts) + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + width, -1)
                gone = np.cumsum(step[:-1]) > 0
                out = [[], [], [], []]
                shas = _digests(raw, starts, ends, first, ~gone)
                for i in range(rows.num_rows):
                    a, b = first[i], first[i + 1]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
                    out[0].append([{"first": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())])
                    out[1].append(int(gone[a:b].sum()))
                    words = [raw[s:e].tobytes() for s, e in zip(
                        starts[a:b][~gone[a:b]].tolist(), ends[a:b][~gone[a:b]].tolist())]
                    out[2].append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), rows.column("tx"), pa.array(out[0], lists_type),
                    pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(shas)],
                    names=schema.names)

    lists_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    return with_texts(by_doc, docs, id_column, text, "at").mapInArrow(remove, schema)


def dedup_windows(
    docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text: str = "text",
    hot: int = HOT,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans) of each row."""
    table = written(anchor_table(docs, width, id_column, text))
    changed = cleaned(docs, repeats(docs, table, width, id_column, text, hot), width, id_column, text)
    changed = changed.drop("kept_text").withColumnRenamed("id", "i").withColumnRenamed("tx", "t")
    joined = table.drop("runs").join(
        changed, (F.col("id") == F.col("i")) & (F.col("tx") == F.col("t")), "left")
    return joined.select(
        "id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "spans")
