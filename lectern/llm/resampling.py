"""Importance resampling towards a target distribution, drawn by distributed quickselect.

A text's features are its runs of up to ``longest`` words, hashed to ``buckets``. Bucket
counts of the raw corpus and of the target texts are two arrays of fixed size; the
logarithm of their smoothed ratio is the gain of a bucket, and the weight of a document is
the sum of its features' gains, looked up in that array. A Gumbel number from a hash of the
identifier is added, so that the highest scores are a draw without replacement in
proportion to the weights.

The ``k`` highest scores are found without sorting the corpus. All rows have a composite
key (score, identifier, row number). In each round some keys of the interval in question
are picked at random as pivots, every row is counted below, at or above each of them, and
the interval shrinks to the one between two pivots that holds the k-th key, until a pivot
is that key. Only the winners are then sorted, by range, and ranked by their place.

Defined results: null and empty texts have no features, weight 0 and no chance below
``least_words``; equal scores go by identifier, null identifiers last, and equal rows by
row number, so that exactly ``k`` rows are drawn; without target texts all gains compare
the corpus with nothing; an empty table gives no rows. Texts are taken whole, at most half
a megabyte or one longer text at a time. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checksums import START, read_on
from .textbytes import CHUNK, row_chunks, short_batches, word_spans, written

PIVOTS = 64  # keys a round compares every row with
SCALE = 1000  # gains and scores are whole thousandths

_KEPT = np.zeros(256, bool)
_KEPT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SPACE = np.array([0x20], np.uint8)


def buckets_of(
    raw: np.ndarray, offsets: np.ndarray, longest: int, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature, with repeats, and the number of words of each text."""
    upper = (raw >= 65) & (raw <= 90)
    low = raw + (upper.astype(np.uint8) << np.uint8(5))
    starts, ends, first = word_spans(np.where(_KEPT[low], low, np.uint8(0x20)), offsets)
    words = np.diff(first)
    text = np.repeat(np.arange(len(words)), words)
    texts, found = [], []
    at = np.arange(len(starts))
    state = read_on(np.full(len(starts), START), low, starts, ends)
    for size in range(1, longest + 1):
        if size > 1:  # the run from each word grows by a space and the next word, where there is one
            goes_on = np.flatnonzero(at + size - 1 < first[text[at] + 1])
            at = at[goes_on]
            zero = np.zeros(len(at), np.int64)
            state = read_on(state[goes_on], _SPACE, zero, zero + 1)
            state = read_on(state, low, starts[at + size - 1], ends[at + size - 1])
        texts.append(text[at])
        found.append((~state % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(found), words


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in all texts; a task sends at most one row a bucket."""
    short_batches(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, raw, offsets in row_chunks(batch, "text", CHUNK):
                total += np.bincount(buckets_of(raw, offsets, longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket long, n long").groupBy(
        "bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of each bucket's smoothed ratio of shares."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + len(s))) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def weighed(
    docs: DataFrame, gain: np.ndarray, longest: int = 1, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: gains summed from the array."""
    short_batches(docs)
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *[
        T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
                owner, bucket, words = buckets_of(raw, offsets, longest, len(gain))
                weight = np.zeros(rows.num_rows, np.int64)
                np.add.at(weight, owner, gain[bucket])
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), pa.array(words, pa.int64()),
                    pa.array(np.bincount(owner, minlength=rows.num_rows), pa.int64()),
                    pa.array(weight)], names=schema.names)

    return docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        weigh, schema)


def gumbel(seed: int, identifier: Column) -> Column:
    """A Gumbel number in whole thousandths, from a hash of seed and identifier."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def kth_key(rows: DataFrame, key: list[str], k: int, pivots: int = PIVOTS, seed: int = 0):
    """The k-th smallest (from 1) of the distinct composite keys of ``rows``, as a Row.

    The last column of ``key`` tells all rows apart. A round reads the rows twice: for random
    pivots of the open interval, and to count every row of it below, at or above them.
    """
    types = {f.name: f.dataType for f in rows.schema.fields}
    whole = F.struct(*key)
    constant = lambda r: F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in key])
    active, turn = rows, 0
    while True:
        turn += 1
        picked = active.orderBy(F.xxhash64(F.lit(seed + turn), F.col(key[-1])), key[-1]).limit(pivots)
        chosen = picked.agg(F.sort_array(F.collect_list(whole)).alias("all")).first()["all"]
        table = F.array(*[constant(r) for r in chosen])
        below = F.size(F.filter(table, lambda p: p < whole))
        hit = F.exists(table, lambda p: p[key[-1]] == F.col(key[-1]))
        counts = {(r["below"], r["hit"]): r["count"] for r in active.groupBy(
            below.alias("below"), hit.alias("hit")).count().collect()}
        for i in range(len(chosen) + 1):
            between = counts.get((i, False), 0)
            if k <= between:
                break
            k -= between
            if i == len(chosen):
                raise ValueError("there are fewer rows than k")
            if k <= counts.get((i, True), 0):
                return chosen[i]
            k -= counts.get((i, True), 0)
        if i > 0:
            active = active.where(whole > constant(chosen[i - 1]))
        if i < len(chosen):
            active = active.where(whole < constant(chosen[i]))


def ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of ``key``: sorted by range, places added up."""
    place = F.monotonically_increasing_id()  # partition number and place in it
    spread = written(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("place_", place))
    part = F.shiftright("place_", 33)
    sizes = spread.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    # one row a partition of the sort
    ahead = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("ahead_"))
    inside = F.col("place_").bitwiseAND((1 << 33) - 1)
    return spread.withColumn("part_", part).join(F.broadcast(ahead), "part_").select(
        *rows.columns, (inside + F.col("ahead_") + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20,
    longest: int = 1, buckets: int = 10_000, seed: int = 2024, id_column: str = "doc_id",
    text: str = "text", target_text: str = "text", pivots: int = PIVOTS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; rank is null where not drawn.

    Of the documents with at least ``least_words`` words, ``share`` of them (numerator,
    denominator, rounded down) are drawn.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets),
                 bucket_counts(target, target_text, longest, buckets))
    scored = written(weighed(docs, gain, longest, id_column, text).select(
        "*", (F.col("weight") + gumbel(seed, F.col("id"))).alias("score"),
        F.monotonically_increasing_id().alias("row_")))
    key = ["down_", "none_", "id", "row_"]
    keyed = scored.withColumn("down_", -F.col("score")).withColumn("none_", F.col("id").isNull())
    able = keyed.where(F.col("n_words") >= least_words)
    k = share[0] * able.count() // share[1]
    columns = ["id", "n_words", "n_features", "weight", "score"]
    rest = keyed.withColumn("rank", F.lit(None).cast("long")).select(*columns, "rank")
    if not k:
        return rest
    last = kth_key(able.select(*key), key, k, pivots, seed)
    types = {f.name: f.dataType for f in able.schema.fields}
    drawn = (F.col("n_words") >= least_words) & (F.struct(*key) <= F.struct(*[
        F.lit(last[c]).cast(types[c]).alias(c) for c in key]))
    winners = ranked(keyed.where(drawn).select(*columns, *key[:2], key[3]), key)
    lost = keyed.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return winners.select(*columns, "rank").unionByName(lost.select(*columns, "rank"))
