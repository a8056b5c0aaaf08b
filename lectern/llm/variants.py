"""Spelling variants, grouped through a reduced alphabet.

Words are the runs of letters ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased, counted over
all texts. Every letter is hashed to one of a few symbols, so that a word becomes a short
string over them, and words that differ by one edit have reduced strings that are equal or
differ by one edit. The one-edit neighbourhood of each distinct reduced string is generated
as hashes and joined with the reduced vocabulary; being neighbours is mutual, so each pair
is generated from one side: the longer string deletes, the one with the smaller symbol
replaces it, and the string itself stands for words that are reduced alike. Pairs of words
whose reduced strings meet are verified on the original strings.

The reduced alphabet keeps the neighbourhood small (a few dozen hashes a word whatever the
alphabet of the texts), and hashes are polynomials whose terms are exchanged, so the
neighbours of a word of any length cost one row each and no string is built. Hashes only
propose; counting and verification are on whole strings.

Each word's *form* is its most frequent near word, if that is frequent enough; following
forms to the end gives the *root*. Frequencies rise along the way, so the ways are short.

Defined results: null texts have no words; equal rows are counted each; a null identifier
is an empty one; a word without near words has no form and is its own root; an empty
table gives no rows. Texts are taken whole, half a megabyte or one longer text at a time.
Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checksums import START, read_on
from .textbytes import CHUNK, MIX, mixed, prefix_hash, row_chunks, short_batches, text_buffers, word_spans, written

SYMBOLS = 8  # of the reduced alphabet
PENDING = 400_000  # distinct words a task holds before it sends their counts
AT_ONCE = 1 << 20  # neighbours made together, or those of one word

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def letter_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lower-cased bytes, start, end, text number) of the runs of letters.

    U+00C0 to U+00FF are the characters whose first byte is 0xC3.
    """
    low = raw + (_UPPER[raw].astype(np.uint8) << np.uint8(5))
    letter = _LOWER[low] | (low == 0xC3)
    letter[1:] |= low[:-1] == 0xC3
    starts, ends, first = word_spans(np.where(letter, np.uint8(0x61), np.uint8(0x20)), offsets)
    return low, starts, ends, np.repeat(np.arange(len(first) - 1), np.diff(first))


def run_hashes(names: pa.Array, text: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``<name of its text>:<run>`` for each run."""
    raw, offsets = text_buffers(names)
    state = read_on(np.full(len(names), START), raw, offsets[:-1], offsets[1:])
    colon = np.array([0x3A], np.uint8)
    zero = np.zeros(len(names), np.int64)
    state = read_on(state, colon, zero, zero + 1)
    return ~read_on(state[text], low, starts, ends)


def words_of(
    names: pa.Array, raw: np.ndarray, offsets: np.ndarray, least: int, slip: int | None
) -> pa.Array:
    """The words of at least ``least`` code points, with repeats.

    With ``slip``, a run whose hash ``slip`` divides loses the code point at the hash modulo
    its length: a reproducible misprint, as the texts that are to be grouped would have.
    """
    low, starts, ends, text = letter_runs(raw, offsets)
    begins = (low & np.uint8(0xC0)) != np.uint8(0x80)  # first bytes of code points
    upto = np.concatenate([[0], np.cumsum(begins)])
    size = upto[ends] - upto[starts]
    kept = np.ones(len(low), bool)
    if slip is not None and len(starts):
        h = run_hashes(names, text, low, starts, ends)
        hit = np.flatnonzero(h % np.uint32(slip) == 0)
        places = np.flatnonzero(begins)
        at = places[upto[starts[hit]] + (h[hit] % size[hit].astype(np.uint32)).astype(np.int64)]
        kept[at] = False
        wide = at[low[at] == 0xC3]
        kept[wide + 1] = False
        size[hit] -= 1
    some = size >= least
    starts, ends = starts[some], ends[some]
    inside = np.zeros(len(low) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # runs do not touch but where texts meet, and there the two cancel
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) & kept
    bytes_upto = np.concatenate([[0], np.cumsum(inside)])
    bounds = np.concatenate([[0], np.cumsum(bytes_upto[ends] - bytes_upto[starts])]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low[inside]))


def word_counts(
    docs: DataFrame, least: int = 7, slip: int | None = None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(word, n) of all words, added up in the tasks first."""
    short_batches(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.Table] = []
        held = 0

        def together() -> pa.Table:
            return pa.concat_tables(pending).group_by("word").aggregate([("n", "sum")]).select(
                ["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
                counted = words_of(rows.column("id"), raw, offsets, least, slip).value_counts()
                pending.append(pa.Table.from_arrays([counted.field(0), counted.field(1)], ["word", "n"]))
                held += len(counted)
                if held > PENDING:
                    pending[:] = [together()]
                    held = pending[0].num_rows
                    if held > PENDING // 2:
                        yield from pending[0].combine_chunks().to_batches(max_chunksize=20_000)
                        pending.clear()
                        held = 0
        if pending:
            yield from together().combine_chunks().to_batches(max_chunksize=20_000)

    return docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"),
        F.col(f"`{text}`").alias("text"),
    ).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbol_of(symbols: int) -> np.ndarray:
    """The symbol (from 1) of every code point below 256, by a hash of the code point."""
    return (mixed(np.arange(256, dtype=np.uint64) + MIX) % np.uint64(symbols)).astype(np.int64) + 1


def _codes(words: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all words one after another, bounds of the words)."""
    raw, offsets = text_buffers(words)
    begins = (raw & np.uint8(0xC0)) != np.uint8(0x80)
    point = raw.astype(np.int64)
    wide = np.flatnonzero(raw == 0xC3)
    point[wide] = raw[wide + 1].astype(np.int64) + 0x40  # 0xC0 and the low six bits
    upto = np.concatenate([[0], np.cumsum(begins)])
    return symbol_of(symbols)[point[begins]], upto[offsets]


def reduced_hashes(words: pa.Array, symbols: int = SYMBOLS) -> tuple[np.ndarray, pa.Array]:
    """(hash, string) of each word's reduced form."""
    codes, bounds = _codes(words, symbols)
    sums, p = prefix_hash(codes)
    with np.errstate(over="ignore"):
        h = (sums[bounds[1:]] - sums[bounds[:-1]]) * p.down[bounds[:-1]]
        h = mixed(h + np.diff(bounds).astype(np.uint64) * MIX)
    letters = (codes + 96).astype(np.uint8)
    return h, pa.StringArray.from_buffers(
        len(words), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(letters))


def neighbourhoods(codes: np.ndarray, bounds: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(string number, hash) of the neighbours of many reduced strings, the string itself first."""
    sums, p = prefix_hash(codes)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    low, high = bounds[:-1], bounds[1:]
    size = np.diff(bounds).astype(np.uint64)
    with np.errstate(over="ignore"):
        whole = (sums[high] - sums[low]) * p.down[low]
        owners, found = [np.arange(len(size))], [mixed(whole + size * MIX)]
        at = np.arange(len(codes))
        before = (sums[at] - sums[low[owner]]) * p.down[low[owner]]
        after = (sums[high[owner]] - sums[at + 1]) * p.down[low[owner]] * np.uint64(p.inverse)
        owners.append(owner)
        found.append(mixed(before + after + (size[owner] - np.uint64(1)) * MIX))
        for step in range(1, symbols):
            some = np.flatnonzero(codes + step <= symbols)
            mine = owner[some]
            term = np.uint64(step) * p.up[some - low[mine]]
            owners.append(mine)
            found.append(mixed(whole[mine] + term + size[mine] * MIX))
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((found, owners))
    owners, found = owners[order], found[order]
    new = np.ones(len(owners), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (found[1:] != found[:-1])
    return owners[new], found[new]


def near_pairs(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, n_a, b, n_b), each unordered pair once: words of ``vocabulary`` (word, n) one edit apart."""
    schema = T.StructType([
        T.StructField("word", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("hash", T.LongType()), T.StructField("reduced", T.StringType())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in row_chunks(batch, "word", CHUNK):
                h, strings = reduced_hashes(rows.column("word"), symbols)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("word"), rows.column("n"), pa.array(h.view(np.int64)), strings],
                    names=schema.names)

    table = written(vocabulary.mapInArrow(reduce, schema))

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "reduced", AT_ONCE // 16):
                codes = raw.astype(np.int64) - 96
                owner, key = neighbourhoods(codes, offsets, symbols)
                own = rows.column("hash").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(own[owner])], names=["key", "hash"])

    reduced = table.select("hash", "reduced").distinct()
    met = reduced.mapInArrow(generate, "key long, hash long").join(
        table.select(F.col("hash").alias("key")).distinct(), "key")
    met = written(met.distinct())
    words = lambda c, key: table.select(
        F.col("hash").alias(key), F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    proposed = met.join(words("a", "hash"), "hash").join(words("b", "key"), "key").where(
        (F.col("hash") != F.col("key")) | (F.col("a") < F.col("b")))
    return proposed.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, form): forms followed to the last.

    Each round doubles the steps taken; the ways are as long as frequencies can rise.
    """
    ways = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(ways.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ways = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return ways


def variant_forms(
    docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, slip: int | None = None,
    symbols: int = SYMBOLS, id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    The vocabulary has the words of at least ``least_length`` code points that occur at
    least ``least_count`` times; a form is at least ``ratio`` times as frequent as its word.
    """
    vocabulary = written(word_counts(docs, least_length, slip, id_column, text).where(F.col("n") >= least_count))
    pairs = near_pairs(vocabulary, symbols)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), F.col("n_a").alias("m"), F.col("a").alias("near")))).alias("p")).select("p.*")
    # the most frequent near word, the smallest of equally frequent ones
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    good = -F.col("best.m") >= ratio * F.col("n")
    named = written(vocabulary.join(best, "word", "left").select(
        "word", F.when(good, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, -F.col("best.m")).alias("form_n")))
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
