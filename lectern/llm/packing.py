"""Best-fit packing by length histogram.

Documents are tokenised once and cut into pieces of at most ``size`` tokens. Best fit is
then planned over *counts*: the number of pieces of each length, at most ``size`` numbers
however large the corpus, is all that reaches the driver. Lengths are placed from long to
short; a whole block of equal pieces goes at once into the class of open sequences with
the least room that still takes one, and a class splits when only part of it is used.
The plan is a short list of slots, each a run of ranks of one length with the sequence
numbers and the place they take. Every piece is numbered within its length (offsets of
tasks from one small aggregate, so a frequent length is not gathered anywhere) and takes
the slot that covers its rank.

The plan's size is bounded by the size of a sequence, not by the corpus: each step of the
planner uses up either a length or a class of open sequences.

Tokenising looks at distinct words: texts are normalised and split the way the tokenizer
does it, words are hashed, and only words a worker has not met are handed to the
tokenizer. The classes of characters that words are made of are learned from the tokenizer
itself. Texts that hold its special strings, or a character that is not assigned or that its
tables and Python's treat differently, are encoded whole.

Defined results: a null or empty text is the closing token alone; repeated rows are
packed each on its own; other columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import (
    CHUNK, MIX, mixed, prefix_hash, ranges, row_chunks, short_batches, span_hash, written,
)

SEQUENCE = 4096
CLOSING = 1
OUTPUT = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
TABLE_BITS = 20  # slots of a worker's word table
POOL = 1 << 19  # words a worker keeps before it starts anew

# The pre-tokenizer's classes of characters, and its contractions (fixed values of the vocabulary file).
LETTER, NUMBER, SPACE, OTHER, UNSURE = 1, 2, 0, 3, 4
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class WordTokens:
    """Token ids of texts by way of their distinct words; one per Python worker."""

    def __init__(self, path: str, classes: tuple[np.ndarray, np.ndarray] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        first, kind = classes if classes is not None else learned_classes(path)
        self.kinds = np.repeat(kind, np.diff(np.append(first, 0x110000)))
        self.reset()

    def reset(self) -> None:
        self.slot_hash = np.zeros(1 << TABLE_BITS, np.uint64)
        self.slot_word = np.full(1 << TABLE_BITS, -1, np.int32)
        self.beside: dict[int, int] = {}  # words whose slot is taken
        self.start = np.zeros(POOL + 1, np.int64)
        self.count = np.zeros(POOL, np.int32)
        self.ids = np.zeros(POOL * 2, np.uint32)
        self.words = self.used = 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode new words and file them under their hashes."""
        joined = [" ".join(words[i: i + 500]) for i in range(0, len(words), 500)]
        found = np.concatenate([  # a few thousand words at a time: encodings are large objects
            np.array(e.ids, np.uint32) for i in range(0, len(joined), 8)
            for e in self.tokenizer.encode_batch_fast(joined[i: i + 8], add_special_tokens=False)])
        last = np.flatnonzero(self.ends[found])
        if len(last) != len(words):
            raise Unsplit
        counts = np.diff(np.concatenate([[-1], last]))
        first, k = self.words, len(words)
        if first + k > len(self.count):
            grown = max(len(self.count) * 2, first + k)
            self.count = np.resize(self.count, grown)
            self.start = np.resize(self.start, grown + 1)
        if self.used + len(found) > len(self.ids):
            self.ids = np.resize(self.ids, max(len(self.ids) * 2, self.used + len(found)))
        self.ids[self.used: self.used + len(found)] = found
        self.count[first: first + k] = counts
        self.start[first: first + k] = self.used + np.cumsum(counts) - counts
        self.words, self.used = first + k, self.used + len(found)
        numbers = np.arange(first, first + k, dtype=np.int32)
        slots = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        free = self.slot_word[slots] < 0
        self.slot_hash[slots[free]] = hashes[free]
        self.slot_word[slots[free]] = numbers[free]
        lost = self.slot_hash[slots] != hashes  # taken before, or by another of these words
        self.beside.update(zip(hashes[lost].tolist(), numbers[lost].tolist()))

    def _numbers(self, hashes: np.ndarray, word_at) -> np.ndarray:
        """Word number of each hash; ``word_at(i)`` is the text of word ``i``."""
        slots = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.where(self.slot_hash[slots] == hashes, self.slot_word[slots], -1)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            distinct, example, back = np.unique(
                hashes[missing], return_index=True, return_inverse=True)
            got = np.array([self.beside.get(h, -1) for h in distinct.tolist()], np.int64)
            new = np.flatnonzero(got < 0)
            if len(new):
                got[new] = np.arange(self.words, self.words + len(new))
                self._learn(distinct[new], [word_at(i) for i in missing[example[new]].tolist()])
            out[missing] = got[back]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        if self.words > POOL:
            self.reset()
        alone = {i for i, t in enumerate(texts) if "<|" in t and any(s in t for s in SPECIAL)}
        try:
            return self._encode(texts, alone)
        except Unsplit:  # the tokenizer does not take these words one by one after all
            self.reset()
            return self._encode(texts, set(range(len(texts))))

    def _encode(self, texts: list[str], alone: set[int]) -> tuple[np.ndarray, np.ndarray]:
        whole = {i: self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in alone}
        parts = ["" if i in whole else t for i, t in enumerate(texts)]
        text = "\n".join(parts)
        if not unicodedata.is_normalized("NFC", text):
            parts = [unicodedata.normalize("NFC", t) for t in parts]
        parts = [_lower(t) for t in parts]
        text = "\n".join(parts)
        bounds = np.cumsum([0] + [len(t) + 1 for t in parts])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[codes]
        unsure = np.flatnonzero(kinds == UNSURE)
        if len(unsure):  # no normalisation makes such a character a sure one
            return self._encode(texts, alone | set((np.searchsorted(bounds, unsure, "right") - 1).tolist()))
        change = np.empty(len(kinds), bool)
        if len(kinds):
            change[0] = True
            change[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
            self._contractions(codes, kinds, change)
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(kinds))
        words = kinds[starts] != SPACE
        starts, ends = starts[words], ends[words]
        sums, p = prefix_hash(codes)
        hashes = _spread(span_hash(sums, p, starts, ends), ends - starts)
        numbers = self._numbers(hashes, lambda i: text[starts[i]: ends[i]])
        counts = self.count[numbers].astype(np.int64)
        ids = self.ids[ranges(self.start[numbers], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        lengths = np.diff(total[np.searchsorted(starts, bounds)])
        if whole:
            cut = np.split(ids, np.cumsum(lengths)[:-1])
            for i, w in whole.items():
                cut[i] = np.array(w, np.uint32)
            ids, lengths = np.concatenate(cut), np.array([len(c) for c in cut])
        return ids, lengths

    @staticmethod
    def _contractions(codes: np.ndarray, kinds: np.ndarray, change: np.ndarray) -> None:
        """Where an apostrophe opens a run and a contraction follows, the letters join it."""
        at = np.flatnonzero((codes == ord("'")) & change)
        for i in at.tolist():
            follow = "".join(map(chr, codes[i + 1: i + 3].tolist()))
            for c in CONTRACTIONS:
                if follow.startswith(c[1:]):
                    change[i + 1] = False
                    if i + len(c) < len(change):
                        change[i + len(c)] = True
                    break


_CLASSES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def learned_classes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(first code point, class) of the runs of code points that the tokenizer's splitter treats alike.

    Characters that are not assigned, private ones, and those that the tokenizer normalises
    in another way than ``unicodedata`` are ``UNSURE``: tables of different ages disagree on
    them, so texts with such a character are encoded whole. The runs are a few kilobytes.
    """
    if path in _CLASSES:
        return _CLASSES[path]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    every = [c for c in map(chr, range(1, 0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    kinds = np.full(0x110000, UNSURE, np.uint8)
    # alone, between the parts of a syllable, and marks beside one mark of each class of order
    classes = {unicodedata.ucd_3_2_0.combining(c): c for c in reversed(every)}
    beside = [shape for m in classes.values() for shape in (f"a{{}}{m}", f"a{m}{{}}")]
    for at in range(0, len(every), 10_000):
        some = every[at: at + 10_000]
        codes = np.array([ord(c) for c in some])
        probe = " ".join(f"a{c}a {c}{c}" for c in some)  # seven characters and a space between them
        starts = np.array([span[0] for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(probe)])
        number, inside = starts // 7, starts % 7
        between = np.bincount(number[inside < 4], minlength=len(some))
        twice = np.bincount(number[inside >= 4], minlength=len(some))
        for kind, counts in ((LETTER, (1, 1)), (NUMBER, (3, 2)), (OTHER, (3, 1)), (SPACE, (2, 0))):
            kinds[codes[(between == counts[0]) & (twice == counts[1])]] = kind
        marks = [c for c in some if unicodedata.category(c)[0] == "M"]
        for shape, own in [("{}", some), ("\u1100{}\u11a8", some), *[(b, marks) for b in beside if marks]]:
            texts = [shape.format(c) for c in own]
            theirs = tokenizer.normalizer.normalize_str("\0".join(texts)).split("\0")
            kinds[[ord(c) for c, x, y in zip(own, theirs, map(_normalised, texts))
                   if x != y and kinds[ord(c)] != SPACE]] = UNSURE
    first = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
    return _CLASSES.setdefault(path, (first, kinds[first]))


class Unsplit(Exception):
    """A word that the tokenizer encodes as none or several."""


def _lower(text: str) -> str:
    """Lower case letter by letter, as the tokenizer does it: no final-sigma rule."""
    return text.replace("Σ", "σ").lower()


def _normalised(text: str) -> str:
    return _lower(unicodedata.normalize("NFC", text))


def _spread(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = mixed(hashes + lengths.astype(np.uint64) * MIX)
    out[out == 0] = 1
    return out


_TOKENS: dict[str, WordTokens] = {}


def pieces(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, closing: int = CLOSING,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth) of each piece of each document.

    ``nth`` numbers the pieces of one length within the task that cut them.
    """
    short_batches(docs)
    classes = learned_classes(tokenizer)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_column].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        words = _TOKENS.get(tokenizer) or _TOKENS.setdefault(tokenizer, WordTokens(tokenizer, classes))
        for batch in batches:
            for rows, _, _ in row_chunks(batch, "text", CHUNK):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                ids, lengths = words.encode(texts)
                ends = np.cumsum(lengths + 1)
                stream = np.full(len(ids) + len(texts), closing, "<u4")
                body = np.ones(len(stream), bool)
                body[ends - 1] = False
                stream[body] = ids
                sizes = lengths + 1
                count = -(-sizes // size)
                doc = np.repeat(np.arange(len(texts)), count)
                piece = ranges(np.zeros(len(texts), np.int64), count)
                start = piece * size
                length = np.minimum(sizes[doc] - start, size)
                at = (ends - sizes)[doc] + start
                order = np.argsort(length, kind="stable")
                runs = np.flatnonzero(np.diff(length[order], prepend=-1))
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(
                    runs, np.diff(np.append(runs, len(length)))) + seen[length[order]]
                seen += np.bincount(length, minlength=size + 1)
                data = memoryview(stream).cast("B")
                crc = [zlib.crc32(data[4 * a: 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([
                    rows.column("id").take(pa.array(doc)), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()),
                    pa.array(nth),
                ], names=schema.names)

    return docs.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")
    ).mapInArrow(cut, schema)


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, count, sequence, offset) slots.

    Rank ``first + i`` of the length stands in sequence ``sequence + i`` at ``offset``.
    ``room[r]`` holds the runs of open sequences (first number, how many) with ``r`` left.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # rooms in use, ascending
    opened = 0

    def leave(space: int, first: int, count: int) -> None:
        if space:
            if space not in room:
                room[space] = []
                bisect.insort(order, space)
            room[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):  # nothing takes it: open sequences, each filled with as many as fit
                each = size // length
                bins, rest = divmod(left, each)
                for k in range(each if bins else 0):
                    slots.append((length, rank, bins, opened, k * length))
                    rank += bins
                if bins:
                    leave(size - each * length, opened, bins)
                    opened += bins
                for k in range(rest):
                    slots.append((length, rank, 1, opened, k * length))
                    rank += 1
                if rest:
                    leave(size - rest * length, opened, 1)
                    opened += 1
                left = 0
                break
            space = order[at]
            runs = room[space]
            first, count = runs.pop()
            if not runs:
                del room[space]
                order.pop(at)
            each = space // length
            bins = min(count, -(-left // each))
            full, rest = divmod(min(left, bins * each), each)
            for k in range(each if full else 0):
                slots.append((length, rank, full, first, size - space + k * length))
                rank += full
            if full:
                leave(space - each * length, first, full)
            for k in range(rest):
                slots.append((length, rank, 1, first + full, size - space + k * length))
                rank += 1
            used = full + (1 if rest else 0)
            if rest:
                leave(space - rest * length, first + full, 1)
            if used < count:
                leave(space, first + used, count - used)
            left -= full * each + rest
    return slots


def pack(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``cut``, the written table of ``pieces``, plus sequence_id and offset.

    What reaches the driver is one count per length; what goes back to the tasks is the
    plan, whose size depends on ``size`` alone.
    """
    counts = written(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = np.array(plan(histogram, size), np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one key for (length, rank): slots are sorted by it, a piece belongs to the last not above
        span = int(table[:, 1].max()) + int(table[:, 2].max()) + 1 if len(table) else 1
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            slot = np.searchsorted(keys, length * span + rank, "right") - 1
            sequence = table[slot, 3] + rank - table[slot, 1]
            out = [batch.column(c) for c in OUTPUT[:5]]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(sequence), pa.array(table[slot, 4])], names=OUTPUT)

    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        "length", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["length", "task"]).select(
        *OUTPUT[:5], (F.col("nth") + F.col("before")).alias("rank"))
    schema = T.StructType([*[cut.schema[c] for c in OUTPUT[:5]],
                           T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, **columns) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return pack(written(pieces(docs, tokenizer, size, **columns)), size)
