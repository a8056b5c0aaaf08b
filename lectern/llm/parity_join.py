"""N-gram Jaccard join by parity sketches.

A document's distinct word shingles are hashed into a bit sketch: each shingle flips one
bit, so the Hamming distance of two sketches never exceeds the symmetric difference of
the two sets. Two sets of sizes a and b with Jaccard at least t differ in at most
``(1 - t) / (1 + t) * (a + b)`` shingles, D say. The sketch of a size band is cut into
more than D words; differing shingles fall into D of them at most, so similar documents
agree in a whole word, shingle for shingle. Documents meet where band, word number, word
and the parity of the shingle hashes in it agree. Words with few shingles say little and
would meet by chance: a sketch has words to spare, more of them the smaller a document is
in its band, and a document leaves out its words of the fewest shingles as far as its
spares go. Spares that are left over pay for buckets: linked documents then share more
buckets than that, and the one of them with the fewest members is never among the largest
ones of either, so each document leaves as many of its largest buckets as it has spares to
give. No link is lost.

Documents with the same set form a class, and one of them stands for it. Links between
classes are found in rounds. A bucket first proposes its members to the one that meets most others;
proposals are verified on the shingles themselves, classes that hang together get one
label, and a bucket whose members share a label is done. What is left, pairs with
different labels in one bucket that have not been tried, is looked at to the last pair:
small buckets send their pairs, large ones are cut into bounded blocks by label, and a task
compares the sketches of two blocks, unless both hold one label only. Only pairs whose
sketches are within the bound are verified on the texts, a bounded number of partners a task.
Large buckets give out the nearest pair of each two labels first, over and over while that
joins any; only then every pair within the bound that is left. Large groups of near copies
so send one comparison a member, not one a pair, and every pair that could join two
components is looked at.

Defined results: a null text is empty; a document without words has no shingles and is
linked with nothing; rows with equal texts are in one component; the component's name is
the smallest identifier, null identifiers aside; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import (
    CHUNK, MIX, mixed, ranges, row_chunks, short_batches, word_codes, word_spans, written,
)

SMALL = 12  # members of a bucket whose pairs are verified without comparing sketches
SKETCH_BITS = 4  # of a sketch for comparison, for each shingle that linked sets may differ in
BLOCK = 4096  # members of a mixed bucket that are compared with as many others in one task
PARTNERS = 1024  # partners of a hub that one task verifies
RATIO = 1.4  # of the largest to the smallest size in a band
BROADCAST_ROWS = 300_000  # of (identifier, hash): 7 MB


class Bands:
    """Size bands and the number of sketch words of each, for a threshold num/den."""

    def __init__(self, num: int, den: int, top: int = 1 << 31):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < top:
            low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
        self.low = np.array(low, np.int64)
        high = np.append(self.low[1:] - 1, top)
        self.most = (den - num) * 2 * high // (den + num)  # differing shingles in a linked pair
        # a word has some (den + num) / 2 (den - num) shingles; the fewer, the more spares
        self.few, share = (3, 12) if (den + num) // (2 * (den - num)) >= 8 else (2, 3)
        self.words = self.most + 1 + np.where(self.most > 0, 1 + self.most // share, 0)
        self.high = high
        # words of 64 bits for comparison, powers of two, so that a long sketch folds to a short one
        need = np.maximum(SKETCH_BITS * self.most // 64, 3)
        self.sketch = 1 << (np.floor(np.log2(need)).astype(np.int64) + 1)

    def spare(self, band: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Words of a sketch in ``band`` that agree with any linked one's, beyond the first."""
        return self.words[band] - 1 - (self.den - self.num) * (n + self.high[band]) // (self.den + self.num)

    def of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own band, whether a linked partner may be in the next band)."""
        own = np.searchsorted(self.low, n, "right") - 1
        reach = n * self.den // self.num  # size of the largest partner
        return own, reach >= self.low[np.minimum(own + 1, len(self.low) - 1)]


def shingles(
    raw: np.ndarray, offsets: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of the distinct shingles of each text, sorted by both."""
    upper = (raw >= 65) & (raw <= 90)
    low = raw + (upper.astype(np.uint8) << np.uint8(5))
    starts, ends, first = word_spans(low, offsets)
    codes = word_codes(low, starts, ends)
    words = np.diff(first)
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(words)), count)
    at = ranges(first[:-1], count)
    size = np.minimum(words, width)[doc]
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            here = codes[np.minimum(at + k, max(len(codes) - 1, 0))] if len(codes) else total
            total = (total * np.uint64(0xD6E8FEB86659FD93)) + np.where(size > k, here, 0).astype(np.uint64)
        hashes = mixed(total + size.astype(np.uint64) * MIX)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def band_keys(
    doc: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, docs: np.ndarray, band: np.ndarray,
    bands: Bands,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket key) for the documents ``docs``, each in its ``band``, and how many
    of its largest buckets each of them may leave."""
    words = bands.words[band]
    base = np.cumsum(words) - words
    row = np.full(len(sizes), -1, np.int64)
    row[docs] = np.arange(len(docs))
    mine = row[doc] >= 0
    r, h = row[doc[mine]], hashes[mine]
    with np.errstate(over="ignore"):
        bit = mixed(h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(12)
        bit = (bit % (words[r] * 64).astype(np.uint64)).astype(np.int64)
        slot = base[r] + bit // 64
        flat = int(words.sum())
        sketch, parity = np.zeros(flat, np.uint64), np.zeros(flat, np.uint64)
        np.bitwise_xor.at(sketch, slot, np.uint64(1) << (bit % 64).astype(np.uint64))
        np.bitwise_xor.at(parity, slot, h)
        held = np.bincount(slot, minlength=flat)
        owner = np.repeat(np.arange(len(docs)), words)
        number = np.arange(flat) - base[owner]
        spare = bands.spare(band, sizes[docs])
        send = np.ones(flat, bool)
        for few in range(1, bands.few + 1):  # fewest shingles first, while the spares make up for them
            spared = np.bincount(owner, weights=held < few, minlength=len(docs)).astype(np.int64)
            send &= ~((held < few) & (spared <= spare)[owner])
        place = band[owner].astype(np.uint64) * np.uint64(1 << 32) + number.astype(np.uint64)
        keys = mixed(mixed(mixed(place + MIX) + sketch) + parity)
    return docs[owner[send]], keys[send].view(np.int64), np.maximum(spare - spared, 0)


def sketch_table(
    docs: DataFrame, bands: Bands, width: int, id_column: str, text: str
) -> DataFrame:
    """(rid, id, tx, n, s1, s2, sketch, keys, leave, above, leave_above) of each row: set size
    and signature, a sketch whose length goes by the band, bucket keys in the own band and
    those in the one above, each with the number of largest buckets to be left."""
    short_batches(docs)
    schema = T.StructType([
        T.StructField("rid", T.LongType()), T.StructField("id", docs.schema[id_column].dataType),
        T.StructField("tx", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()),
        T.StructField("sketch", T.ArrayType(T.LongType())),
        T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("leave", T.LongType()),
        T.StructField("above", T.ArrayType(T.LongType())), T.StructField("leave_above", T.LongType()),
    ])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
                doc, hashes = shingles(raw, offsets, width)
                k = rows.num_rows
                n = np.bincount(doc, minlength=k)
                with np.errstate(over="ignore"):
                    ends = np.cumsum(n)
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in
                            (hashes, mixed(hashes ^ MIX))]
                    s1, s2 = ((s[ends] - s[ends - n]).view(np.int64) for s in sums)
                own, beyond = bands.of(np.maximum(n, 1))
                some = np.flatnonzero(n > 0)
                also = np.flatnonzero((n > 0) & beyond)
                columns = []
                for mine, band in ((some, own[some]), (also, own[also] + 1)):
                    d, key, left = band_keys(doc, hashes, n, mine, band, bands)
                    order = np.argsort(d, kind="stable")
                    leave = np.zeros(k, np.int64)
                    leave[mine] = left
                    columns += [_lists(np.bincount(d, minlength=k), key[order]), pa.array(leave)]
                size = bands.sketch[np.minimum(own + 1, len(bands.sketch) - 1)]
                first = np.cumsum(size) - size
                bit = (mixed(hashes ^ MIX) >> np.uint64(12)).astype(np.int64) % (size[doc] * 64)
                bits = np.zeros(int(size.sum()), np.uint64)
                np.bitwise_xor.at(bits, first[doc] + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(rid, rid + k)), rows.column("id"), rows.column("tx"),
                    pa.array(n, pa.int64()), pa.array(s1), pa.array(s2),
                    _lists(size, bits.view(np.int64)), *columns],
                    names=schema.names)
                rid += k

    return docs.select(
        F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tx"),
        F.col(f"`{text}`").alias("text"),
    ).mapInArrow(sketch, schema)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def telling(buckets: DataFrame, leave: DataFrame) -> DataFrame:
    """(key, rid) of ``buckets`` (key, rid, side) without each document's largest ones.

    ``leave`` has (rid, side, leave): how many a document can do without in that band. All
    documents agree on the sizes, and a bucket left with one member is left altogether.
    """
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    largest = Window.partitionBy("rid", "side").orderBy(F.desc("members"), "key")  # one document's words
    kept = buckets.join(sizes, "key").join(leave, ["rid", "side"]).withColumn(
        "place", F.row_number().over(largest)).where(F.col("place") > F.col("leave")).select("key", "rid", "side")
    return meetings(kept).select("key", "rid")


def meetings(keys: DataFrame) -> DataFrame:
    """(key, rid, side) of the buckets with two members or more.

    Rows arrive sorted by key and member; a bucket is streamed, only its first row is kept.
    """
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, alone = None, None, False  # the open bucket; alone: one row so far, not given out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rid, side = (batch.column(c).to_numpy() for c in ("key", "rid", "side"))
            follows = np.zeros(len(key), bool)
            follows[1:] = key[1:] == key[:-1]
            follows[0] = last is not None and key[0] == last
            out = follows.copy()
            out[:-1] |= follows[1:]
            k, r, s = key[out], rid[out], side[out]
            if follows[0] and alone:
                k, r, s = np.append(k, last), np.append(r, first[0]), np.append(s, np.int32(first[1]))
            last, first, alone = int(key[-1]), (int(rid[-1]), int(side[-1])), not follows[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k), pa.array(r), pa.array(s.astype(np.int32))], names=["key", "rid", "side"])

    return keys.repartition("key").sortWithinPartitions("key", "rid").mapInArrow(
        meet, "key long, rid long, side int")


def with_texts(
    members: DataFrame, table: DataFrame, docs: DataFrame, id_column: str, text: str
) -> DataFrame:
    """``members`` (rid, ...) with the texts of their rows; only texts they name travel."""
    named = written(members.join(
        table.select("rid", F.col("id").alias("i"), F.col("tx").alias("t")), "rid"))
    names = named.select(F.col("i").alias("ni"), F.col("t").alias("nt")).distinct()
    if named.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tx"),
        F.col(f"`{text}`").alias("text"))
    here = rows.join(names, rows.id.eqNullSafe(F.col("ni")) & (rows.tx == F.col("nt")), "left_semi")
    here = here.dropDuplicates(["id", "tx"])
    return named.join(here, F.col("i").eqNullSafe(here.id) & (F.col("t") == here.tx)).drop(
        "i", "t", "id", "tx")


def dealt(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``salt``, which cuts the partners of one ``a`` into bounded parts."""
    heavy = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PARTNERS).select(
        "a", F.ceil(F.col("n") / PARTNERS).alias("parts")))
    number = heavy.count()
    if not number:
        return pairs.withColumn("salt", F.lit(0).cast("long"))
    if number <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    return pairs.join(heavy, "a", "left").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1).cast("long"))).alias("salt"))


def verified(
    pairs: DataFrame, table: DataFrame, docs: DataFrame, bands: Bands, width: int,
    id_column: str, text: str,
) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose shingle sets are similar enough, by counting.

    Texts come from the documents once, go to the task of their ``a`` and salt, and are
    compared with it one after another.
    """
    pairs = dealt(pairs)
    members = pairs.select("a", "salt", F.col("b").alias("rid")).union(
        pairs.select("a", "salt", F.col("a").alias("rid")).distinct())
    sent = with_texts(members, table, docs, id_column, text)
    num, den = bands.num, bands.den

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, base = None, np.empty(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for chunk, raw, offsets in row_chunks(batch, "text", CHUNK):
                doc, hashes = shingles(raw, offsets, width)
                bounds = np.searchsorted(doc, np.arange(chunk.num_rows + 1))
                for i, (a, b) in enumerate(zip(
                        chunk.column("a").to_pylist(), chunk.column("rid").to_pylist())):
                    own = hashes[bounds[i]: bounds[i + 1]]
                    if a == b:
                        hub, base = a, own.copy()
                        continue
                    most = (den - num) * (len(own) + len(base)) // (den + num)
                    if abs(len(own) - len(base)) > most or hub != a:
                        continue
                    both = len(np.intersect1d(own, base, assume_unique=True))
                    if den * both >= num * (len(own) + len(base) - both):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    own_first = F.when(F.col("a") == F.col("rid"), 0).otherwise(1)
    return sent.repartition("a", "salt").sortWithinPartitions("a", "salt", own_first, "rid").mapInArrow(
        compare, "a long, b long").distinct()


def within_bound(pairs: DataFrame, table: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose sketches are no further apart than linked sets may be."""
    own = lambda c: table.select(
        F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    short = F.least(F.size("s_a"), F.size("s_b"))
    fold = lambda s: F.when(F.size(s) == short, F.col(s)).otherwise(F.transform(
        F.sequence(F.lit(1), short), lambda i: F.aggregate(
            F.sequence(i, F.size(s), short), F.lit(0).cast("long"), lambda t, j: t.bitwiseXOR(F.element_at(s, j)))))
    apart = F.aggregate(
        F.zip_with(fold("s_a"), fold("s_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = (bands.den - bands.num) * (F.col("n_a") + F.col("n_b")) / (bands.den + bands.num)
    return pairs.join(own("a"), "a").join(own("b"), "b").where(apart <= F.floor(most)).select("a", "b")


def label_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): mixed buckets in bounded blocks, and the blocks to be compared.

    ``rows`` is (key, rid, label). A label with many members in a bucket has blocks of its
    own, ``own`` being the label; labels with few share blocks, ``own`` being -1. Members
    are (key, own, block, rid, label); pairs are (pair, like, key, own, block, side, alone),
    two rows a pair or one where a shared block meets itself. Blocks of one label are not
    paired with each other. ``like`` is the same for blocks of the same numbers in buckets
    with one smallest member: such buckets mostly hold the same documents.
    """
    many = F.col("c") > BLOCK // 4
    counts = written(rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")))
    few = counts.groupBy("key").agg(F.sum(F.when(~many, F.col("c")).otherwise(0)).alias("few"))
    labels = counts.join(few, "key").select(
        "key", "label", F.when(many, F.col("label")).otherwise(F.lit(-1)).alias("own"),
        F.ceil(F.when(many, F.col("c")).otherwise(F.col("few")) / BLOCK).alias("parts"))
    labels = written(labels)
    by = F.when(F.col("own") < 0, F.col("label")).otherwise(F.col("rid"))
    members = rows.join(labels, ["key", "label"]).select(
        "key", "own", F.pmod(F.xxhash64(by), F.col("parts")).alias("block"), "rid", "label")
    blocks = labels.select("key", "own", "parts").distinct().select(
        "key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"))
    place = lambda t: F.struct(f"{t}.own", f"{t}.block")
    met = blocks.alias("p").join(blocks.alias("q"), (F.col("p.key") == F.col("q.key")) & (
        place("p") <= place("q")) & ((F.col("p.own") < 0) | (F.col("p.own") != F.col("q.own"))))
    least = rows.groupBy("key").agg(F.min("rid").alias("least"))
    met = written(met.select(
        F.monotonically_increasing_id().alias("pair"), F.col("p.key").alias("key"),
        place("p").alias("p"), place("q").alias("q")).join(least, "key").withColumn(
            "like", F.xxhash64("least", "p", "q")).drop("least"))
    alone = (F.col("p") == F.col("q")).alias("alone")
    side = lambda t, n: met.select(
        "pair", "like", "key", F.col(f"{t}.own"), F.col(f"{t}.block"), F.lit(n).alias("side"), alone)
    return members, side("p", 0).union(side("q", 1).where("not alone"))


def folded_sketches(lists: pa.ListArray) -> np.ndarray:
    """Sketches as rows of words, all folded to the length of the shortest."""
    values = lists.flatten().to_numpy().view(np.uint64)
    size = np.diff(lists.offsets.to_numpy())
    first = np.cumsum(size) - size
    short = int(size.min())
    out = np.empty((len(size), short), np.uint64)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        whole = values[first[rows, None] + np.arange(length)]
        out[rows] = np.bitwise_xor.reduce(whole.reshape(len(rows), length // short, short), axis=1)
    return out


def nearest_pairs(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the nearest of the pairs (x, y) for each two labels."""
    one, two = np.minimum(left, right), np.maximum(left, right)
    order = np.lexsort((y, x, apart, two, one))
    one, two = one[order], two[order]
    return order[np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))] if len(order) else order


def close_sketches(rows: DataFrame, table: DataFrame, bands: Bands, nearest: bool = False) -> DataFrame:
    """(a, b): members of one bucket with different labels and sketches near enough to be linked.

    ``rows`` is (key, rid, label). A task compares two blocks of a bucket, or a shared block
    with itself; only pairs within the bound are given out, or the ``nearest`` of each two
    labels among 64 members and a block.
    """
    num, den = bands.num, bands.den

    def near(one: tuple, two: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        (rid, label, size, bits), (rid2, label2, size2, bits2) = one, two  # each sorted by label
        for a in range(0, len(rid), 64):
            z = min(a + 64, len(rid))
            low = np.searchsorted(label2, label[a], "left")
            high = np.searchsorted(label2, label[z - 1], "right")
            # columns of other labels: in one block beyond the row's, else beside them
            whole = label[a] == label[z - 1]
            column = np.arange(high if whole else low, len(rid2)) if same else (
                np.r_[0: low, high: len(rid2)] if whole else np.arange(len(rid2)))
            if not len(column):
                continue
            other = bits2[column]
            apart = np.zeros((z - a, len(column)), np.uint16 if bits.shape[1] < 1000 else np.uint32)
            for w in range(bits.shape[1]):
                apart += np.bitwise_count(bits[a: z, w, None] ^ other[None, :, w])
            most = (den - num) * (size[a: z, None] + size2[None, column]) // (den + num)
            left, right = label[a: z, None], label2[None, column]
            x, y = np.nonzero((apart <= most) & (left < right if same else left != right))
            if nearest:
                some = nearest_pairs(x, y, label[a + x], label2[column[y]], apart[x, y])
                x, y = x[some], y[some]
            x, y = rid[a + x], rid2[column[y]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        like, given = None, set()  # pairs given out for the blocks that are alike

        def both():
            nonlocal like
            whole = pa.Table.from_batches(held).combine_chunks()
            if like != (like := whole["like"][0].as_py()):
                given.clear()
            rid, label, size, side = (whole[c].to_numpy() for c in ("rid", "label", "n", "side"))
            lists = whole["sketch"].combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            bits = folded_sketches(lists)
            n = int(np.searchsorted(side, 1))
            one, two = (tuple(c[part] for c in (rid, label, size, bits)) for part in (
                slice(0, n), slice(n, None)))
            alone = whole["alone"][0].as_py()
            for found in near(one, one if alone else two, alone):
                pairs = set(zip(found.column("a").to_pylist(), found.column("b").to_pylist())) - given
                given.update(pairs)
                if pairs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])

        for batch in batches:
            key = batch.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and a < len(key) and held[-1].column("pair")[-1].as_py() != key[a]:
                    yield from both()
                    held.clear()
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from both()

    members, sides = label_blocks(rows)
    sent = members.join(sides, ["key", "own", "block"]).select(
        "pair", "like", "side", "alone", "rid", "label").join(table.select("rid", "n", "sketch"), "rid")
    return sent.repartition("like").sortWithinPartitions("like", "pair", "side", "label").mapInArrow(
        compare, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node it hangs together with.

    Alternates large and small stars until every node points at the smallest one.
    """
    def rounds(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        return small.select("b", "m").union(small.select(F.col("a").alias("b"), "m")).where(
            F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def settled(e: DataFrame) -> bool:
        """Whether every node points at one node that points nowhere."""
        twice = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        chained = e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
        return not twice.union(chained).limit(1).count()

    current = written(edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not settled(current):
        current = written(rounds(current))
    tops = current.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(tops).distinct()


def relabel(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after more edges: components of labels, put on the nodes."""
    if labels is None:
        return written(connected(edges))
    lookup = labels.select(F.col("node").alias("n"), "label")
    name = lambda e, c: e.join(lookup.withColumnRenamed("label", f"l_{c}"), F.col(c) == F.col("n"), "left").drop("n")
    named = name(name(edges, "a"), "b")
    joint = written(connected(named.select(
        F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")))).withColumnRenamed("label", "top")
    old = labels.join(joint.withColumnRenamed("node", "label"), "label", "left").select(
        "node", F.coalesce("top", "label").alias("label"))
    fresh = joint.join(labels, "node", "left_anti").select("node", F.col("top").alias("label"))
    return written(old.union(fresh))


def components(
    docs: DataFrame, num: int = 90, den: int = 100, width: int = 3,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(rid, id, tx, n_shingles, component_id, first) of each row.

    A link needs den * both >= num * either; ``first`` marks one row of each component.
    """
    bands = Bands(num, den)
    table = written(sketch_table(docs, bands, width, id_column, text))
    sets = table.where("n > 0")
    classes = sets.groupBy("s1", "s2", "n").agg(F.min("rid").alias("rep"))
    reps = classes.select(F.col("rep").alias("rid"))
    chosen = sets.join(reps, "rid", "left_semi")
    keys = chosen.select("rid", F.explode("keys").alias("key"), F.lit(0).alias("side")).unionByName(
        chosen.select("rid", F.explode("above").alias("key"), F.lit(1).alias("side")))
    leave = sets.select("rid", F.lit(0).alias("side"), "leave").unionByName(
        sets.select("rid", F.lit(1).alias("side"), F.col("leave_above").alias("leave")))
    buckets = written(telling(written(meetings(keys)), leave))

    # the member that meets most others is the likeliest centre of a group of near copies
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    met = buckets.join(sizes, "key").groupBy("rid").agg(F.sum("members").alias("met"))
    hubs = buckets.join(met, "rid").groupBy("key").agg(F.max(F.struct("met", "rid")).alias("hub"))
    proposed = written(buckets.join(hubs, "key").select(
        F.col("hub.rid").alias("a"), F.col("rid").alias("b")).where("a <> b").distinct())
    near = written(within_bound(proposed, table, bands))
    edges = written(verified(near, table, docs, bands, width, id_column, text))
    labels = relabel(None, edges)

    def mixed_rows() -> DataFrame:
        """Buckets whose members have different labels."""
        marked = buckets.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select(
            "key", "rid", F.coalesce("label", "rid").alias("label"))
        mixed_keys = marked.groupBy("key").agg(
            F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("members"),
        ).where("x <> y").select("key", "members")
        return written(marked.join(mixed_keys, "key"))

    tried = proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_rows = mixed_rows()
    while open_rows.where(F.col("members") > SMALL).limit(1).count():
        large = open_rows.where(F.col("members") > SMALL).select("key", "rid", "label")
        best = written(close_sketches(large, table, bands, nearest=True).distinct().join(tried, ["a", "b"], "left_anti"))
        if not best.limit(1).count():
            break
        more = written(verified(best, table, docs, bands, width, id_column, text))
        tried = tried.union(best)
        if not more.limit(1).count():
            break
        labels = relabel(labels, more)
        open_rows = mixed_rows()
    # what is left: untried pairs across labels
    small, large = open_rows.where(F.col("members") <= SMALL), open_rows.where(F.col("members") > SMALL)
    one, two = small.alias("p"), small.alias("q")
    across = one.join(two, (F.col("p.key") == F.col("q.key")) & (F.col("p.rid") < F.col("q.rid"))
                      & (F.col("p.label") != F.col("q.label"))).select(
        F.col("p.rid").alias("a"), F.col("q.rid").alias("b"))
    across = within_bound(across.distinct(), table, bands)
    if large.limit(1).count():
        across = across.union(close_sketches(large.select("key", "rid", "label"), table, bands))
    across = written(across.distinct().join(tried, ["a", "b"], "left_anti"))
    if across.limit(1).count():
        more = written(verified(across, table, docs, bands, width, id_column, text))
        if more.limit(1).count():
            labels = relabel(labels, more)

    own = table.select("rid", "id", "tx", F.col("n").alias("n_shingles"), "s1", "s2")
    named = own.join(classes.withColumnRenamed("n", "n_shingles"), ["s1", "s2", "n_shingles"], "left").join(
        labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        "rid", "id", "tx", "n_shingles", F.coalesce("label", "rep", "rid").alias("label"))
    # the first row of a component: smallest identifier, null identifiers last
    least = named.groupBy("label").agg(F.min(F.struct(
        F.col("id").isNull().alias("none"), "id", "rid")).alias("first"))
    return named.join(least, "label").select(
        "rid", "id", "tx", "n_shingles", F.col("first.id").alias("component_id"),
        (F.col("rid") == F.col("first.rid")).alias("first"))


def one_of_each(
    docs: DataFrame, num: int = 90, den: int = 100, width: int = 3, id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The first document of each component; same columns as ``docs``.

    Documents without words all stay, but for rows equal in identifier and text.
    """
    first = components(docs, num, den, width, id_column, text).where("first")
    first = written(first.select(F.col("id").alias("i"), F.col("tx").alias("t")).distinct())
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    key, tx = F.col(f"`{id_column}`"), F.xxhash64(F.col(f"`{text}`"))
    kept = docs.join(first, key.eqNullSafe(F.col("i")) & (tx == F.col("t")), "left_semi")
    return kept.dropDuplicates([id_column, text])
