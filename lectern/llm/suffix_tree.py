"""Scoring texts by a probabilistic suffix tree over words.

Tokens are words with A-Z lower-cased, and one end after each text. The tree's states are
contexts of up to ``depth`` preceding words. A context is a candidate if it makes up at least
``least_share`` of all training tokens, so there are at most ``1 / least_share`` of them a
depth, whatever the corpus; the counts of what follows them stay distributed and grow with it.

1. *Counts.* Texts are dealt into chunks of bounded size and written once, packed. For every
   depth a pass counts (token, context) in each chunk; counts of all chunks meet by token and
   context and give the total, with the chunks that asked for it. Frequent pairs are the
   candidates of the next depth.
2. *Next-symbol distributions.* After context s, a token seen at least twice has
   ``(c(s, token) + (1 + c1(s)) * P(token | shorter s)) / (c(s) + 1)``: what was seen once
   only, c1 in all, is given back to the distribution after the context without its oldest
   word. The empty context has ``(c + 1) / (N + V + 1)``.
3. *Divergence test.* A candidate is retained where the mean of log P(token | s) - log
   P(token | shorter s) over its training tokens, the divergence of the two distributions, is
   at least ``divergence``, or where a longer retained context ends in it.
4. *Scoring.* Each chunk gets the totals it has asked for, and every position is scored in
   the longest retained context that precedes it. Nothing but the list of states is broadcast.

Defined results: a null or empty text is one end token; rows with equal identifiers are
scored each; a null identifier is a training row; without training rows every token has
probability one; an empty table gives no rows. A chunk has ``CHUNK_BYTES`` of text, or one
longer text, and is never cut inside one; words are told apart by 64 bits of hash. Other
columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import CHUNK, MIX, mixed, row_chunks, short_batches, text_buffers, word_codes, word_spans, written

DEPTH = 3  # words of the longest context
LEAST_SHARE = 1e-4  # of all training tokens that a context precedes, at least
DIVERGENCE = 0.02  # nats a token that a context tells more than the shorter one, at least
CHUNK_BYTES = 32 << 20  # text of a chunk
PIECE = 1 << 16  # text packed into one row
PENDING = 1 << 20  # counts of a chunk held apart before they are added up
END = np.uint64(0x2545F4914F6CDD1D)

COUNTED = "token long, ctx int, chunk long, n long"
TOTALS = "token long, ctx int, total long, chunks array<long>"


def _packed(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def packed_chunks(docs: DataFrame, learn: Column, id_column: str, text: str, chunk_bytes: int) -> DataFrame:
    """(chunk, blob): rows (id, text, train) packed, each chunk from one task."""
    short_batches(docs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            chunks, blobs = [], []
            for rows, raw, _ in row_chunks(batch, "text", PIECE):
                if held and held + len(raw) > chunk_bytes:
                    chunk, held = chunk + 1, 0
                held += len(raw)
                chunks.append(chunk)
                blobs.append(_packed(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "blob"])

    return docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.coalesce(learn, F.lit(False)).alias("train"),
    ).mapInArrow(pack, "chunk long, blob binary")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table]]:
    """(chunk, rows) of a batch of packed rows, half a megabyte of text or so together."""
    chunk, held, size = None, [], 0
    for number, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
        if held and (number != chunk or size >= CHUNK):
            yield chunk, pa.concat_tables(held)
            held, size = [], 0
        table = _unpacked(blob.as_buffer())
        chunk, size = number, size + table.nbytes
        held.append(table)
    if held:
        yield chunk, pa.concat_tables(held)


def tokens_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts one after another, bounds of the texts); each text ends with ``END``."""
    raw, offsets = text_buffers(texts)
    upper = (raw >= 65) & (raw <= 90)
    low = raw + (upper.astype(np.uint8) << np.uint8(5))
    starts, ends, first = word_spans(low, offsets)
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    out = np.full(len(starts) + n, END)
    if len(starts):
        out[np.arange(len(starts)) + text] = word_codes(low, starts, ends)
    return out, first + np.arange(n + 1)


def joint(token: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """One hash for a token and the context it follows."""
    with np.errstate(over="ignore"):
        return mixed(token ^ mixed((ctx.astype(np.uint64) + np.uint64(1)) * MIX))


class Tree:
    """Contexts by number (0 is the empty one): older part, newest word, suffix, depth, counts."""

    def __init__(self):
        self.depth = np.zeros(1, np.int64)
        self.suffix = np.zeros(1, np.int64)  # the context without its oldest word
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (sorted hashes, context numbers)
        self.total = self.once = np.zeros(1, np.int64)
        self.retained = np.ones(1, bool)
        self.words, self.word_numbers = np.empty(0, np.uint64), np.empty(0, np.int64)

    def grow(self, older: np.ndarray, token: np.ndarray) -> None:
        """Add contexts one word longer: ``token`` after the context ``older`` of the last depth."""
        first, deep = len(self.depth), len(self.levels) + 1
        keys = joint(token, older)
        order = np.argsort(keys)
        keys, older, token = keys[order], older[order], token[order]
        suffix = np.zeros(len(keys), np.int64) if deep == 1 else self.find(deep - 1, self.suffix[older], token)
        self.levels.append((keys, np.arange(first, first + len(keys))))
        if deep == 1:
            by_word = np.argsort(token)
            self.words, self.word_numbers = token[by_word], first + by_word
        self.depth = np.append(self.depth, np.full(len(keys), deep))
        self.suffix = np.append(self.suffix, suffix)

    def find(self, deep: int, older: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Number of the context of depth ``deep`` made of ``older`` and ``token``, or -1."""
        keys, numbers = self.levels[deep - 1]
        out = np.full(len(token), -1)
        some = np.flatnonzero(older >= 0)
        if len(keys) and len(some):
            wanted = joint(token[some], older[some])
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            out[some] = np.where(keys[at] == wanted, numbers[at], -1)
        return out

    def words_of_states(self, token: np.ndarray) -> np.ndarray:
        """Number of the context of each single word, or -1: as ``find``, by the words themselves."""
        out = np.full(len(token), -1)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, token), len(self.words) - 1)
            hit = self.words[at] == token
            out[hit] = self.word_numbers[at[hit]]
        return out

    def states(self, token: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """For each depth: the context of that many words before each token, or -1."""
        opens = np.zeros(len(token), bool)
        opens[bounds[:-1]] = True
        ending = np.zeros(len(token), np.int64)  # the context that ends with each token
        for deep in range(1, len(self.levels) + 1):
            if deep == 1:
                ending = self.words_of_states(token)
            else:
                before = np.append(-1, ending[:-1])
                before[opens] = -1
                ending = self.find(deep, before, token)
            state = np.append(-1, ending[:-1])
            state[opens] = -1
            yield state

    def step(self, ctx: np.ndarray, count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probability after ``ctx``, from the count there and the probability after its suffix."""
        return (count + (1.0 + self.once[ctx]) * shorter) / (self.total[ctx] + 1.0)


def counted(packed: DataFrame, tree: Tree, deep: int) -> DataFrame:
    """(token, ctx, chunk, n) for contexts of one depth; n counts training rows, 0 included."""
    def add(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        token, ctx, n = (np.concatenate(c) for c in zip(*parts))
        key = joint(token, ctx) if deep else token
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        one = order[first]
        return token[one], ctx[one], np.add.reduceat(n[order], first) if len(first) else n

    def out(parts: list, chunk: int) -> Iterator[pa.RecordBatch]:
        token, ctx, n = add(parts)
        for a in range(0, len(token), 50_000):
            z = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([
                pa.array(token[z].view(np.int64)), pa.array(ctx[z].astype(np.int32)),
                pa.array(np.full(len(token[z]), chunk)), pa.array(n[z])], names=["token", "ctx", "chunk", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, chunk = [], 0, None
        for batch in batches:
            for number, rows in _texts(batch):
                if parts and number != chunk:
                    yield from out(parts, chunk)
                    parts, held = [], 0
                chunk = number
                token, bounds = tokens_of(rows["text"])
                train = np.repeat(rows["train"].to_numpy(), np.diff(bounds)).astype(np.int64)
                if deep:
                    *_, ctx = tree.states(token, bounds)
                    some = ctx >= 0
                    token, ctx, train = token[some], ctx[some], train[some]
                else:
                    ctx = np.zeros(len(token), np.int64)
                if len(token):
                    parts.append(add([(token, ctx, train)]))
                    held += len(parts[-1][0])
                if held > PENDING:
                    parts = [add(parts)]
                    held = 0
        if parts:
            yield from out(parts, chunk)

    return packed.mapInArrow(count, COUNTED)


def totals(rows: DataFrame, least: int) -> DataFrame:
    """(token, ctx, total, chunks) of (token, context) counted at least ``least`` times.

    Rows stream by token and context; what a task holds is one pair's row per chunk. With
    ``least`` 2, the pairs seen once are summed: a row with null chunks for each context.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "ctx", "chunk", "n")
        held, single = None, {}
        empty = pa.RecordBatch.from_arrays([
            pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())],
            names=names)
        for batch in _with_last(batches, empty):
            last = batch is empty
            cols = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            token, ctx, chunk, n = cols
            if not len(token):
                continue
            head = np.ones(len(token), bool)
            head[1:] = (token[1:] != token[:-1]) | (ctx[1:] != ctx[:-1])
            first = np.flatnonzero(head)
            done = len(token) if last else first[-1]
            held = None if last else [c[done:] for c in cols]
            if not last:
                first = first[:-1]
            if not len(first):
                continue
            total = np.add.reduceat(n[:done], first)
            if least > 1:
                ones = ctx[first][total == 1]
                for c, k in zip(*np.unique(ones, return_counts=True)):
                    single[int(c)] = single.get(int(c), 0) + int(k)
            fine = total >= least
            size = np.diff(np.append(first, done))
            inside = np.repeat(fine, size)
            new = np.ones(done, bool)  # a chunk that two tasks counted is listed once
            new[1:] = head[1:done] | (chunk[1:done] != chunk[: done - 1])
            lengths = np.add.reduceat(new.astype(np.int64), first)[fine]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(chunk[:done][inside & new]))
            yield pa.RecordBatch.from_arrays([
                pa.array(token[first][fine]), pa.array(ctx[first][fine]), pa.array(total[fine]), lists],
                names=["token", "ctx", "total", "chunks"])
        if single:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(len(single), np.int64)), pa.array(list(single), pa.int32()),
                pa.array(list(single.values()), pa.int64()),
                pa.array([None] * len(single), pa.list_(pa.int64()))], names=["token", "ctx", "total", "chunks"])

    return rows.repartition("token", "ctx").sortWithinPartitions("token", "ctx", "chunk").mapInArrow(add, TOTALS)


def _with_last(batches: Iterator[pa.RecordBatch], last: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from batches
    yield last


def gains(levels: list[DataFrame], tree: Tree, known: int, words: int) -> np.ndarray:
    """What each candidate's distribution adds to the log probability of the training tokens.

    All contexts of a token meet in one task, shorter ones first: at most as many rows as
    there are states.
    """
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros(len(tree.depth))
        held = None

        def whole_tokens(token, ctx, total):
            group = np.cumsum(np.append(True, token[1:] != token[:-1])) - 1
            place = group * len(tree.depth) + ctx  # ascending
            root = np.zeros(group[-1] + 1)
            root[group[ctx == 0]] = total[ctx == 0]

            def after(number, state):
                """Probability of tokens (by group) after a state, whether seen there or not."""
                deep = np.flatnonzero(tree.depth[state] > 0)
                value = (root[number] + 1.0) / (known + words + 1.0)
                if len(deep):
                    g, s = number[deep], state[deep]
                    wanted = g * len(tree.depth) + s
                    at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
                    seen = np.where(place[at] == wanted, total[at], 0)
                    value[deep] = tree.step(s, seen, after(g, tree.suffix[s]))
                return value

            rows = np.flatnonzero(ctx > 0)
            if len(rows):
                longer = after(group[rows], ctx[rows])
                shorter = after(group[rows], tree.suffix[ctx[rows]])
                np.add.at(gain, ctx[rows], total[rows] * (np.log(longer) - np.log(shorter)))

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("token", "ctx", "total")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                whole_tokens(*[c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None:
            whole_tokens(*held)
        some = np.flatnonzero(gain)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(gain[some])], names=["ctx", "gain"])

    rows = levels[0].select("token", "ctx", "total")
    for level in levels[1:]:
        rows = rows.unionByName(level.where("chunks IS NOT NULL").select("token", "ctx", "total"))
    got = rows.repartition("token").sortWithinPartitions("token", "ctx").mapInArrow(
        test, "ctx int, gain double").groupBy("ctx").agg(F.sum("gain").alias("gain")).collect()
    out = np.zeros(len(tree.depth))
    for r in got:
        out[r["ctx"]] = r["gain"]
    return out


def learn_tree(
    packed: DataFrame, depth: int = DEPTH, least_share: float = LEAST_SHARE, divergence: float = DIVERGENCE
) -> tuple[Tree, list[DataFrame], int, int]:
    """(tree, totals by depth, number of training tokens, number of distinct ones)."""
    tree = Tree()
    levels = [written(totals(counted(packed, tree, 0), 1))]
    known, words = levels[0].agg(F.coalesce(F.sum("total"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(2, int(np.ceil(least_share * known)))
    for deep in range(1, depth + 1):
        # at most 1 / least_share rows: each stands for that share of the training tokens
        new = levels[-1].where((F.col("total") >= least) & F.col("chunks").isNotNull() & (
            F.col("token") != F.lit(int(END.view(np.int64))))).select("ctx", "token").collect()
        if not new:
            break
        tree.grow(np.array([r["ctx"] for r in new], np.int64),
                  np.array([r["token"] for r in new], np.int64).view(np.uint64))
        levels.append(written(totals(counted(packed, tree, deep), 2)))
    size = len(tree.depth)
    tree.total, tree.once = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for level in levels[1:]:
        for r in level.groupBy("ctx").agg(
                F.sum("total").alias("total"), F.sum(F.when(F.col("chunks").isNull(), F.col("total"))).alias("once")).collect():
            tree.total[r["ctx"]], tree.once[r["ctx"]] = r["total"], r["once"] or 0
    tree.retained = np.zeros(size, bool)
    if size > 1:
        gain = gains(levels, tree, known, words) + tree.once * np.log((1.0 + tree.once) / (tree.total + 1.0))
        tree.retained = (tree.total > 0) & (gain >= divergence * tree.total)
        for deep in range(len(tree.levels), 1, -1):  # a retained context keeps its suffix
            tree.retained[tree.suffix[tree.retained & (tree.depth == deep)]] = True
    tree.retained[0] = True
    return tree, levels, known, words


def answers(levels: list[DataFrame], tree: Tree) -> DataFrame:
    """(chunk, blob): the totals of retained contexts, packed for the chunks that asked for them."""
    retained = tree.retained

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            chunk, token, ctx, total = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((token, ctx, chunk))
            chunk, token, ctx, total = chunk[order], token[order], ctx[order], total[order]
            first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else []
            blobs = [_packed(pa.RecordBatch.from_arrays(
                [pa.array(c[a:z]) for c in (token, ctx, total)], names=["token", "ctx", "total"]))
                for a, z in zip(first, np.append(first[1:], len(chunk)))]
            return pa.RecordBatch.from_arrays(
                [pa.array(chunk[first] if len(chunk) else chunk), pa.array(blobs, pa.binary())], names=["chunk", "blob"])

        parts, held = [], 0
        for batch in batches:
            lists = batch.column("chunks")
            size = np.diff(lists.offsets.to_numpy())
            fine = retained[batch.column("ctx").to_numpy()]
            inside = np.repeat(fine, size)
            repeat = size * fine
            parts.append((lists.flatten().to_numpy()[inside],
                          *[np.repeat(batch.column(c).to_numpy(), repeat) for c in ("token", "ctx", "total")]))
            held += int(repeat.sum())
            if held > PENDING:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)

    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level.where("chunks IS NOT NULL"))
    return rows.mapInArrow(deal, "chunk long, blob binary")


def lm_scores(
    docs: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text", depth: int = DEPTH,
    least_share: float = LEAST_SHARE, divergence: float = DIVERGENCE, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``learn`` selects the rows that counts are taken from. ``base_score`` is the log10
    probability of the text by the empty context alone, ``score`` by the tree.
    """
    packed = written(packed_chunks(docs, learn, id_column, text, chunk_bytes))
    tree, levels, known, words = learn_tree(packed, depth, least_share, divergence)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, keys, values = None, [], None, None

        def look(token: np.ndarray, ctx: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(token), np.int64)
            wanted = joint(token, ctx)
            order = np.argsort(wanted)  # neighbours in the table are looked up one after another
            wanted = wanted[order]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            out = np.empty(len(token), np.int64)
            out[order] = np.where(keys[at] == wanted, values[at], 0)
            return out

        for batch in batches:
            # answers of a chunk come before its texts
            for kind, piece in _runs(batch):
                number = piece.column("chunk")[0].as_py()
                if number != chunk:
                    chunk, parts, keys, values = number, [], None, None
                if kind == 0:
                    for blob in piece.column("blob"):
                        t = _unpacked(blob.as_buffer())
                        parts.append((joint(t["token"].to_numpy().view(np.uint64), t["ctx"].to_numpy()),
                                      t["total"].to_numpy()))
                    continue
                if keys is None:
                    keys = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
                    values = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
                    order = np.argsort(keys)
                    keys, values, parts = keys[order], values[order], []
                for _, rows in _texts(piece):
                    token, bounds = tokens_of(rows["text"])
                    count = look(token, np.zeros(len(token), np.int64))
                    base = (count + 1.0) / (known + words + 1.0)
                    p = base.copy()
                    for state in tree.states(token, bounds):
                        some = np.flatnonzero((state >= 0) & tree.retained[state])
                        p[some] = tree.step(state[some], look(token[some], state[some]), p[some])
                    n = np.diff(bounds)
                    of = np.repeat(np.arange(len(n)), n)
                    sums = [np.bincount(of, x, len(n)) for x in (np.log10(base), np.log10(p))]
                    ids = rows["id"].combine_chunks()
                    yield pa.RecordBatch.from_arrays([
                        pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids,
                        pa.array(n), pa.array(np.bincount(of, count > 0, len(n)).astype(np.int64)),
                        pa.array(np.full(len(n), known)), *map(pa.array, sums)], names=schema.names)

    asked = answers(levels, tree).withColumn("kind", F.lit(0))
    both = asked.unionByName(packed.withColumn("kind", F.lit(1)))
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(score, schema)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(kind, rows) of each run of rows of one chunk and kind."""
    chunk, kind = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
    if len(chunk):
        cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
            yield int(kind[a]), batch.slice(a, b - a)
