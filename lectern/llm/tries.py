"""Exact dedup with Patricia tries that own their texts.

Texts are equal when identical after lower-casing A-Z. A map-side trie collapses the
copies a task has seen, so that however many copies a text has, each task sends it a
few times at most. The partial owners are then partitioned by length and content hash,
and the task of a partition inserts the full byte strings into a compressed radix trie:
equal strings meet in one terminal node, which keeps the owner (the largest or smallest
identifier), its row and the number of copies. A trie is bounded in bytes; when full, it
spills its heaviest subtree (map side) or everything before the next length and hash
(owner side, where rows arrive sorted by them).

Defined results: null texts are empty texts and equal to each other; a null identifier
is smaller than any other and, where all are null, the group's owner is a row with null;
equal rows count as copies and exactly one of them stays; an empty table gives no rows;
other columns, whatever their names, travel with the owner's row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import short_batches, written

TRIE_BYTES = 48 << 20  # label bytes a task keeps in its trie
ROW_BYTES = 200  # what a terminal costs besides its label


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.owner = None  # [identifier, copies, row] where a text ends


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    most = min(len(a), len(b) - at)
    if a[:most] == b[at: at + most]:
        return most
    low, high = 0, most
    while low < high:  # halving keeps the comparison in C
        mid = (low + high + 1) // 2
        if a[:mid] == b[at: at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed radix trie over full byte strings with owners at its terminals."""

    def __init__(self, largest: bool):
        self.root, self.bytes, self.largest = Node(b""), 0, largest

    def add(self, key: bytes, identifier, copies: int, row) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.children[key[at]] = child
                self.bytes += len(child.label) + ROW_BYTES
                node, at = child, len(key)
                break
            same = _common(child.label, key, at)
            if same < len(child.label):  # split the edge
                upper = Node(child.label[:same])
                child.label = child.label[same:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.bytes += ROW_BYTES
                child = upper
            node, at = child, at + same
        if node.owner is None:
            node.owner = [identifier, copies, row]
        else:
            node.owner[1] += copies
            if self._better(identifier, node.owner[0]):
                node.owner[0], node.owner[2] = identifier, row

    def _better(self, new, old) -> bool:
        if new is None or old is None:
            return old is None and new is not None and self.largest
        return new > old if self.largest else new < old

    def _owners(self, top: Node) -> Iterator[list]:
        stack = [top]
        while stack:
            node = stack.pop()
            if node.owner is not None:
                yield node.owner
            stack.extend(node.children.values())

    def all(self) -> Iterator[list]:
        return self._owners(self.root)

    def spill(self) -> Iterator[list]:
        """Take out the heaviest subtree below the root and yield its owners."""
        def weight(top: Node) -> int:
            stack, total = [top], 0
            while stack:
                node = stack.pop()
                total += len(node.label) + ROW_BYTES
                stack.extend(node.children.values())
            return total

        weights = {first: weight(child) for first, child in self.root.children.items()}
        heaviest = max(weights, key=weights.get)
        self.bytes -= weights[heaviest]
        yield from self._owners(self.root.children.pop(heaviest))


def _emitter(schema: pa.Schema, size: int):
    """Collects rows and gives them out as Arrow batches of about ``size`` rows."""
    rows: list[tuple] = []

    def add(row: tuple) -> Iterator[pa.RecordBatch]:
        rows.append(row)
        if len(rows) >= size:
            yield from flush()

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
            rows.clear()

    return add, flush


def owners(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", largest: bool = True,
    keep: tuple[str, ...] = (), trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """One row per distinct text: (n_bytes, digest, owner, copies, row).

    ``digest`` is the sha256 of the lower-cased text, ``row`` a struct of the columns
    ``keep`` of the owner's row. Two passes over tries: per task, then per partition of
    length and content hash. Where the text is one of the kept columns it travels once,
    and the second pass takes the key from the row.
    """
    short_batches(docs)
    fields = {f.name: f for f in docs.schema.fields}
    row_type = T.StructType([T.StructField(f"c{i}", fields[c].dataType) for i, c in enumerate(keep)]
                            or [T.StructField("none", T.BooleanType())])
    id_type = fields[id_column].dataType
    narrow = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"),
        (F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]) if keep
         else F.struct(F.lit(None).cast("boolean").alias("none"))).alias("row"),
    )
    partial = T.StructType([
        T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.BinaryType()),
        T.StructField("key", T.BinaryType()), T.StructField("owner", id_type),
        T.StructField("copies", T.LongType()), T.StructField("row", row_type),
    ])
    final = T.StructType([f for f in partial.fields if f.name != "key"])
    inside = f"c{keep.index(text)}" if text in keep else None

    def key_of(raw: str | bytes | None) -> bytes:
        """The lower-cased bytes; bytes.lower changes A-Z only."""
        return (b"" if raw is None else raw.encode() if isinstance(raw, str) else raw).lower()

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        add, flush = _emitter(to_arrow_schema(partial), 512)
        trie = Trie(largest)
        out = lambda o: add((
            len(o[2][1]), o[2][0], o[2][1] if inside is None else None, o[0], o[1], o[2][2]))
        for batch in batches:
            texts = batch.column("text")
            for identifier, value, row in zip(
                    batch.column("id").to_pylist(), texts, batch.column("row").to_pylist()):
                key = key_of(value.as_buffer().to_pybytes() if value.is_valid else None)
                trie.add(key, identifier, 1, (hashlib.sha256(key).digest(), key, row))
                while trie.bytes > trie_bytes and trie.root.children:
                    for o in trie.spill():
                        yield from out(o)
        for o in trie.all():
            yield from out(o)
        yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        add, flush = _emitter(to_arrow_schema(final), 2048)
        trie, last = Trie(largest), None
        out = lambda o: add((o[2][0], o[2][1], o[0], o[1], o[2][2]))
        for batch in batches:
            columns = [batch.column(f.name) for f in partial.fields]
            for n, digest, key, owner, copies, row in zip(
                    columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(),
                    columns[3].to_pylist(), columns[4].to_pylist(), columns[5].to_pylist()):
                if inside is not None:
                    key = key_of(row[inside])
                if trie.bytes > trie_bytes and (n, digest) != last:
                    for o in trie.all():
                        yield from out(o)
                    trie = Trie(largest)
                trie.add(key, owner, copies, (n, digest, row))
                last = (n, digest)
        for o in trie.all():
            yield from out(o)
        yield from flush()

    return (
        narrow.mapInArrow(collapse, partial)
        .repartition("n_bytes", "digest")
        .sortWithinPartitions("n_bytes", "digest")
        .mapInArrow(settle, final)
    )


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, digest) of every row."""
    short_batches(docs)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_column].dataType),
        T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.BinaryType()),
    ])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes = [], []
            for value in batch.column("text"):
                key = (value.as_buffer().to_pybytes() if value.is_valid else b"").lower()
                sizes.append(len(key))
                hashes.append(hashlib.sha256(key).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary())],
                names=["id", "n_bytes", "digest"])

    return docs.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")
    ).mapInArrow(digests, schema)


def groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", largest: bool = True
) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    Of equal rows with the owner's identifier, one is kept: the first as they were read.
    """
    rows = written(fingerprints(docs, id_column, text).withColumn("row", F.monotonically_increasing_id()))
    own = owners(docs, id_column, text, largest).select("n_bytes", "digest", "owner", "copies")
    # copies of one row are added up before they meet
    first = rows.groupBy("n_bytes", "digest", "id").agg(F.min("row").alias("first"))
    text_of = (own.n_bytes == first.n_bytes) & (own.digest == first.digest)
    chosen = own.join(first, text_of & own.owner.eqNullSafe(first.id)).select(
        own.n_bytes, own.digest, "owner", "copies", "first")
    return rows.join(chosen, ["n_bytes", "digest"]).select(
        "id", F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"),
        (F.col("row") == F.col("first")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def survivors(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", largest: bool = True
) -> DataFrame:
    """The owner's whole row of each group of equal texts; same columns as ``docs``."""
    kept = owners(docs, id_column, text, largest, tuple(docs.columns))
    return kept.select(*[
        F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
