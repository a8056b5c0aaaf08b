"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is one of ``grades`` ordered grades, 0 the lowest. One weight vector over hashed
text features and one ascending threshold between neighbouring grades give

    P(grade > k) = sigmoid(weights . features - threshold[k])

for every k: the expected grade is the sum of these, and the tail probability of a chosen
grade is one of them. Features are the shapes of words, the words and the repeats of a text,
hashed to buckets, counted, dampened by the logarithm and scaled to length one. Fitted in numpy on
at most ``sample`` rated texts chosen by a hash; every whole text is scored in tasks.

Defined results: null and empty texts have no features and are judged by the thresholds
alone; rows with a null identifier or rating are not learned from; of contradictory ratings
of one identifier the lowest counts; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import sampled, shape_features
from .textbytes import CHUNK, row_chunks, short_batches

BITS = 16
SAMPLE = 8_000
PASSES = 12
RATE = 0.5


def vectors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, value), one row per distinct bucket of a text, in order."""
    text, hashes = shape_features(raw, offsets)
    keys = (text << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    text, value = keys >> BITS, np.log1p(counts)
    norm = np.sqrt(np.bincount(text, value * value, len(offsets) - 1))
    return text, keys & ((1 << BITS) - 1), value / norm[text]


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, grades: int):
        self.grades = grades
        self.weights = np.zeros(1 << BITS)
        self.thresholds = np.arange(grades - 1, dtype=float) - (grades - 2) / 2

    def tails(self, text: np.ndarray, bucket: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """P(grade > k) of each text, a column for each k."""
        z = np.bincount(text, self.weights[bucket] * value, rows)[:, None] - self.thresholds
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], rating: np.ndarray, passes: int = PASSES,
            seed: int = 8) -> None:
        """Adaptive gradient steps on the likelihood of the observed grades."""
        rng = np.random.default_rng(seed)
        squares, t_squares = np.full(len(self.weights), 1e-2), np.full(self.grades - 1, 1.0)
        n = len(rows)
        for _ in range(passes):
            for batch in np.array_split(rng.permutation(n), max(1, n // 32)):
                if not len(batch):
                    continue
                bucket = np.concatenate([rows[i][0] for i in batch]).astype(np.int64)
                value = np.concatenate([rows[i][1] for i in batch])
                own = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                p = self.tails(own, bucket, value, len(batch))
                above = np.concatenate([np.ones((len(batch), 1)), p, np.zeros((len(batch), 1))], 1)
                at, y = np.arange(len(batch)), rating[batch]
                mass = np.maximum(above[at, y] - above[at, y + 1], 1e-9)
                slope = above * (1 - above)
                d_t = np.zeros_like(p)  # of the log likelihood by each threshold
                low, high = y > 0, y < self.grades - 1
                d_t[at[low], y[low] - 1] -= slope[at[low], y[low]] / mass[low]
                d_t[at[high], y[high]] += slope[at[high], y[high] + 1] / mass[high]
                d_z = np.clip(-d_t.sum(1), -1, 1)
                g = np.bincount(bucket, d_z[own] * value, len(self.weights)) / len(batch)
                squares += g * g
                self.weights += RATE * g / np.sqrt(squares)
                step = np.clip(d_t, -1, 1).mean(0)
                t_squares += step * step
                self.thresholds = np.maximum.accumulate(self.thresholds + 0.1 * step / np.sqrt(t_squares))


def train(
    docs: DataFrame, ratings: DataFrame, learn: Column, grades: int, id_column: str = "doc_id",
    text: str = "text", rating: str = "rating", sample: int = SAMPLE, seed: int = 8,
) -> Ordinal:
    """Fit on the rows for which ``learn`` holds; ``ratings`` has the identifier and a grade."""
    short_batches(docs)
    marks = ratings.where(F.col(rating).between(0, grades - 1) & F.col(f"`{id_column}`").isNotNull()).groupBy(
        F.col(f"`{id_column}`").alias("id")).agg(F.min(F.col(rating).cast("int")).alias("rating"))
    rows = docs.where(learn).select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    few = sampled(marks.join(rows.select("id").distinct(), "id", "left_semi"), sample, "id", seed=seed)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, offsets in row_chunks(batch, "text", CHUNK):
                doc, bucket, value = vectors(raw, offsets)
                bounds = np.searchsorted(doc, np.arange(chunk.num_rows + 1))
                cut = lambda x, kind: pa.array([
                    x[a:b].astype(kind).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [cut(bucket, np.uint16), cut(value, np.float32), chunk.column("rating")],
                    names=["bucket", "value", "rating"])

    got = rows.join(F.broadcast(few), "id").select("text", "rating").mapInArrow(
        read, "bucket binary, value binary, rating int").toArrow()
    model = Ordinal(grades)
    model.fit([(np.frombuffer(b, np.uint16), np.frombuffer(v, np.float32)) for b, v in
               zip(got["bucket"].to_pylist(), got["value"].to_pylist())], got["rating"].to_numpy(), seed=seed)
    return model


def grade(
    docs: DataFrame, model: Ordinal, tail: int, cut: float = 0.5, id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, expected_grade, tail_probability, selected): ``tail`` is the grade to reach."""
    short_batches(docs)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_column].dataType),
        T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()),
        T.StructField("selected", T.BooleanType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, offsets in row_chunks(batch, "text", CHUNK):
                p = model.tails(*vectors(raw, offsets), chunk.num_rows)
                yield pa.RecordBatch.from_arrays([
                    chunk.column("id"), pa.array(p.sum(1)), pa.array(p[:, tail - 1]),
                    pa.array(p[:, tail - 1] >= cut)], names=schema.names)

    return docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    ).mapInArrow(apply, schema)
