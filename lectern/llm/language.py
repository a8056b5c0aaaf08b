"""Language identification by a byte convolutional network, trained here in numpy.

Texts are read as UTF-8 bytes in windows of a fixed length, cut one behind the other over
the whole text. A window's bytes get embeddings; filters of several widths slide over
them, each keeps its largest answer, and a softmax over these gives the window's language.
A text's language is the one with the largest mean of its windows' log probabilities,
weighted by their bytes; the score is the softmax of these means.

Training takes at most ``sample`` labelled texts, chosen by a hash of their identifier and
text, and ``per_text`` windows of each; the network is a few thousand numbers, fitted with
Adam on the driver, and travels to the tasks, where only windows of one chunk are held.

Defined results: a null text, an empty one or one without a letter is ``und`` with score 0;
rows without a language are not learned from; without any labelled row every text is
``und``; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import sampled
from .textbytes import CHUNK, ranges, row_chunks, short_batches

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8  # of each width
EMBEDDING = 8
SAMPLE = 4_000  # labelled texts at most
PER_TEXT = 3  # windows of each at most
STEPS = 900
BATCH = 64
RATE = 0.01
NONE = "und"


class Network:
    """Embeddings, zero-padded filters of all widths in one matrix, and a softmax layer."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        k, wide = len(WIDTHS) * FILTERS, max(WIDTHS)
        self.languages = languages
        self.mask = np.zeros((wide, EMBEDDING, k), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[:width, :, i * FILTERS: (i + 1) * FILTERS] = 1
        self.p = {
            "embed": rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32),
            "filters": (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32),
            "bias": np.zeros(k, np.float32),
            "out": rng.normal(0, 0.2, (k, len(languages))).astype(np.float32),
            "shift": np.zeros(len(languages), np.float32),
        }

    def _pooled(self, windows: np.ndarray):
        wide = max(WIDTHS)
        embedded = self.p["embed"][windows]
        n, length = windows.shape
        spans = length - wide + 1
        view = np.lib.stride_tricks.sliding_window_view(embedded, wide, axis=1)  # n, spans, e, wide
        columns = np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(n * spans, wide * EMBEDDING)
        answers = (columns @ self.p["filters"].reshape(wide * EMBEDDING, -1)).reshape(n, spans, -1)
        best = answers.argmax(1)
        top = np.take_along_axis(answers, best[:, None], 1)[:, 0] + self.p["bias"]
        return columns.reshape(n, spans, -1), best, top

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(windows, languages); windows are bytes plus one, padded with zeros."""
        wide = max(WIDTHS)
        out = np.empty((len(windows), len(self.languages)), np.float32)
        flat = self.p["filters"].reshape(wide * EMBEDDING, -1)
        for a in range(0, len(windows), 128):
            embedded = self.p["embed"][windows[a: a + 128]]
            n, length, _ = embedded.shape
            view = np.lib.stride_tricks.as_strided(  # rows of ``wide`` embeddings, without copies
                embedded, (n, length - wide + 1, wide * EMBEDDING),
                (embedded.strides[0], embedded.strides[1], embedded.strides[2]))
            top = (view @ flat).max(1) + self.p["bias"]
            out[a: a + 128] = self._softmax(np.maximum(top, 0) @ self.p["out"] + self.p["shift"])
        return out

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, windows: np.ndarray, target: np.ndarray, steps: int = STEPS, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        wide = max(WIDTHS)
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), BATCH)
            x, y = windows[pick], target[pick]
            columns, best, top = self._pooled(x)
            active = np.maximum(top, 0)
            p = np.exp(self._softmax(active @ self.p["out"] + self.p["shift"]))
            p[np.arange(BATCH), y] -= 1
            p /= BATCH
            d_top = (p @ self.p["out"].T) * (top > 0)
            rows = columns[np.arange(BATCH)[:, None], best]  # batch, filters, wide * embedding
            d_filters = np.einsum("nk,nkc->ck", d_top, rows).reshape(self.mask.shape) * self.mask
            d_columns = d_top[:, :, None] * self.p["filters"].reshape(-1, len(top[0])).T[None]
            d_embed = np.zeros_like(self.p["embed"])
            at = best[:, :, None] + np.arange(wide)[None, None]
            seen = np.take_along_axis(x[:, None, :], at, 2)
            np.add.at(d_embed, seen, d_columns.reshape(BATCH, -1, wide, EMBEDDING))
            grads = {"embed": d_embed, "filters": d_filters, "bias": d_top.sum(0),
                     "out": active.T @ p, "shift": p.sum(0)}
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                self.p[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def cut_windows(
    raw: np.ndarray, offsets: np.ndarray, length: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, windows, bytes in each): texts cut from end to end, the last one padded."""
    sizes = np.diff(offsets)
    count = -(-sizes // length)
    text = np.repeat(np.arange(len(sizes)), count)
    start = offsets[text] + ranges(np.zeros(len(sizes), np.int64), count) * length
    held = np.minimum(offsets[text + 1] - start, length)
    at = start[:, None] + np.arange(length)
    inside = np.arange(length) < held[:, None]
    windows = np.where(inside, raw[np.minimum(at, max(len(raw) - 1, 0))].astype(np.int16) + 1, 0)
    return text, windows, held


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter: ASCII letters by bytes, others by decoding."""
    ascii_letter = ((raw | 0x20) >= 97) & ((raw | 0x20) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = np.diff(total[offsets]) > 0
    for i in np.flatnonzero(~found).tolist():
        text = raw[offsets[i]: offsets[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(c.isalpha() for c in text)
    return found


def training_windows(
    labelled: DataFrame, sample: int, per_text: int, seed: int
) -> tuple[np.ndarray, list[str]]:
    """Bounded sample of (window, language) from (id, text, lang); windows at hashed places."""
    chosen = sampled(labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''"),
                     sample, "id", "text", seed=seed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
                text, windows, held = cut_windows(raw, offsets)
                order = np.random.default_rng(seed).permutation(len(text))
                order = order[np.argsort(text[order], kind="stable")]
                nth = np.arange(len(order)) - np.searchsorted(text[order], text[order])
                take = order[nth < per_text]
                yield pa.RecordBatch.from_arrays([
                    pa.array([w.astype(np.int16).tobytes() for w in windows[take]], pa.binary()),
                    rows.column("lang").take(pa.array(text[take]))], names=["window", "lang"])

    got = chosen.mapInArrow(cut, "window binary, lang string").toArrow()
    windows = np.frombuffer(b"".join(got["window"].to_pylist()), np.int16).reshape(-1, WINDOW)
    return windows, got["lang"].to_pylist()


def train(
    docs: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text",
    lang: str = "lang", sample: int = SAMPLE, per_text: int = PER_TEXT, steps: int = STEPS, seed: int = 5,
) -> Network:
    """A network fitted on the rows of ``docs`` for which ``learn`` holds."""
    short_batches(docs)
    labelled = docs.where(learn).select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"),
        F.col(f"`{lang}`").alias("lang"))
    windows, names = training_windows(labelled, sample, per_text, seed)
    languages = sorted(set(names))
    network = Network(languages, seed)
    if len(languages) > 1:
        number = {name: i for i, name in enumerate(languages)}
        network.fit(windows, np.array([number[n] for n in names]), steps, seed)
    return network


def identify(
    docs: DataFrame, network: Network, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, lang_pred, score) of every row."""
    short_batches(docs)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_column].dataType),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = np.array([*network.languages, NONE], object)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
                k = rows.num_rows
                known = has_letter(raw, offsets) & (len(network.languages) > 0)
                best, score = np.full(k, len(network.languages)), np.zeros(k)
                if known.any():
                    doc, windows, held = cut_windows(raw, offsets)
                    logs = network.log_probabilities(windows).astype(np.float64)
                    total = np.zeros((k, logs.shape[1]))
                    np.add.at(total, doc, logs * held[:, None])
                    mean = total / np.maximum(np.diff(offsets), 1)[:, None]
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best[known] = p.argmax(1)[known]
                    score[known] = p.max(1)[known]
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                    names=schema.names)

    return docs.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")
    ).mapInArrow(predict, schema)
