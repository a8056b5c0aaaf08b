"""Toxicity by weak supervision.

1. *Voters.* Fixed lexicons and patterns vote by occurrence; further lexicons are induced
   from a bounded sample of labelled rows: words and beginnings of words whose texts are
   mostly labelled toxic, dealt over a few voters. A text's votes are one small bit mask.
2. *Label model.* The masks of all documents are counted (there are ``2 ** VOTERS`` of them
   at most, whatever the corpus). A generative model of masks given the hidden label is
   fitted to these counts by expectation maximisation: each voter's accuracy depends on
   the label and on one other voter, its parent in the tree of strongest correlations
   (conditional mutual information under the posterior). Known labels stay known, with a
   little room for error.
3. *Classifier.* The posterior label of each mask is the target of a linear classifier over
   hashed words, beginnings of words and votes, fitted on a bounded sample of texts. It
   scores every whole text.

Labels are taken from the rows that ``learn`` selects only. Defined results: null and empty
texts have no features and get the score of the classifier's constant; rows with null
identifiers have no label; of contradictory labels of one identifier the larger counts.
Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import distinct, sampled, word_features
from .textbytes import CHUNK, MIX, mixed, prefix_hash, row_chunks, short_batches, span_hash

LABELLED = 8_000  # labelled texts the lexicons are induced from, at most
TRAINING = 12_000  # texts the classifier is fitted on, at most
LEXICON = 512  # induced entries at most
INDUCED = 8  # voters they are dealt over
SUPPORT, PRECISION = 4, 0.7  # toxic texts of an entry, and their share, at least
BITS = 18
CHOSEN = 8_192  # features with a weight, at most
PASSES = 30

# --- fixed values: lexicons and patterns ------------------------------------------
INSULTS = ("idiot", "moron", "loser", "stupid", "clown", "fool", "imbecile", "dumb", "pathetic", "coward")
CONTEMPT = ("scum", "trash", "worthless", "disgusting", "filth", "vermin", "garbage", "parasite", "pig", "rat")
INSULTS_ELSEWHERE = (
    "dummkopf", "trottel", "vollidiot", "abschaum", "arschloch", "connard", "crétin", "imbécile",
    "débile", "ordure", "estúpido", "imbécil", "basura", "escoria", "gilipollas")
PATTERNS = (
    r"(?i)\byou(?:'re| are)? (?:all )?(?:an? )?(?:idiot|moron|loser|clown|fool|pig)s?\b",
    r"(?i)\b(?:shut up|get lost|go to hell|hate you|kill yourself)\b",
    r"(?i)\b[a-z]+[*@#$]{2,}[a-z]*\b",
)
# ----------------------------------------------------------------------------------
VOTERS = 3 + len(PATTERNS) + INDUCED


def _hashes_of(words: tuple[str, ...]) -> np.ndarray:
    out = []
    for word in words:
        raw = np.frombuffer(word.encode(), np.uint8)
        sums, p = prefix_hash(raw)
        with np.errstate(over="ignore"):
            out.append(mixed(span_hash(sums, p, np.array([0]), np.array([len(raw)]))
                             + np.uint64(len(raw)) * MIX)[0])
    return np.array(out, np.uint64)


class Lexicons:
    """Sorted feature hashes with the voter each belongs to."""

    def __init__(self, induced: list[int]):
        fixed = [_hashes_of(w) for w in (INSULTS, CONTEMPT, INSULTS_ELSEWHERE)]
        hashes = np.concatenate([*fixed, np.array(induced, np.uint64)])
        voter = np.concatenate([
            *[np.full(len(h), i) for i, h in enumerate(fixed)],
            3 + len(PATTERNS) + np.arange(len(induced)) % INDUCED]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.voter = hashes[order], voter[order]

    def votes(self, text: np.ndarray, hashes: np.ndarray, rows: int, column: pa.Array) -> np.ndarray:
        """Bit mask of the voters that speak up, for each text."""
        low = np.searchsorted(self.hashes, hashes, "left")
        high = np.searchsorted(self.hashes, hashes, "right")
        mask = np.zeros(rows, np.int64)
        hit = np.flatnonzero(high > low)
        for step in range(int((high - low).max(initial=0))):  # an entry may be in two lexicons
            some = hit[low[hit] + step < high[hit]]
            np.bitwise_or.at(mask, text[some], 1 << self.voter[low[some] + step])
        for i, pattern in enumerate(PATTERNS):
            found = np.asarray(pc.fill_null(pc.match_substring_regex(column, pattern), False))
            mask |= found.astype(np.int64) << (3 + i)
        return mask


def _chunks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for rows, raw, offsets in row_chunks(batch, "text", CHUNK):
            text, hashes = word_features(raw, offsets)
            yield rows, text, hashes


def induce(labelled: DataFrame) -> list[int]:
    """Feature hashes whose texts are mostly toxic, from (text, toxic), best first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text, hashes in _chunks(batches):
            doc, value = distinct(text, hashes)
            toxic = rows.column("toxic").to_numpy()[doc]
            features, back = np.unique(value, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(features.view(np.int64)),
                pa.array(np.bincount(back, toxic, len(features)).astype(np.int64)),
                pa.array(np.bincount(back, minlength=len(features)))], names=["feature", "hits", "texts"])

    counts = labelled.mapInArrow(count, "feature long, hits long, texts long").groupBy("feature").agg(
        F.sum("hits").alias("hits"), F.sum("texts").alias("texts"))
    good = counts.where((F.col("hits") >= SUPPORT) & (F.col("hits") >= PRECISION * F.col("texts")))
    best = good.orderBy(F.desc(F.col("hits") * F.col("hits") / F.col("texts")), "feature").limit(LEXICON)
    return [r["feature"] % (1 << 64) for r in best.collect()]


class LabelModel:
    """Tree-augmented label model over vote masks, fitted to counts of masks."""

    def __init__(self, masks: np.ndarray, known: np.ndarray, counts: np.ndarray):
        """``known`` is 0 or 1 where the label is known, else -1."""
        self.prior = 0.1
        if (known >= 0).any():
            self.prior = float(np.clip(counts[known == 1].sum() / counts[known >= 0].sum(), 0.01, 0.5))
        self.parent = np.full(VOTERS, -1)
        votes = (masks[:, None] >> np.arange(VOTERS)) & 1
        start = np.where(votes.any(1), 0.9, 0.1 * self.prior)
        posterior = self._clamped(start, known)
        for turn in range(PASSES):
            if turn == 3:
                self.parent = self._tree(votes, posterior, counts)
            self._accuracies(votes, posterior, counts)
            posterior = self._clamped(self._posterior(votes), known)

    @staticmethod
    def _clamped(p: np.ndarray, known: np.ndarray) -> np.ndarray:
        trust = 0.95  # of a given label against what the votes say
        return np.where(known < 0, p, trust * known + (1 - trust) * p)

    def _accuracies(self, votes: np.ndarray, posterior: np.ndarray, counts: np.ndarray) -> None:
        """P(voter speaks | label, parent's vote), smoothed; and the share of label 1."""
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        self.prior = float(weight[1].sum() / max(weight.sum(), 1))
        self.speak = np.empty((VOTERS, 2, 2))
        for v in range(VOTERS):
            up = votes[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                for u in (0, 1):
                    w = weight[y] * (up == u)
                    base = (weight[y] * votes[:, v]).sum() / max(weight[y].sum(), 1e-9)
                    self.speak[v, y, u] = ((w * votes[:, v]).sum() + 2 * base + 1e-3) / (w.sum() + 2 + 1e-2)

    def _tree(self, votes: np.ndarray, posterior: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Parents in the maximum spanning tree of conditional mutual information."""
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        total = max(weight.sum(), 1e-9)
        info = np.zeros((VOTERS, VOTERS))
        for y in (0, 1):
            mass = max(weight[y].sum(), 1e-9)
            both = (votes * weight[y][:, None]).T @ votes / mass
            one = np.diag(both)
            for a, b, joint in ((0, 0, 1 - one[:, None] - one[None] + both), (0, 1, one[None] - both),
                                (1, 0, one[:, None] - both), (1, 1, both)):
                pa_, pb = (one if a else 1 - one), (one if b else 1 - one)
                safe = np.maximum(joint, 1e-12)
                info += mass / total * safe * np.log(safe / np.maximum(np.outer(pa_, pb), 1e-12))
        parent, inside = np.full(VOTERS, -1), {0}
        while len(inside) < VOTERS:
            a, b = max(((i, j) for i in inside for j in range(VOTERS) if j not in inside),
                       key=lambda e: info[e])
            parent[b] = a
            inside.add(b)
        return parent

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.tile(np.log([1 - self.prior + 1e-9, self.prior + 1e-9]), (len(votes), 1))
        for v in range(VOTERS):
            up = votes[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                p = np.clip(self.speak[v, y, up], 1e-6, 1 - 1e-6)
                logs[:, y] += np.where(votes[:, v] == 1, np.log(p), np.log(1 - p))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        return self._posterior((np.asarray(masks)[:, None] >> np.arange(VOTERS)) & 1)


class Classifier:
    """Logistic regression over hashed features and votes."""

    def __init__(self, weights: np.ndarray, votes: np.ndarray, constant: float):
        self.weights, self.votes, self.constant = weights, votes, constant

    def score(self, text: np.ndarray, hashes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        some = self.weights[bucket] != 0  # most words have no weight
        doc, value = distinct(text[some], bucket[some])
        z = self.constant + np.bincount(doc, self.weights[value], len(mask))
        z += ((mask[:, None] >> np.arange(VOTERS)) & 1) @ self.votes
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_classifier(
    rows: list[np.ndarray], masks: np.ndarray, target: np.ndarray, seed: int = 3, passes: int = 8
) -> Classifier:
    """Adaptive gradient steps on soft targets; only the most telling buckets get weights."""
    n = len(rows)
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows).astype(np.int64) if n else np.empty(0, np.int64)
    doc = np.repeat(np.arange(n), sizes)
    hits = np.bincount(flat, target[doc], 1 << BITS)
    seen = np.bincount(flat, minlength=1 << BITS)
    share = target.mean() if n else 0.0
    lift = np.abs(hits - seen * share) / np.sqrt(seen * share * (1 - share) + 1)
    telling = np.where((lift > 3) & (hits >= SUPPORT), lift, 0)
    keep = np.zeros(1 << BITS, bool)
    keep[np.argsort(-telling, kind="stable")[:CHOSEN]] = True
    keep &= telling > 0
    inside = keep[flat]
    flat, doc = flat[inside], doc[inside]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    votes = ((masks[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    w, v, c = np.zeros(1 << BITS), np.zeros(VOTERS), float(np.log(max(share, 1e-3) / (1 - min(share, 0.999))))
    gw, gv = np.full(1 << BITS, 1.0), np.full(VOTERS, 1.0)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for batch in np.array_split(rng.permutation(n), max(1, n // 64)):
            if not len(batch):
                continue
            size = bounds[batch + 1] - bounds[batch]
            own = np.repeat(np.arange(len(batch)), size)
            at = flat[np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in batch])]
            z = c + np.bincount(own, w[at], len(batch)) + votes[batch] @ v
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target[batch]
            g = np.bincount(at, error[own], 1 << BITS) + 1e-4 * w
            touched = np.unique(at)
            gw[touched] += g[touched] ** 2
            w[touched] -= 0.3 * g[touched] / np.sqrt(gw[touched])
            dv = votes[batch].T @ error
            gv += dv**2
            v -= 0.3 * dv / np.sqrt(gv)
            c -= 0.02 * error.mean()
    w[np.abs(w) < 1e-3] = 0
    return Classifier(w.astype(np.float32), v, c)


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text",
    label: str = "toxic", labelled_rows: int = LABELLED, training_rows: int = TRAINING, seed: int = 3,
) -> tuple[Lexicons, LabelModel, Classifier]:
    """Fit on the rows for which ``learn`` (over the identifier column) holds."""
    short_batches(docs)
    marks = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_column}`").isNotNull()).groupBy(
        F.col(f"`{id_column}`").alias("id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("toxic"))
    rows = docs.where(learn).select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    few = sampled(marks.join(rows.select("id").distinct(), "id", "left_semi"), labelled_rows, "id", seed=seed)
    lexicons = Lexicons(induce(rows.join(F.broadcast(few), "id").select("text", "toxic")))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, text_, hashes in _chunks(batches):
            mask = lexicons.votes(text_, hashes, rows_.num_rows, rows_.column("text"))
            yield pa.RecordBatch.from_arrays([rows_.column("id"), pa.array(mask)], names=["id", "mask"])

    id_type = docs.schema[id_column].dataType.simpleString()
    masks = rows.mapInArrow(vote, f"id {id_type}, mask long").join(marks, "id", "left")
    counted = masks.groupBy("mask", F.coalesce("toxic", F.lit(-1)).alias("known")).count().collect()
    table = np.array([[r["mask"], r["known"], r["count"]] for r in counted], np.int64).reshape(-1, 3)
    model = LabelModel(table[:, 0], table[:, 1], table[:, 2].astype(float))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, text_, hashes in _chunks(batches):
            mask = lexicons.votes(text_, hashes, rows_.num_rows, rows_.column("text"))
            doc, bucket = distinct(text_, (hashes >> np.uint64(64 - BITS)).astype(np.int32))
            bounds = np.searchsorted(doc, np.arange(rows_.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                pa.array([bucket[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                pa.array(mask)], names=["buckets", "mask"])

    got = sampled(rows, training_rows, "id", "text", seed=seed + 1).select("text").mapInArrow(
        features, "buckets binary, mask long").toArrow()
    own = got["mask"].to_numpy()
    buckets = [np.frombuffer(b, np.int32) for b in got["buckets"].to_pylist()]
    return lexicons, model, fit_classifier(buckets, own, model.posterior(own), seed)


def score(
    docs: DataFrame, lexicons: Lexicons, classifier: Classifier, id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, score) of every row."""
    short_batches(docs)
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType),
                           T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text_, hashes in _chunks(batches):
            mask = lexicons.votes(text_, hashes, rows.num_rows, rows.column("text"))
            yield pa.RecordBatch.from_arrays([
                rows.column("id"), pa.array(classifier.score(text_, hashes, mask))], names=schema.names)

    return docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    ).mapInArrow(apply, schema)
