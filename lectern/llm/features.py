"""Hashed text features for the linear models, computed on whole chunks in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import MIX, mixed, prefix_hash, span_hash, word_codes, word_spans

PREFIXES = (4, 5, 6, 7)  # bytes of a word's beginning that are features too

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def folded(raw: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented Latin letters of two bytes."""
    out = raw + (_UPPER[raw].astype(np.uint8) << np.uint8(5))
    if len(raw) > 1:
        accented = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        out[1:] += accented.astype(np.uint8) << np.uint8(5)
    return out


def letter_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of runs of letters and digits; texts never share a run."""
    masked = np.where(_WORD[raw], raw, np.uint8(0x20))
    starts, ends, first = word_spans(masked, offsets)
    return starts, ends, np.repeat(np.arange(len(first) - 1), np.diff(first))


def word_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word and of its beginnings, with repeats."""
    low = folded(raw)
    starts, ends, text = letter_spans(low, offsets)
    sums, p = prefix_hash(low)
    texts, hashes = [text], []
    with np.errstate(over="ignore"):
        hashes.append(mixed(span_hash(sums, p, starts, ends) + (ends - starts).astype(np.uint64) * MIX))
        for size in PREFIXES:
            long = ends - starts > size
            s = starts[long]
            hashes.append(mixed(span_hash(sums, p, s, s + size) + np.uint64(size + 1000) * MIX))
            texts.append(text[long])
    return np.concatenate(texts), np.concatenate(hashes)


def distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, sorted by text and value."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(97, 123), *range(128, 256)]] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def shape_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word's shape, of words that repeat their neighbour, and
    of each word itself, lower-cased; with repeats.

    A shape writes a for small letters, A for capitals, 0 for digits, keeps other bytes,
    and says each run once: ``Word###`` is ``Aa#``.
    """
    starts, ends, first = word_spans(raw, offsets)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kinds = _SHAPE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    short = kinds[keep]
    s, e = place[starts], place[ends]
    shape = mixed(word_codes(short, s, e) + np.uint64(1)) if len(starts) else np.empty(0, np.uint64)
    codes = word_codes(folded(raw), starts, ends)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
    token = np.full(int(again.sum()), 0x51ED270B9F0A3C71, np.uint64)
    return np.concatenate([text, text[again], text]), np.concatenate([shape, token, codes])


def sampled(rows: DataFrame, most: int, *key: Column | str, seed: int = 0) -> DataFrame:
    """At most ``most`` rows (and rows tied with the last), by a hash of ``key``.

    Only hashes are sorted; the rows themselves are filtered in place.
    """
    h = F.xxhash64(F.lit(seed), *key)
    last = rows.select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return rows.where(F.lit(False)) if last is None else rows.where(h <= last)


def held_out(id_column: str = "doc_id", of: int = 4) -> Column:
    """Rows that nothing is learned from: crc32 of the identifier as text, modulo ``of``, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_column}`").cast("string")), F.lit(of)) == 2, F.lit(False))
