"""Greedy dedupe in rounds of blocks against the sequential scan."""

import random

import pytest

from lectern.operators.hashes import dedupe_hashes


def greedy(rows, distance):
    kept = []
    for i, h in rows:
        if all(((h ^ k) & (2**64 - 1)).bit_count() > distance for _, k in kept):
            kept.append((i, h))
    return [i for i, _ in kept]


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def frames(seed, n):
    """Clusters of near copies, exact copies, and a slowly drifting run."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(n // 12)]
    out, drift = [], rng.getrandbits(64)
    for i in range(n):
        kind = i % 3
        if kind == 0:
            drift ^= 1 << rng.randrange(64)
            h = drift
        else:
            h = rng.choice(centres)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                h ^= 1 << rng.randrange(64)
        out.append((i, signed(h)))
    return out


@pytest.mark.parametrize("block", [10_000, 40])
@pytest.mark.parametrize("distance", [0, 5])
def test_dedupe(spark, block, distance):
    data = {s: frames(s, 240 if s == 0 else 40) for s in range(3)}
    rows = [(s, i, h) for s, f in data.items() for i, h in f]
    df = spark.createDataFrame(rows, "source_id int, frame_idx int, h long").repartition(5)
    got = dedupe_hashes(df, distance, 64, block).collect()
    for s, f in data.items():
        assert sorted(r.frame_idx for r in got if r.source_id == s) == greedy(f, distance)


def test_a_long_drift_takes_one_round_a_block(spark, monkeypatch):
    """Each screen is near the one before; only the number of blocks counts."""
    from lectern.operators import hashes

    rng, h, data = random.Random(4), 0, []
    for i in range(300):
        h ^= 1 << rng.randrange(64)
        data.append((i, signed(h)))
    joins = []
    plain = hashes._near_kept
    monkeypatch.setattr(hashes, "_near_kept", lambda *a: joins.append(1) or plain(*a))
    df = spark.createDataFrame([(1, i, h) for i, h in data], "source_id int, frame_idx int, h long")
    got = dedupe_hashes(df, 5, 64, block=100).collect()
    first = {}
    for i, x in data:
        first.setdefault(x, i)
    assert len(joins) == (len(first) - 1) // 100
    assert sorted(r.frame_idx for r in got) == greedy(data, 5)


def test_no_frames(spark):
    assert dedupe_hashes(spark.createDataFrame([], "source_id int, frame_idx int, h long")).count() == 0
