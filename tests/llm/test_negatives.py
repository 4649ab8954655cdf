import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import negatives as N

SCHEMA = "vec_id bigint, embedding array<float>, label bigint"
RNG = random.Random(12)


def vec(d=8, scale=0.3):
    return [RNG.gauss(0, scale) for _ in range(d)]


ROWS = [(i, vec(), RNG.randrange(4)) for i in range(300)]
ROWS += [(i, list(ROWS[i % 50][1]), RNG.randrange(4)) for i in range(300, 340)]  # equal vectors: ties
ROWS += [(400, vec(5), 1), (401, [], 2), (402, None, 1), (403, vec(), None), (404, [1.0, None], 1), (405, [math.nan] * 8, 1), (406, [math.inf] + vec(7), 1), (None, vec(), 1)]
ROWS += [(500, vec(), 9), (600, vec(), 3), (600, vec(), 3)]


def label_of(i, label):
    return (label + 1) % 10 if i % 7 == 0 else label


def brute(rows):
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    fine = [(i, label_of(i, y), [math.floor(256 * single(x)) for x in v]) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, la, va) in enumerate(fine):
        if a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(va, v)), i, y == la) for j, (i, y, v) in enumerate(fine) if j != k]
        order = sorted(scored, key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in order if s[2]][:5]:
            near = [s for s in order if not s[2] and 80 * p <= 100 * s[0] <= 100 * p][:5]
            out += [(a, pid, r, n, p, s) for r, (s, n, _) in enumerate(near, 1)]
    return sorted(out)


def run(frame, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = frame(rows, SCHEMA)
    names = [c for c in table.columns if c not in ("label",)] + ["label"]
    got = N.hard_negatives(table.select(*names), F.col("id") % 100 == 0, label)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("anchor_bytes", [N.ANCHOR_BYTES, 200])
def test_equals_brute_force(frame, monkeypatch, anchor_bytes):
    monkeypatch.setattr(N, "ANCHOR_BYTES", anchor_bytes)
    monkeypatch.setattr(N, "ROWS_AT_ONCE", 37)
    monkeypatch.setattr(N, "ANCHORS_AT_ONCE", 3)
    want = brute(ROWS)
    assert run(frame, ROWS) == want and len(want) > 40


def test_large_components_use_wider_integers(frame):
    rows = [(i, [x * 1e6 for x in v], y) for i, v, y in ROWS[:220]]
    assert N.fields(8, -(10**9), 10**9)[1] == 0
    assert run(frame, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, None, 1)], [(100, [1.0], 1), (101, [1.0], 1)]])
def test_small_tables(frame, rows):
    assert run(frame, rows) == []


@pytest.mark.parametrize("low,high", [(-135, 120), (0, 0), (-1, 0), (-60_000, 70_000), (-(2**40), 2**41), (-3_000_000, 3_000_000)])
def test_packed_products_are_exact(low, high):
    rng = np.random.default_rng(3)
    for n, width in [(1, 1), (7, 64), (10, 3)]:
        rows, anchors = rng.integers(low, high + 1, (n, width)), rng.integers(low, high + 1, (4, width))
        rows[0], anchors[0] = high, high  # the largest sums
        rows[-1], anchors[-1] = low, low
        want = [[sum(int(x) * int(y) for x, y in zip(r, a)) for r in rows] for a in anchors]
        assert N.Packed(rows, low, high).products(anchors).tolist() == want
