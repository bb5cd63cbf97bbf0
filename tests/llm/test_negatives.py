"""Hard negatives against brute force, the bounds against the scores, and the query against its SQL."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tickflow.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, angles string, score bigint, `a.b` string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, c, 1, "x", 2, "dot") for i, e, c in rows], SCHEMA).repartition(parts)


def brute(rows, every):
    clean = set()
    for i, e, c in rows:
        if i is not None and c is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            clean.add((i, c, tuple(math.floor(256 * float(np.float32(x))) for x in e)))
    out = Counter()
    for i, c, a in clean:
        if i % every:
            continue
        scored = {(sum(x * y for x, y in zip(a, b)), k, d == c) for k, d, b in clean if (k, d, b) != (i, c, a)}
        best = sorted(((-s, k) for s, k, same in scored if same and k != i))[:5]
        for s, k in best:
            found = sorted((-n, j) for n, j, same in scored if not same and 50 * -s <= 100 * n <= 95 * -s)[:3]
            for r, (n, j) in enumerate(found):
                out[i, k, r + 1, j, -s, -n] += 1
    return out


def rows_of(seed, n=260, dim=6):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rnd.randrange(5)
        rows.append((i, [x + rnd.gauss(0, 0.5) for x in centres[c]], rnd.choice([c, c, rnd.randrange(5)])))
    same = [0.5, -0.25, 1.0, 0.0, 0.75, 0.5][:dim]
    rows += [(1000 + i, same, i % 3) for i in range(90)]  # many copies of one vector: ties everywhere
    rows += [rows[0], rows[5], rows[n + 40], rows[n + 40]]  # rows repeated as a whole
    rows += [(None, same, 1), (2000, None, 1), (2050, [1.0, None, 1.0, 1.0, 1.0, 1.0], 2), (2100, [float("nan")] * 6, 1), (2150, [float("inf")] + same[1:], 1), (2200, same, None)]
    rows += [(2250, [], 1), (2300, [1.0, 2.0], 2), (2350, [0.0] * dim, 1), (2400, [-x for x in same], 0), (2450, same, 9)]
    return rows


@pytest.mark.parametrize("round_", [H.ROUND, 4])
def test_equals_brute_force(spark, round_):
    rows = rows_of(3)
    got = H.mined(spark, frame(spark, rows), every=10, round_=round_)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 10)


def test_small_windows_and_large_components(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, [x * 3000 if i % 2 else x for x in e] if e and all(x is not None and math.isfinite(x) for x in e) else e, c) for i, e, c in rows_of(4, 120) if i is not None]
        got = H.mined(spark, frame(spark, rows, 5), every=10)
        assert Counter(tuple(r) for r in got.collect()) == brute(rows, 10)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_nothing_to_find(spark):
    assert H.mined(spark, frame(spark, [(1, [1.0], 1)]).limit(0)).collect() == []
    assert H.mined(spark, frame(spark, [(50, [1.0], 1), (51, [0.7], 2)])).collect() == []  # no positive
    assert H.mined(spark, frame(spark, [(51, [1.0], 1), (52, [0.7], 2)])).collect() == []  # no anchor
    got = H.mined(spark, frame(spark, [(50, [1.0], 1), (51, [0.9], 1), (52, [0.7], 2), (53, [0.89], 2)])).collect()
    assert [tuple(r) for r in got] == [(50, 51, 1, 52, 256 * 230, 256 * 179)]


def test_bounds_hold_every_score():
    rng = np.random.default_rng(5)
    for dim in (1, 2, 8):
        directions = H._directions(rng.integers(-50, 50, (200, dim)), 6)
        a = np.concatenate([rng.integers(-300, 300, (60, dim)), np.zeros((1, dim), np.int64)])
        anchors = H.Anchors(np.arange(61), np.zeros(61, int), a, directions)
        for _ in range(40):
            base = rng.integers(-200, 200, dim)
            w = base + rng.integers(-20, 21, (9, dim))
            angle = H._angles(w, directions).astype(np.float32).astype(np.float64)
            low, top = anchors.bounds(angle, np.linalg.norm(w.astype(float), axis=1))
            s = a @ w.T
            assert (s.min(axis=1) >= low).all() and (s.max(axis=1) <= top).all()


def test_close_windows_are_skipped():
    """Windows of one cluster give bounds that leave other clusters' anchors out."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 100, (8, 16))
    directions = H._unit(centres)
    a = np.round(centres).astype(np.int64)
    anchors = H.Anchors(np.arange(8), np.zeros(8, int), a, directions)
    w = np.round(centres[0] + rng.normal(0, 4, (50, 16))).astype(np.int64)
    _, top = anchors.bounds(H._angles(w, directions), np.linalg.norm(w.astype(float), axis=1))
    assert (top < 0.9 * top[0]).sum() >= 5
