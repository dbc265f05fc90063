"""Hard negatives against whole numbers over every pair of rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlytics.llm import hard_negatives as hn

KINDS = "vec_id long, embedding array<double>, label int, length string, key int"


def whole(vector):
    return tuple(math.floor(min(max(256 * x, -1.7976931348623157e308), 1.7976931348623157e308)) for x in vector)


def cut(score):
    return min(max(score, hn.LEAST), hn.MOST)


def plain(rows, every=5, positives=5, negatives=3):
    """Rows (id, vector, label); anchors are ids divisible by ``every``."""
    used = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (i, whole(v), label) not in used:
            used.append((i, whole(v), label))
    out = []
    for a in used:
        if a[0] is None or a[0] % every:
            continue
        scored = sorted(((cut(sum(x * y for x, y in zip(a[1], b[1]))), b) for b in used if b is not a), key=lambda s: (-s[0], s[1][0] is None, s[1][0] or 0))
        for p, b in [s for s in scored if s[1][2] == a[2]][:positives]:
            found = [(n, c[0]) for n, c in scored if c[2] != a[2] and 50 * p <= 100 * n <= 95 * p][:negatives]
            out += [(a[0], b[0], k, i, p, n) for k, (n, i) in enumerate(found, 1)]
    return sorted(out, key=str)


def run(spark, rows, every=5, **options):
    table = spark.createDataFrame([(i, v, label, "clash", 7) for i, v, label in rows], KINDS)
    return sorted((tuple(r) for r in hn.hard_negatives(table, F.col("vec_id") % every == 0, **options).collect()), key=str)


def clustered(seed, n, dims, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[r.integers(6)] * r.choice([0.3, 1, 2]) + r.normal(size=dims) * spread
        rows.append((i, [float(x) for x in v], int(r.integers(3))))
    return rows


@pytest.mark.parametrize("seed,dims,spread", [(1, 8, 0.05), (2, 3, 0.3), (3, 24, 1.0)])
def test_every_pair(spark, monkeypatch, seed, dims, spread):
    monkeypatch.setattr(hn, "ROWS", 16)
    monkeypatch.setattr(hn, "RUN", 3)
    rows = clustered(seed, 300, dims, spread)
    want = plain(rows)
    assert run(spark, rows) == want and len(want) > 100


def test_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 8)
    monkeypatch.setattr(hn, "RUN", 2)
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, 0.25, 0.5, -0.25, 1.0]) for _ in range(3)], r.randrange(3)) for i in range(120)]
    rows += rows[:10] + rows[:3]  # repeats
    rows += [(5, [1.0, 1.0, 0.25], rows[5][2]), (5, [0.5, 0.5, 0.25], 2), (10, [1.0], 1), (11, [], 1), (15, [], 0), (20, [0.5, 0.5, 0.5, 0.5], 1)]
    rows += [(200, None, 1), (205, [0.5, None, 1.0], 1), (210, [float("nan"), 1.0, 1.0], 1), (215, [float("inf"), 1.0, 1.0], 1), (220, [1.0, 1.0, 1.0], None)]
    rows += [(None, [1.0, 1.0, 0.5], 1), (None, [0.5, 1.0, 0.5], 0), (None, None, None), (225, [-1.0, -1.0, -1.0], 7), (230, [-1.0, -0.5, -1.0], 8), (-5, [1.0, 0.5, 0.25], 1)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, positives=2, negatives=1) == plain(rows, 5, 2, 1)


def test_numbers_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 8)
    r = random.Random(6)
    rows = [(i, [r.choice([1, 1e7 + 0.1, 2.0**33, 3e5, 0.1]) * r.random() for _ in range(4)], r.randrange(2)) for i in range(60)]
    rows += [(60, [1e300, 1e300, 1.0, 1.0], 0), (65, [1e200, -1e200, 1.0, 0.0], 1), (66, [1.7e308] * 4, 1)]
    assert run(spark, rows) == plain(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(spark, [(5, [1.0], 1)]) == []
    assert run(spark, [(5, [1.0], 1), (10, [1.0], 1)]) == []


@pytest.mark.parametrize("spread", [0.02, 0.4])
def test_pruning_keeps_all_that_is_needed(spread):
    r = np.random.default_rng(9)
    centres = r.normal(size=(40, 12))
    x = np.floor(256 * (centres[r.integers(40, size=600)] + spread * r.normal(size=(600, 12))))
    a = np.floor(256 * (centres[r.integers(40, size=50)] + spread * r.normal(size=(50, 12))))
    batch = [(list(range(600)), [0] * 600, [0.0] * 600, [row.tobytes() for row in x])]

    class Rows:
        def column(self, i):
            return type("C", (), {"to_pylist": lambda s: batch[0][i]})()

    hn.TaskContext, kept = type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda s: 0})())}), hn.TaskContext
    try:
        bucket = hn.Bucket(next(hn._buckets(iter([Rows()]))).to_pylist()[0])
    finally:
        hn.TaskContext = kept
    score = (a @ x.T).astype(np.int64)
    verified = 0
    for share in (0.999, 0.95, 0.7, 0.2, 0.0, -0.5):
        needed = np.full(len(a), hn.LEAST) if share < 0 else (share * score.max(1)).astype(np.int64)
        i, j, s = hn.candidates(a, needed, bucket, False)
        want = {(p, q) for p, q in zip(*np.nonzero(score >= needed[:, None]))}
        assert set(zip(i, j)) == want and len(i) == len(want)
        assert (s == score[i, j]).all()
        if share == 0.95:
            first, end = bucket.ranges(np.zeros((1, 1), np.int64), np.full((1, 1), -1.0), np.full((1, 1), 1.0))
            assert (first[0, 0], end[0, 0]) == (0, 600)
