"""Hard negatives against a plain search over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n int"


def plain(rows, positives=5, negatives=3):
    """Over (id, vector, label) rows; the label rule and the anchors are those of the query."""
    used = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        used.append((i, [max(-(2**24), min(2**24, math.floor(256 * float(np.float32(x))))) for x in v], label))
    out = []
    late = lambda i: 2**63 if i is None else i
    for at, (anchor, q, label) in enumerate(used):
        if anchor is None or anchor % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), late(i), i, other) for j, (i, v, other) in enumerate(used) if j != at), key=lambda x: x[:2])
        for p in [x for x in scored if x[3] == label][:positives]:
            fits = [x for x in scored if x[3] != label and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]][:negatives]
            out += [(anchor, p[2], k, x[2], -p[0], -x[0]) for k, x in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.mine(df, label, F.col("embedding"), F.col("vec_id") % 50 == 0).collect()), key=str)


def made(n, dims, labels, seed, coarse=False):
    rng = random.Random(seed)
    draw = (lambda: rng.choice([-0.5, 0.0, 0.25, 0.5])) if coarse else (lambda: rng.gauss(0.1, 0.3))
    return [(i, [draw() for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("coarse", [False, True])  # coarse values make ties
def test_equals_a_plain_search(spark, coarse):
    rows = made(420, 12, 4, 3, coarse)
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 20


def test_slices_and_groups_are_merged(spark, monkeypatch):
    rows = made(500, 8, 3, 5)
    want = plain(rows)
    for name, value in (("SLICE", 23), ("GROUP", 3), ("FAN", 3)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    rows = made(120, 6, 2, 7)
    rows += [(50, None, 1), (100, [0.1, None, 0.2], 1), (150, [float("nan")] * 6, 0), (200, [float("inf")] * 6, 0), (250, [0.5] * 6, None)]
    rows += [(None, [0.4] * 6, 1), (None, [0.4] * 6, 0), (50, rows[50][1], rows[50][2]), (50, rows[50][1], rows[50][2]), (300, [], 1), (350, [0.3, 0.2], 0), (400, [1e30, -1e30, 3e38, 1.0, 0.0, 0.0], 1)]
    assert mined(spark, rows) == plain(rows)


def test_hot_label_and_empty_tables(spark):
    rows = [(i, [1.0, i % 5 / 8.0], 1 if i % 3 else i % 10) for i in range(300)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(50, [1.0], 1)]) == []


def test_bounds_drop_rows_and_keep_the_best():
    rng = np.random.default_rng(1)
    columns = np.floor(256 * rng.normal(0, 0.2, (64, 4096)))
    anchor = np.floor(256 * rng.normal(0, 0.05, 64))
    anchor[:4] *= 40  # a few large dimensions decide
    left, scores = negatives.shrink(anchor, columns, columns.min(1), columns.max(1), np.array([[-negatives.FAR, negatives.FAR]], float), [np.zeros(0)], 5)
    every = anchor @ columns
    assert set(np.argsort(-every)[:6]) <= set(left) and (scores == every[left]).all() and len(left) < 100
