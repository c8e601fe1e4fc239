"""Exact top-k search against all products."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from nametwin.llm import op12_search as op


def whole(x):
    return math.floor(Fraction(x) * 256)


def brute(rows, asks, k=5):
    """(query_id, rank, vec_id, score) of (vec_id, vector) rows."""
    fine = [(i, v, [whole(x) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and None not in e and np.isfinite(e).all()]
    out = []
    for i, v, e in fine:
        if v is None or not asks(v):
            continue
        long = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        scored = [
            (-long(sum(a * b for a, b in zip(e, x, strict=True))), w is None, w or 0)
            for j, w, x in fine
            if j != i and len(x) == len(e)
        ]
        for r, (s, none, w) in enumerate(sorted(scored)[:k], 1):
            out.append((v, r, None if none else w, -s))
    return sorted(out, key=str)


def found(frame, **options):
    got = op.top_products(frame, F.col("vec_id") % 3 == 0, **options).collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("options", [{}, {"queries": 4, "tile_values": 60}, {"k": 1, "tile_values": 1}, {"k": 40}])
def test_equal_to_all_products(spark, options):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # a frequent vector: ties
    rows += [(200 + i, rng.integers(-1, 2, 20).tolist()) for i in range(30)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (6, None), (9, [1.0, None]), (12, [math.nan] * 20)]
    rows += [(15, [math.inf] * 20), (18, [0.0] * 20), (21, []), (24, []), (27, [1.0, 2.0]), (30, [2.0, -1.0]), (33, [5.0])]
    rows = [(v, None if e is None else [None if x is None else float(x) for x in e]) for v, e in rows]
    frame = spark.createDataFrame([(v, e, 1, 2) for v, e in rows], "vec_id long, embedding array<double>, uid int, score int")
    want = brute(rows, lambda v: v % 3 == 0, options.get("k", 5))
    assert found(frame.repartition(3), **options) == want


def test_products_beyond_doubles(spark):
    rows = [(i, [1e300 if i % 2 else -3.5, 2.0**60 + i * 512, -1e15]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(frame) == brute(rows, lambda v: v % 3 == 0)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert found(frame) == []


def test_branch_and_bound_reads_less_and_loses_nothing():
    rng = np.random.default_rng(5)
    vectors = np.floor(256 * rng.normal(size=(4000, 64)) * 0.98 ** np.arange(64) ** 1.5)
    vectors[7::50] = vectors[7] + rng.integers(-3, 4, (80, 64))
    columns = np.ascontiguousarray(vectors.T)
    for q in range(0, 200, 7):
        places, scores, read = op.best(columns, vectors[q], 5, q)
        full = vectors @ vectors[q]
        full[q] = -np.inf
        assert set(np.flatnonzero(full >= np.sort(full)[-5])) <= set(places.tolist())
        assert scores.tolist() == full[places].tolist()
        assert read < 0.6 * columns.size
