from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nametwin.operators import metrics as M


def scored(spark, y, p, threshold=0.5):
    rows = [(i, bool(a), float(b), bool(b >= threshold)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "k int, match boolean, proba double, decision boolean")


def test_threshold_golden(spark):
    y = [0, 1, 0, 1, 1, 0, 1, 0]
    p = [0.2, 0.7, 0.4, 0.9, 0.3, 0.6, 0.8, 0.1]
    assert M.find_threshold(scored(spark, y, p), 0.8) == 0.61  # fixed value


def test_threshold_equals_101_passes(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(200), np.arange(101) * 0.01, [0.0, 1.0]])
    y = rng.random(len(p)) < p
    table = {round(r["threshold"] * 100): r["precision"] for r in M.threshold_table(scored(spark, y, p)).collect()}
    for i in range(101):
        hit = p >= i * 0.01
        assert table[i] == pytest.approx(y[hit].mean() if hit.any() else 0.0), i


def test_no_threshold_is_an_error(spark):
    with pytest.raises(ValueError):
        M.find_threshold(scored(spark, [0, 0], [0.2, 0.9]), 0.8)
    with pytest.raises(ValueError):
        M.take_decision(F.col("proba"), None)


def test_average_precision_and_auc_goldens(spark):
    curve = M.running_counts(scored(spark, [1, 0, 1, 0, 1, 0], [0.9, 0.8, 0.7, 0.7, 0.4, 0.1]))
    assert M.average_precision(curve).first()[0] == pytest.approx(0.7)
    assert M.roc_auc(curve).first()[0] == pytest.approx(0.611111, abs=1e-6)


def test_ranged_curve_equals_one_range(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(700) ** 4, 3)
    y = rng.random(700) < 0.4
    rows = scored(spark, y, p)
    one = sorted(map(tuple, M.running_counts(rows).collect()))
    many = sorted(map(tuple, M.running_counts(rows, range_rows=20).collect()))
    assert one == many and len(one) == len(set(p))
    assert max(r[3] for r in one) == 700


def test_quantiles_interpolate_like_numpy(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 200):
        p = np.round(rng.random(n), 2)
        got = M.score_quantiles(M.running_counts(scored(spark, [1] * n, p)))
        values = {r["metric"]: r["value"] for r in got.collect()}
        expected = {f"test_q{q}": float(np.quantile(p, q)) for q in (0.25, 0.5, 0.75)}
        assert values == pytest.approx(expected)


def test_confusion_and_zero_denominators(spark):
    row = M.confusion_metrics(scored(spark, [1, 1, 0, 0], [0.9, 0.1, 0.8, 0.2])).first()
    assert tuple(row) == (0.5, 0.5, 0.5)
    assert tuple(M.confusion_metrics(scored(spark, [0, 0], [0.1, 0.2])).first()) == (1.0, 0.0, 0.0)


def test_evaluation_and_gate(spark):
    rows = M.evaluate(scored(spark, [1, 1, 0], [0.9, 0.8, 0.3]), 0.98).collect()
    values = {r["metric"]: r["value"] for r in rows}
    assert len(values) == len(rows) == 9
    assert values["passed"] == values["average_precision_score"] == 1.0
    low = M.evaluate(scored(spark, [0, 1, 0], [0.9, 0.8, 0.3]), 0.98).collect()
    assert {r["metric"]: r["value"] for r in low}["passed"] == 0.0


def test_examples_and_samples(spark):
    rows = scored(spark, [1, 1, 0, 1], [0.9, 0.8, 0.1, 0.2]).withColumns(
        {"A": F.concat(F.lit("a"), "k"), "B": F.lit("b")}
    )
    assert [r["A"] for r in M.examples(rows, True, "k").collect()] == ["a0", "a1"]
    assert [r["A"] for r in M.examples(rows, False, "k").collect()] == ["a2"]
    assert M.sample_by_label(rows, True, "k").count() == 3
    once = M.sample_by_label(rows, True, "k", 2).collect()
    assert M.sample_by_label(rows.repartition(3), True, "k", 2).collect() == once
