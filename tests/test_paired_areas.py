"""Paired tests of all models at once against placements taken pair by pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.operators import metrics


def reference(y, a, b):
    """AUCs and variance of their difference from the matrix of all comparisons."""
    one, zero = y == 1, y == 0
    wins = lambda p: (p[one][:, None] > p[zero]) + (p[one][:, None] == p[zero]) / 2
    wa, wb = wins(a), wins(b)
    gap = (wa - wb).mean(axis=1), (wa - wb).mean(axis=0)
    return wa.mean(), wb.mean(), sum(g.var(ddof=1) / len(g) for g in gap)


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(2)
    y = (rng.random(500) < 0.3).astype(int)
    base = rng.standard_normal(500) + y
    return y, {"a": base, "b": np.round(base * 2) / 2, "c": rng.standard_normal(500), "twin": base.copy()}


def long_form(spark, y, scores):
    return spark.createDataFrame([(m, i, int(y[i]), float(p)) for m, s in scores.items() for i, p in enumerate(s)], "model string, id long, y int, proba double")


def test_all_pairs_equal_pairwise_delong(spark, scores):
    y, by = scores
    areas = metrics.paired_areas(long_form(spark, y, by))
    for i, a in enumerate(areas.models):
        for b in areas.models[i + 1 :]:
            auc_a, auc_b, variance = reference(y, by[a], by[b])
            gap, z, p = areas.test(a, b)
            assert gap == pytest.approx(auc_a - auc_b, abs=1e-12)
            assert z == pytest.approx(gap / np.sqrt(variance) if variance > 1e-18 else 0.0, abs=1e-6)
            assert (p == 1.0) == (variance < 1e-18)


def test_forest(spark, scores):
    y, by = scores
    rows = {r.model: r for r in metrics.forest(long_form(spark, y, by), "a").collect()}
    assert set(rows) == {"b", "c", "twin"}
    auc_c, auc_a, variance = reference(y, by["c"], by["a"])
    assert rows["c"].high - rows["c"].difference == pytest.approx(1.96 * np.sqrt(variance), rel=1e-6)
    assert rows["twin"].difference == 0 and rows["twin"].high == pytest.approx(1.96 * 0.05)


def test_models_have_to_align(spark, scores):
    y, by = scores
    rows = long_form(spark, y, by)
    for broken in (rows.where("model <> 'c' or id <> 7"), rows.withColumn("y", F.when((F.col("model") == "c") & (F.col("id") == 7), 1 - F.col("y")).otherwise(F.col("y"))), rows.where("y = 1")):
        with pytest.raises(ValueError):
            metrics.paired_areas(broken)
