"""Fits of the benchmark and of the tuning on counted rows (F2, F6), and scores counted once (F20, F21)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.operators import boosting, glm, metrics


def test_boosting_keeps_equal_rows_once(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(boosting, "stored", lambda df, label, one=boosting.stored: sizes.append((out := one(df, label)).count()) or out)
    rows = spark.range(2000).selectExpr("id", "cast(id % 8 as double) as x", "cast(id % 8 > 4 or id % 31 = 0 as int) as y")
    params = [boosting.Params(trees=2, leaves=4, depth=2)]
    plain = boosting.fit_boosted(rows, "y", "id", ["x"], [], params)
    counted = boosting.fit_boosted(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")), "y", "id", ["x"], [], params, copies="n")
    assert max(sizes) <= 16
    bins = np.arange(1, 9, dtype=np.uint8)[:, None]
    group = np.zeros(8, int)
    assert np.allclose(plain.margin(bins, group), counted.margin(bins, group), atol=1e-12) and plain.margin(bins, group)[7] > 0 > plain.margin(bins, group)[0]


def test_ridges_share_the_rows_of_a_group(spark):
    rows = spark.range(900).selectExpr("cast(id % 2 as int) as g", "cast((id * 37 % 101) / 50.0 - 1 as double) as x", "cast(id % 3 as double) as z", "cast((id * 37 % 101 + id * 11 % 60) > 80 as int) as y")
    cells = rows.groupBy("g", "x", "z", "y").agg(F.count(F.lit(1)).alias("n"))
    together = glm.fit_ridges(cells, "g", 3, "y", ["x", "z"], [0.1, 20.0], weight="n")
    for own, ridge in zip(together, (0.1, 20.0)):
        alone = glm.fit_groups(rows, "g", 3, "y", ["x", "z"], ridge=ridge)
        assert own[2] is None and alone[2] is None
        for a, b in zip(own[:2], alone[:2]):
            assert a.n == b.n == 450 and a.deviance == pytest.approx(b.deviance, rel=1e-9)
            assert [a.intercept, *a.coefficients.values()] == pytest.approx([b.intercept, *b.coefficients.values()], abs=1e-8)


def test_scores_are_counted_once(spark):
    """The edges of the slices, their totals and the running sums read one exchange of the counted scores."""
    rows = spark.range(500).selectExpr("id % 3 as m", "id * 7 % 91 as p", "cast(id % 5 = 0 as int) as y")
    got = metrics.running(metrics.by_score(rows, "p", "y", "m"), "m")
    got.collect()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = metrics.running(metrics.by_score(rows, "p", "y", "m"), "m")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Range (0, 500") == 1
