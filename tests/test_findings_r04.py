"""Fits of all folds on distinct rows that are not copied for each fold (F1, F5)."""

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lendframe.operators import folded, glm, metrics, quantiles, resample
from lendframe.plans import benchmark, tuning


@pytest.fixture(scope="module")
def rows(spark):
    """900 rows with a fold; missing and odd values, ties, and levels that are NULL."""
    rng = np.random.default_rng(7)
    made = []
    for i in range(900):
        x, z = float(np.round(rng.lognormal(), 1)), float(rng.integers(-3, 4))
        c = [None, "a", "b", "d"][int(rng.integers(4))]
        made.append((i, None if i % 17 == 0 else float("nan") if i % 41 == 0 else x, z, c, int(rng.random() < 1 / (1 + np.exp(1 - x + 0.3 * z))), i * 7 % 3))
    return spark.createDataFrame(made, "id long, x double, z double, c string, y int, fold int").cache()


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that is written."""
    sizes, plain = [], DataFrameWriter.parquet

    def parquet(self, path, *given, **named):
        plain(self, path, *given, **named)
        sizes.append(self._spark.read.parquet(path).count())

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return sizes


def test_tuning_copies_no_row_for_a_fold(spark, written):
    data = spark.range(600).selectExpr("id", "cast(id % 150 as double) as x", "string(id % 3) as c", "cast(id * 7919 % 101 + id % 150 > 120 as int) as y")
    tuning.tune(data, "y", "id", ["x"], ["c"], trials=2, batch=2, k=5)
    assert max(written) <= 600


def test_quantiles_of_the_other_folds(rows, monkeypatch):
    counted = rows.groupBy("fold", "x", "z").agg(F.count(F.lit(1)).alias("n"))
    points = [0.0, 0.2, 0.25, 0.5, 0.77, 1.0]
    got = quantiles.of_others(counted, "fold", 4, {"x": F.nanvl("x", F.lit(None)), "z": F.col("z")}, points, "n", {(1, "x"): 2.0})
    assert set(got) == {(g, c) for g in range(4) for c in "xz"}
    held = rows.toPandas()
    for (g, c), q in got.items():
        v = held[c][held.fold != g].dropna().to_numpy()
        assert np.allclose(q, np.quantile(np.minimum(v, 2.0) if (g, c) == (1, "x") else v, points), rtol=1e-12)
    alone = quantiles.of_others(counted.where("fold = 2"), "fold", 3, {"z": F.col("z")}, points, "n")
    assert set(alone) == {(0, "z"), (1, "z")}


def test_folded_fits_and_areas_equal_those_of_copies(rows, monkeypatch):
    monkeypatch.setattr(folded, "SLICE", 20)
    monkeypatch.setattr(folded, "BUFFER", 64)
    table = folded.folded(rows, "y", ["x", "z"], ["c"], 3, 100)
    assert table.rows.count() < 900 and table.rows.agg(F.sum("n")).first()[0] == 900
    made = folded.design(table)
    fits = folded.fit_ridges(made, [0.1, 20.0])
    copies, names = benchmark.PlainLogit.design(benchmark.fold_copies(rows, "id", ["x", "z"], 3), "y", 3, ["x", "z"], ["c"])
    assert names == made.names
    found = folded.areas(table, folded.edge_rows(table), made.scores(fits))
    warm = folded.fit_ridges(made, [0.1], start={(0, g): np.array([f.intercept, *f.coefficients.values()]) for g, f in enumerate(fits[1])})
    for t, ridge in enumerate((0.1, 20.0)):
        plain = glm.fit_groups(copies.where("__train"), "g", 3, "y", names, ridge=ridge)
        for g in range(3):
            assert fits[t][g].n == plain[g].n and fits[t][g].deviance == pytest.approx(plain[g].deviance, rel=1e-9)
            assert list(fits[t][g].coefficients.values()) == pytest.approx(list(plain[g].coefficients.values()), abs=1e-7)
        for r in metrics.auc(benchmark.scored_by(copies, plain, names), "proba", "y", "fold").collect():
            assert found[t, r.fold] == pytest.approx((r.auc, r.ks), abs=1e-9)
    assert [list(f.coefficients.values()) for f in warm[0]] == [pytest.approx(list(f.coefficients.values()), abs=1e-7) for f in fits[0]]


def test_benchmark_copies_no_row_for_a_fold(spark, written):
    data = spark.range(600).selectExpr("id", "cast(id % 5 as double) as x", "string(id % 3) as c", "cast(id * 7919 % 101 + id % 5 * 20 > 90 as int) as y")
    out, scored = benchmark.run(data, "y", "id", ["x"], ["c"], benchmark.default_models(), k=5)
    assert max(written) <= 600
    assert out.count() == 3 * 600 and scored.count() == 3 * 5


def test_benchmark_equals_fits_on_copies(rows):
    """Missing targets too: such rows are scored, and not trained or measured on."""
    data = rows.drop("fold").withColumn("y", F.when(F.col("id") % 29 > 0, F.col("y"))).cache()
    out, scored = benchmark.run(data, "y", "id", ["x", "z"], ["c"], benchmark.default_models(), k=3)
    copies = benchmark.fold_copies(resample.folds(data, "id", "y", 3, 42), "id", ["x", "z"], 3).cache()
    for m in benchmark.default_models():
        plain = {r["__id"]: (r.fold, r.y, r.proba) for r in m.fit_folds(copies, "y", 3, ["x", "z"], ["c"]).collect()}
        got = {r.id: (r.fold, r.y, r.proba) for r in out.where(F.col("model") == m.name).collect()}
        assert set(got) == set(plain) and len(got) == 900
        assert all(got[i][:2] == plain[i][:2] and got[i][2] == pytest.approx(plain[i][2], abs=1e-7) for i in got)
    held = {(r.model, r.fold): r for r in scored.collect()}
    for r in metrics.all_metrics(out, "proba", "y", "model", "fold").collect():
        own = held.pop((r.model, r.fold))
        assert [own[c] for c in ("auc", "ks", "gini", "brier", "logloss")] == pytest.approx([r[c] for c in ("auc", "ks", "gini", "brier", "logloss")], abs=1e-9)
    assert not held


def test_one_fold_has_nothing_to_train_on(spark):
    data = spark.range(60).selectExpr("id", "cast(id % 5 as double) as x", "cast(id % 3 = 0 as int) as y")
    out, scored = benchmark.run(data, "y", "id", ["x"], [], [benchmark.PlainLogit()], k=1)
    assert out.where("proba is not null").count() == 0 and scored.count() == 0
