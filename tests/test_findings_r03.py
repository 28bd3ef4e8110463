"""Tests of what the third round's findings changed."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.functions import draws
from lendframe.operators import exact_trees, glm, metrics, quantiles, resample, validation


def test_neighbours_by_strips_of_blocks(spark, monkeypatch):
    """No join of pairs: blocks meet in one task by strips. Ties, NULLs, NaN, -0.0 and decimals as the formula has them."""
    monkeypatch.setattr(resample, "BLOCK", 16)
    monkeypatch.setattr(resample, "STRIP", 5)
    rng = np.random.default_rng(3)
    data = [(f"k{i:03}", None if i % 13 == 0 else float(rng.integers(0, 6)) * (-1 if i % 2 else 1), Decimal(int(rng.integers(0, 40))).scaleb(-2), None if i % 7 == 0 else "ab"[i % 2], i % 3) for i in range(90)]
    data.append(("nan", math.nan, Decimal("0.10"), "a", 0))
    data.append((None, 1.0, Decimal("0.10"), "a", 0))
    rows = spark.createDataFrame(data, "id string, x double, d decimal(9,2), g string, h int")
    near = resample.heom_neighbours(rows, "id", ["x", "d"], ["g", "h"], 4, [12.0, 0.39])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan
    known = [r for r in data if r[0]]

    def distance(a, b):
        parts = [1.0 if a[1] is None or b[1] is None else ((a[1] - b[1]) / 12.0) ** 2, (float(a[2] - b[2]) / 0.39) ** 2]
        parts += [1.0 if a[i] is None or b[i] is None else float(a[i] != b[i]) for i in (3, 4)]
        return math.sqrt(sum(parts)) if not math.isnan(sum(parts)) else math.inf

    want = []
    for a in known:
        best = sorted((distance(a, b), b[0]) for b in known if b[0] != a[0])[:4]
        want += [(a[0], i + 1, b) for i, (_, b) in enumerate(best)]
    assert sorted((r.id, r["rank"], r.neighbour) for r in near.collect()) == sorted(want)


@pytest.mark.parametrize("n", [1, 3])
def test_neighbours_of_few_rows(spark, n):
    rows = spark.range(n).select("id", F.col("id").cast("double").alias("x"))
    assert resample.heom_neighbours(rows, "id", ["x"], [], 5).count() == n * (n - 1)


def test_quantiles_equal_duckdb_to_the_last_bit(spark):
    """Cuts go into rules as text, so the last digit counts."""
    import duckdb

    rng = np.random.default_rng(11)
    points = [i / 10 for i in range(1, 10)]
    data = [(k, round(float(v), 2)) for k in range(40) for v in np.cumsum(rng.uniform(-3, 12, 300 + k)) - 500]
    rows = spark.createDataFrame(data, "k int, x double")
    got = {r.k: list(r.q) for r in quantiles.exact(rows, {"x": F.col("x")}, points, "k").collect()}
    con = duckdb.connect()
    for k in range(40):
        values = [x for key, x in data if key == k]
        (want,) = con.execute(f"select quantile_cont(x, {points}) from (select unnest(?::double[]) as x)", [values]).fetchone()
        assert got[k] == want


def test_leaf_sums_of_trees_of_one_column(spark):
    """Trees of one column grow on the sums at each value; their leaves' sums are those of the rows."""
    rng = np.random.default_rng(5)
    data = [(None if i % 17 == 0 else float(x), int(x > 4) + int(rng.integers(0, 2)), None if i % 19 == 0 else int(rng.integers(0, 2))) for i, x in enumerate(rng.integers(0, 9, 400))]
    rows = spark.createDataFrame(data, "x double, s int, t int")
    sums = {}
    x = F.col("x")
    trees = exact_trees.grow(rows, [[F.col("s").cast("long")], [F.col("t").cast("long")]], [{"x": x}, {"x": x}], [30, 60], leaves=sums)
    assert trees[0].splits
    for t, goal in enumerate((1, 2)):
        cuts = sorted(c for _, c in trees[t].splits.values())
        want = {}
        for r in data:
            if r[0] is not None and r[goal] is not None:
                leaf = trees[t].leaves()[sum(c < r[0] for c in cuts)]
                n, s = want.get((t, leaf), (0, 0))
                want[t, leaf] = (n + 1, s + r[goal])
        assert {k: tuple(map(int, v)) for k, v in sums.items() if k[0] == t} == want


@pytest.mark.parametrize("length", [1, 7, 40, 70])
def test_md5_of_many_keys_at_once(length):
    import hashlib

    rng = np.random.default_rng(length)
    middles = rng.integers(32, 127, (50, length)).astype(np.uint8)
    one, two = draws.md5_words(b"991|", middles, b"|12|benchmark")
    for i, m in enumerate(middles):
        key = hashlib.md5(b"991|" + m.tobytes() + b"|12|benchmark").hexdigest()
        assert (int(key[:8], 16), int(key[8:16], 16)) == (one[i], two[i])


def test_returns_equal_those_by_columns(spark):
    """Ids of several lengths, and rows that are left out."""
    rows = spark.range(5, 1200).select(F.when(F.col("id") % 50 != 0, F.col("id") * 97).alias("id"), (F.col("id") % 9 == 0).cast("int").alias("y"), ((F.col("id") % 97 + 1) / 99).alias("p"), F.lit(0.3).alias("q"))
    got = {(r.sim, r.model): r.portfolio_return for r in validation.evrs(rows, "y", "p", "q", "id", sims=3).collect()}
    long = rows.dropna().select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("sim"))
    for model, p in (("estimated", "p"), ("benchmark", "q")):
        odds = F.log(F.col(p) / (1 - F.col(p))) + 0.5 * draws.normal(F.lit(991), F.col("id"), F.col("sim"), F.lit(model))
        priced = long.withColumns({"own": validation.spread(1 / (1 + F.exp(-odds))), "fair": validation.spread(F.col("q"))})
        stay = 1 - F.exp(-5.0 * F.greatest(F.col("own") - F.col("fair"), F.lit(0.0))) < 0.5
        for r in priced.where(stay).groupBy("sim").agg(F.avg(F.when(F.col("y") == 1, -0.45).otherwise(F.col("own"))).alias("gain")).collect():
            assert abs(got[r.sim, model] - r.gain) < 1e-12


def test_draws_of_parted_cells(spark, monkeypatch):
    """Cells are counted in parts and for all draws at once, as the draw of each row says."""
    monkeypatch.setattr(resample, "CELL", 7)
    rows = spark.range(300).select("id", (F.col("id") % 3).cast("double").alias("x"), (F.col("id") * 7 % 11 < F.col("id") % 3 + 4).cast("int").alias("y"))
    got = {r.draw: r.auc for r in resample.bootstrap_validation(rows, "y", ["x"], "id", 45).collect()}
    assert sorted(got) == list(range(45))
    for i in (0, 20, 44):
        drawn = rows.withColumn("w", resample._poisson("id", F.lit(i), 1122))
        fit = glm.fit_logit(drawn.where("w > 0"), "y", ["x"], weight="w")
        assert abs(metrics.auc(drawn.where("w = 0").select("y", fit.probability().alias("p")), "p", "y").first().auc - got[i]) < 1e-9


def test_words_that_wrap(spark):
    """The 32-bit words of the bootstrap equal the remainders of its column form."""
    import pyarrow as pa

    start = np.array([0, 1, 4294967295, 2654435761, 739982445], np.int64)
    found = resample._draw_counts(pa.table({"start": start, "cell": pa.array([3] * 5, pa.int32())}), 50)
    inside = np.concatenate([np.frombuffer(v.as_py(), np.int64) for v in found["inside"]])
    for g in range(50):
        mixed = [(int(s) + g * 2654435761) % 2**32 for s in start]
        u = [((m ^ (m >> 15)) * 739982445) % 2**32 / 2**32 for m in mixed]
        assert inside[g] == sum(v >= c for v in u for c in resample.POISSON)
