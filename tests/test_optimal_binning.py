"""Optimal bins against every partition into neighbours."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lendframe.operators import binning


def iv(parts, tg, tb):
    return sum((g / tg - b / tb) * math.log((g / tg) / (b / tb)) for g, b in parts)


def partitions(cells, most):
    m = len(cells)
    for k in range(min(most, m)):
        for cuts in combinations(range(1, m), k):
            ends = [0, *cuts, m]
            yield ends[1:], [tuple(map(sum, zip(*cells[i:j]))) for i, j in zip(ends, ends[1:])]


def best(cells, tg, tb, need, most, allowed):
    top = (-1.0, None, None)
    for ends, parts in partitions(cells, most):
        rates = [b / (g + b) for g, b in parts]
        if min(map(sum, parts)) >= need and all(g and b for g, b in parts) and allowed([y - x for x, y in zip(rates, rates[1:])]):
            value = iv(parts, tg, tb)
            if value > top[0] + 1e-12:
                top = (value, ends, parts)
    return top


def turns(*signs):
    def allowed(steps):
        at = 0
        for s in steps:
            while at < len(signs) and s * signs[at] <= 0:
                at += 1
            if at == len(signs):
                return False
        return True
    return allowed


ALLOWED = {"ascending": turns(1), "descending": turns(-1), "peak": turns(1, -1), "valley": turns(-1, 1), "none": lambda _: True}


@pytest.mark.parametrize("seed", range(4))
def test_partition_of_each_trend(seed):
    own = random.Random(seed)
    cells = [(own.randint(20, 60), own.randint(3, 40)) for _ in range(9)]
    tg, tb = map(sum, zip(*cells))
    parts = binning._Parts(cells, tg, tb)
    for name, allowed in ALLOWED.items():
        for most in (2, 4, 9):
            value, ends, _ = best(cells, tg, tb, 90, most, allowed)
            got = binning._partition(parts, 90, most, binning.TRENDS[name])
            assert abs(got[0] - value) < 1e-9 and got[1] == ends, (name, most)


def test_levels_by_brute_force(spark):
    own = random.Random(5)
    chance = {c: own.random() * 0.6 + 0.1 for c in "abcdefghij"}
    rows = [(i, c, int(own.random() < chance[c])) for i, c in enumerate(own.choices("abcdefghij", weights=range(1, 11), k=1200))]
    rows += [(2000 + i, None, i % 2) for i in range(10)] + [(3000 + i, "odd", 1) for i in range(5)] + [(4000, "z", None)]
    df = spark.createDataFrame(rows, "id long, x string, y int")
    summary, binned = binning.optimal_levels(df, "x", "y", ["odd"], max_bins=5)
    tg, tb = (sum(y == t for _, _, y in rows) for t in (0, 1))
    count = lambda c: tuple(sum(x == c and y == t for _, x, y in rows) for t in (0, 1))
    levels = sorted("abcdefghij", key=lambda c: (count(c)[1] / sum(count(c)), c))
    _, ends, parts = best([count(c) for c in levels], tg, tb, 0.05 * 1200, 5, lambda _: True)
    want = [f"{i:02d} [{','.join(sorted(levels[a:b]))}]" for i, (a, b) in enumerate(zip([0, *ends], ends), 1)]
    got = summary.collect()
    assert [r.bin for r in got] == [*want, "Special"] and [(r.ng, r.nb) for r in got] == [*parts, (5, 10)]
    assert all(abs(r.woe - math.log((r.ng / tg) / (r.nb / tb))) < 1e-12 for r in got)
    label = {c: name for name, (a, b) in zip(want, zip([0, *ends], ends)) for c in levels[a:b]}
    assert {r.id: r.x_bin for r in binned.collect()} == {i: "Special" if c in (None, "odd") else label.get(c) for i, c, _ in rows}


def test_levels_at_the_edges(spark):
    pure = spark.createDataFrame([("a", 0)] * 50 + [("b", 1)] * 50, "x string, y int")
    # no bin but the whole holds both classes
    assert [(r.bin, r.no) for r in binning.optimal_levels(pure, "x", "y")[0].collect()] == [("01 [a,b]", 100)]
    even = spark.createDataFrame([(c, y) for c in "abc" for y in (0, 1) for _ in range(20)], "x string, y int")
    assert binning.optimal_levels(even, "x", "y")[0].count() == 1
    with pytest.raises(ValueError):
        binning.optimal_levels(pure.where("y = 0"), "x", "y")
    with pytest.raises(ValueError):
        binning.optimal_levels(spark.range(1500).select(F.col("id").cast("string").alias("x"), (F.col("id") % 2).alias("y")), "x", "y")
    with pytest.raises(ValueError):
        binning.optimal_bins(spark.range(100).selectExpr("id as x", "id % 2 as y"), "x", "y", trend="up")


def test_bins_of_a_peak(spark):
    df = spark.range(4000).selectExpr("cast(id as double) as x", "cast(id * 7919 % 100 < case when id < 1000 then 20 when id < 3000 then 60 else 30 end as int) as y")
    rates = [r.dr for r in binning.optimal_bins(df, "x", "y", trend="auto").collect()]
    top = rates.index(max(rates))
    assert 0 < top < len(rates) - 1 and rates[: top + 1] == sorted(rates[: top + 1]) and rates[top:] == sorted(rates[top:], reverse=True)
    assert binning.optimal_bins(df, "x", "y", trend="none").count() >= len(rates)
