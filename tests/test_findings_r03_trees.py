"""Trees of several columns on rows sorted once (F5, F17, F19)."""

from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from lendframe.operators import exact_trees


def test_levels_count_no_cells(spark, monkeypatch):
    """No level groups cells by value; a value that most rows have lies in several parts; decimals, NULLs and weights."""

    def refused(*_):
        raise AssertionError("cells were counted")

    monkeypatch.setattr(exact_trees, "best_cuts", refused)
    rng = np.random.default_rng(8)
    data = []
    for i in range(500):
        a = None if i % 23 == 0 else 3.0 if i % 4 else float(rng.integers(0, 9))
        data.append((i, a, float(rng.integers(-4, 5)), Decimal(int(rng.integers(-10**12, 10**12)) + (4 * 10**11 if a == 3.0 else 0)).scaleb(-12), int(rng.integers(0, 3))))
    rows = spark.createDataFrame(data, "id int, a double, b double, e decimal(18,12), w int")
    (tree,) = exact_trees.grow(rows, F.col("e"), [{"a": F.col("a"), "b": F.col("b")}], 40, 2, [F.col("w")])

    def brute(part, depth, node=""):
        score = lambda p: float(sum(r[3] * r[4] for r in p)) ** 2 / sum(r[4] for r in p)
        best = None
        for j in (1, 2):
            values = sorted({r[j] for r in part})
            for low, high in zip(values, values[1:]):
                left, right = [r for r in part if r[j] <= low], [r for r in part if r[j] > low]
                if min(sum(r[4] for r in left), sum(r[4] for r in right)) >= 40:
                    gain = score(left) + score(right) - score(part)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, j, (low + high) / 2, left, right)
        if not best or not depth:
            return {}
        _, j, cut, left, right = best
        return {node: ("?ab"[j], cut)} | brute(left, depth - 1, node + "0") | brute(right, depth - 1, node + "1")

    want = brute([r for r in data if r[1] is not None and r[4]], 2)
    assert len(want) >= 2 and tree.splits == want
