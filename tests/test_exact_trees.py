"""Exact-cut trees against brute force over every cut, with ties, endless values, NULLs, text factors and slices."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lendframe.operators import exact_trees, trees


def brute(rows, least, depth, node=""):
    """rows: (x, y, weight). Splits {node: (column, cut)} of least squared error by trying every cut."""
    total = lambda part: (sum(w for _, _, w in part), sum(y * w for _, y, w in part))
    score = lambda part: total(part)[1] ** 2 / total(part)[0]
    best = None
    for j in range(len(rows[0][0]) if depth else 0):
        values = sorted({x[j] for x, _, _ in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2 if (a + b) / 2 < b else a
            left, right = [r for r in rows if r[0][j] <= cut], [r for r in rows if r[0][j] > cut]
            if min(total(left)[0], total(right)[0]) >= least:
                gain = score(left) + score(right) - score(rows)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, j, cut, left, right)
    if not best:
        return {}
    _, j, cut, left, right = best
    return {node: (j, cut)} | brute(left, least, depth - 1, node + "0") | brute(right, least, depth - 1, node + "1")


@pytest.fixture(scope="module")
def made(spark):
    own, rows = random.Random(7), []
    for i in range(1500):
        a, b = own.choice([own.randint(0, 400) / 8, 50.0]), own.choice([-math.inf, math.inf, 1.0, 2.0, 3.0])
        rows.append((i, a, b if i % 19 else None, own.choice(["p", "q", "r", None]), int(own.random() < 0.1 + a / 90 + 0.2 * (b == 2.0)), own.randint(0, 3)))
    return rows, spark.createDataFrame(rows, "id long, a double, b double, t string, y int, w int").cache()


def test_every_cut_is_tried(spark, made):
    rows, df = made
    sets = [["a"], ["a", "b"]]
    columns = [{c: F.col(c) for c in own} for own in sets]
    got = exact_trees.grow(df, F.col("y"), columns, 40, None, [F.col("w"), F.lit(1)])
    for own, tree, weight in zip(sets, got, (lambda r: r[5], lambda r: 1)):
        kept = [(tuple(r[1 + "ab".index(c)] for c in own), r[4], weight(r)) for r in rows if weight(r) and not (r[2] is None and "b" in own)]
        want = brute(kept, 40, 99)
        assert len(want) > 5 and {n: (own.index(c), cut) for n, (c, cut) in tree.splits.items()} == want


def test_same_tree_for_any_partitions_and_slices(made, monkeypatch):
    _, df = made
    grown = lambda d: [t.splits for t in exact_trees.grow(d, F.col("y"), [{"a": F.col("a"), "b": F.col("b")}], 30, 4)]
    want = grown(df)
    assert grown(df.repartition(7)) == want
    monkeypatch.setattr(exact_trees, "sliced", lambda counts, keys, _, one=exact_trees.sliced: one(counts, keys, 3))
    assert grown(df) == want


def test_interaction_leaves_and_rules(made):
    rows, df = made
    info, out = trees.interaction_leaves(df, "y", ["a", "t"], max_depth=2)
    kept = [r for r in rows if r[3] is not None]
    want = brute([((r[1], float(r[3] == "q"), float(r[3] == "r")), r[4], 1) for r in kept], max(int(0.05 * len(kept)), 30), 2)
    names = ["a", "t_q", "t_r"]
    leaf = {}
    for r in kept:
        node, x = "", (r[1], float(r[3] == "q"), float(r[3] == "r"))
        while node in want:
            node += "0" if x[want[node][0]] <= want[node][1] else "1"
        leaf[r[0]] = node
    label = {n: f"L{i}" for i, n in enumerate(sorted(set(leaf.values())), 1)}
    assert {r.id: r.interaction for r in out.collect()} == {r[0]: label[leaf[r[0]]] if r[3] is not None else None for r in rows}
    for r in info.collect():
        own = [x for x in kept if label[leaf[x[0]]] == r.leaf]
        assert (r.no, r.nb) == (len(own), sum(x[4] for x in own)) and abs(r.dr - r.nb / r.no) < 1e-12
        node = next(n for n, text in label.items() if text == r.leaf)
        assert r.path == " & ".join(f"{names[want[node[:i]][0]]} {'<=' if s == '0' else '>'} {want[node[:i]][1]:.4f}" for i, s in enumerate(node))


def test_forest_draws_equal_rows_apart(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 40 as double) as a", "cast(id % 40 > 25 as int) as y")
    info, out = trees.forest_leaves(df, "y", ["a"], "id", trees=3)
    got = {(r.tree, r.leaf): r for r in info.collect()}
    sizes = [sum(r.no for (t, _), r in got.items() if t == i) for i in (1, 2, 3)]
    assert len(set(sizes)) > 1 and all(1800 < n < 2200 for n in sizes)
    assert all(got[i, "L1"].path == "a <= 25.5000" and got[i, "L1"].nb == 0 and got[i, "L2"].dr == 1 for i in (1, 2, 3))
    assert out.where("(tree_1 = 'L2') <> (y = 1)").count() == 0 and out.columns == ["id", "a", "y", "tree_1", "tree_2", "tree_3"]


def test_segments(spark):
    df = spark.range(2000).selectExpr(
        "id", "case id % 4 when 0 then null when 1 then 'u' when 2 then 'v' else 'w' end as g", "cast(case when id % 4 = 2 then id % 5 < 4 else id % 5 = 0 end as int) as y", "0.3d as pd"
    )
    got = trees.segment_validation(df, "y", "pd", ["g"]).orderBy("segment").collect()
    # codes -1, 0, 1, 2: the level in the middle is the one apart
    assert [(r.rule, r.no, r.nb_obs, r.test_res) for r in got] == [
        ("g <= 0.5000", 1000, 200, "overestimate"), ("g > 0.5000 & g <= 1.5000", 500, 400, "underestimate"), ("g > 0.5000 & g > 1.5000", 500, 100, "overestimate")
    ]
    z = (0.3 - 0.2) / math.sqrt(0.2 * 0.8 / 1000)
    assert abs(got[0].p_val - 0.5 * math.erfc(z / math.sqrt(2))) < 1e-12 and abs(got[0].avg + 0.1) < 1e-9 and abs(got[0].nb_mod - 300) < 1e-6


def test_nothing_to_split(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else 1.0, i % 2) for i in range(90)], "id long, a double, y int")
    assert {r.interaction for r in trees.interaction(rows, "y", ["a"]).collect()} == {"L1", None}
    assert trees.segment_validation(rows.withColumn("pd", F.lit(0.5)), "y", "pd", ["a"]).count() == 0
    info, out = trees.interaction_leaves(rows.limit(0), "y", ["a"])
    assert info.count() == 0 and out.count() == 0
    assert exact_trees.Tree().rule("") == "root"
