"""Trees that try every cut between two distinct values, many trees and nodes in shared aggregates.

Trees of one column grow on the sums at each value, which are dealt to slices of ascending values. For trees of several columns the
rows are sorted once by each column, in parts of ascending values. Running sums over the totals of slices or parts, then inside
each, give both sides of every cut. No task holds a column; the totals of the parts and the best cut of each open node reach the
driver. The gain is the fall of the squared error, which for a target of 0 and 1 is half that of the Gini impurity. Sums are of
whole numbers or decimals, so that they, and the choice among equal gains (first column, lowest cut), don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from lendframe.functions.scratch import release, ship, stored
from lendframe.functions.special import clean, is_numeric
from lendframe.operators.quantiles import below, sliced
from lendframe.operators.woe import MAPPED_LEVELS

#: Gains up to this are none.
LEAST_GAIN = 1e-9


@dataclass
class Tree:
    """``splits``: (column, cut) of each inner node; a node's name is its way from the root, 0 for left (<= cut) and 1 for right."""

    splits: dict[str, tuple[str, float]] = field(default_factory=dict)

    def leaves(self) -> list[str]:
        """From left to right."""
        return sorted(n + side for n in self.splits for side in "01" if n + side not in self.splits) or [""]

    def rule(self, node: str) -> str:
        parts = []
        for i, side in enumerate(node):
            name, cut = self.splits[node[:i]]
            parts.append(f"{name} {'<=' if side == '0' else '>'} {cut:.4f}")
        return " & ".join(parts) or "root"

    def labels(self) -> dict[str, str]:
        return {leaf: f"L{i}" for i, leaf in enumerate(self.leaves(), 1)}

    def place(self, columns: dict[str, Column], names: dict[str, str | float] | None = None, node: str = "") -> Column:
        """The node of a row whose columns are not NULL, by its name or as ``names`` calls it (a name or a number)."""
        if node not in self.splits:
            return F.lit((names or {}).get(node, node))
        name, cut = self.splits[node]
        return F.when(columns[name] <= F.lit(cut), self.place(columns, names, node + "0")).otherwise(self.place(columns, names, node + "1"))


def whole(columns: dict) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns.values()])


def levels(df: DataFrame, name: str) -> list[str]:
    """The sorted levels of a text column, which go into the plan; too many are refused."""
    value = clean(df, name).cast("string")
    known = [r[0] for r in df.select(value).where(value.isNotNull()).distinct().limit(MAPPED_LEVELS + 1).collect()]
    if len(known) > MAPPED_LEVELS:
        raise ValueError(f"{name} has over {MAPPED_LEVELS} levels")
    return sorted(known)


def dummies(df: DataFrame, factors: list[str]) -> dict[str, Column]:
    """Numbers as they are; a text column as one 0/1 column ``name_level`` for each level but the first. NaN is NULL."""
    out = {c: clean(df, c) for c in factors if is_numeric(df, c)}
    for c in factors:
        if c not in out:
            out |= {f"{c}_{level}": (clean(df, c) == level).cast("double") for level in levels(df, c)[1:]}
    return out


def codes(df: DataFrame, factors: list[str], missing: float | None = None) -> dict[str, Column]:
    """Numbers as they are; a text column as the place of its level from 0, and ``missing`` for NULL."""
    out = {}
    for c in factors:
        out[c] = clean(df, c)
        if not is_numeric(df, c):
            place = F.array_position(F.array(*[F.lit(v) for v in levels(df, c)]).cast("array<string>"), out[c]).cast("double") - 1
            out[c] = F.coalesce(place, F.lit(missing).cast("double"))
    return out


def best_cuts(cells: DataFrame, least: list[int], distinct: bool = False) -> DataFrame:
    """cells: (tree, node, at, v, n, s0, s1, ...), ``n`` rows with the sums of the targets. One row (tree, node, at, cut) for each
    node that some cut improves, with the tree's ``least`` rows or more on both sides. ``distinct``: a value is one row already."""
    key, sums = ["tree", "node", "at"], [c for c in cells.columns if c[0] == "s"]
    counted = [F.sum(c).alias(c) for c in ("n", *sums)]
    # as many slices a key as a shuffle has tasks
    slices = max(8, min(1024, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = sliced(cells if distinct else cells.groupBy(*key, "v").agg(*counted), key, slices)
    along, all_of = Window.partitionBy(*key).orderBy("slice"), Window.partitionBy(*key)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # as many rows a key as there are slices
    totals = rows.groupBy(*key, "slice").agg(*counted, F.min("v").alias("first")).select(
        *key, "slice", F.lead("first").over(along).alias("first_after"),
        *[c for name in ("n", *sums) for c in (F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"{name}_before"), F.sum(name).over(all_of).alias(f"{name}_all"))],
    )
    inside = Window.partitionBy(*key, "slice").orderBy("v")
    left = {c: F.col(f"{c}_before") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in ("n", *sums)}
    run = rows.join(totals, [*key, "slice"]).select(
        *key, "v", F.coalesce(F.lead("v").over(inside), "first_after").alias("after"), left["n"].alias("n_left"), (F.col("n_all") - left["n"]).alias("n_right"), "n_all",
        *[c.cast("double").alias(f"{name}_{side}") for name in sums for side, c in (("left", left[name]), ("right", F.col(f"{name}_all") - left[name]), ("all", F.col(f"{name}_all")))],
    )
    middle, enough = (F.col("v") + F.col("after")) / 2, F.array(*[F.lit(n) for n in least])[F.col("tree")]
    part = lambda name, side: F.col(f"{name}_{side}") * F.col(f"{name}_{side}") / F.col(f"n_{side}")
    tried = run.where(F.col("after").isNotNull() & (F.col("n_left") >= enough) & (F.col("n_right") >= enough)).select(
        # between neighbouring or endless values there is no middle
        *key, "v", F.when(middle >= F.col("after"), F.col("v")).otherwise(middle).alias("cut"),
        reduce(lambda x, y: x + y, [part(c, "left") + part(c, "right") - part(c, "all") for c in sums]).alias("gain"),
    )
    best = F.max_by(F.struct("at", "cut"), F.struct("gain", -F.col("at"), -F.col("v"))).alias("best")
    return tried.where(F.col("gain") > LEAST_GAIN).groupBy("tree", "node").agg(best).select("tree", "node", "best.*")


def grow(
    df: DataFrame, target: Column | list[list[Column]], columns: list[dict[str, Column]], least: int | list[int], max_depth: int | None = None, weights: list[Column] | None = None,
    leaves: dict | None = None,
) -> list[Tree]:
    """One tree for each set of numeric ``columns``, all grown level by level together.

    ``target`` holds whole numbers or decimals; it is one column, or a list of columns of one type for each tree, whose errors add
    up (0/1 columns of classes: Gini). ``weights`` (whole numbers) say how often a row is in a tree's sample. Rows with a NULL in
    a tree's target or columns aren't in its sample. Without ``max_depth`` trees grow as long as a cut leaves ``least`` rows (a
    number for all or for each tree) on both sides. ``leaves`` is filled with (n, s0, s1, ...) by (tree, leaf), where all trees have
    one column. What is needed is written once to the shared folder, so that levels don't
    derive it again.
    """
    targets = target if isinstance(target, list) else [[target]] * len(columns)
    place: dict[int, str] = {}
    kept = []
    for c in [*(c for own in columns for c in own.values()), *(c for own in targets for c in own), *(weights or [])]:
        if id(c) not in place:
            place[id(c)] = f"x{len(place)}"
            kept.append(c.alias(place[id(c)]))
    stored_as = lambda c: F.col(place[id(c)])
    least = [max(1, n) for n in (least if isinstance(least, list) else [least] * len(columns))]
    goals, times = [[stored_as(c) for c in own] for own in targets], [stored_as(w).cast("long") for w in weights or []]
    if columns and all(len(own) == 1 for own in columns):
        (names, values) = zip(*[next((name, place[id(c)]) for name, c in own.items()) for own in columns])
        # a tree of one column needs no more than the sums at each value
        narrow = stored(_value_sums(df.select(*kept), goals, list(values), times), "tree-values")
        try:
            trees = _levels_of_values(narrow, list(names), max(map(len, targets)), least, max_depth)
            if leaves is not None:
                leaves.update(_leaf_sums(narrow, trees, max(map(len, targets))))
            return trees
        finally:
            release(narrow)
    narrow = stored(df.select(*kept), "tree-cells")
    try:
        return _levels(narrow, goals, [{name: stored_as(c) for name, c in own.items()} for own in columns], least, max_depth, times)
    finally:
        release(narrow)


def _value_sums(df: DataFrame, targets: list[list[Column]], values: list[str], weights: list[Column]) -> DataFrame:
    """(tree, v, n, s0, s1, ...) of trees of one column each: the sums at each value. Trees of one column share its rows."""
    width, by = max(map(len, targets)), {}
    for t, v in enumerate(values):
        by.setdefault(v, []).append(t)
    slots = max(map(len, by.values()))
    cells = []
    for v, own in by.items():
        fields = []
        for j in range(slots):
            # a column of fewer trees than another has slots of nothing
            t = own[min(j, len(own) - 1)]
            times = weights[t] if weights else F.lit(1).cast("long")
            sample = whole(dict(enumerate(targets[t]))) & (times > 0) if j < len(own) else F.lit(False)
            fields.append(F.when(sample, times).alias(f"n_{j}"))
            for i in range(width):
                goal = targets[t][i] if i < len(targets[t]) else targets[t][0] * 0
                fields.append(F.when(sample, goal * times if weights else goal).alias(f"s{i}_{j}"))
        cells.append(F.struct(F.lit(own).alias("trees"), F.col(v).cast("double").alias("v"), *fields))
    sums = [f"{c}_{j}" for j in range(slots) for c in ("n", *[f"s{i}" for i in range(width)])]
    counted = df.select(F.inline(F.array(*cells))).where("v is not null").groupBy("trees", "v").agg(*[F.sum(c).alias(c) for c in sums])
    apart = F.array(*[F.struct(F.get("trees", F.lit(j)).alias("tree"), F.col(f"n_{j}").alias("n"), *[F.col(f"s{i}_{j}").alias(f"s{i}") for i in range(width)]) for j in range(slots)])
    return counted.select("v", F.inline(apart)).where("n > 0")


def _placed(sums: DataFrame, ranges: list[tuple]) -> DataFrame:
    """ranges: (tree, cuts, names of the nodes between them). Adds ``node`` to the rows of these trees."""
    # a row a tree
    table = sums.sparkSession.createDataFrame(ranges, "e_tree int, edges array<double>, nodes array<string>")
    joined = sums.join(F.broadcast(table), F.col("tree") == F.col("e_tree"))
    return below(joined, "edges", "v", max(len(cuts) for _, cuts, _ in ranges), "__at").withColumn("node", F.get("nodes", F.col("__at")))


def _leaf_sums(sums: DataFrame, trees: list[Tree], width: int) -> dict[tuple[int, str], tuple]:
    placed = _placed(sums, [(t, sorted(c for _, c in tree.splits.values()), tree.leaves()) for t, tree in enumerate(trees)])
    found = placed.groupBy("tree", "node").agg(*[F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(width)])]).collect()  # leaves
    return {(r.tree, r.node): tuple(r)[2:] for r in found}


def _levels_of_values(sums: DataFrame, names: list[str], width: int, least: list[int], max_depth: int | None) -> list[Tree]:
    """``_levels`` on the table of ``_value_sums``: a node is a range of values."""
    trees, depth = [Tree() for _ in names], 0
    open_nodes = {(t, "") for t in range(len(names))}
    while open_nodes and (max_depth is None or depth < max_depth):
        ranges = [(t, sorted(c for _, c in tree.splits.values()), [n if (t, n) in open_nodes else None for n in tree.leaves()]) for t, tree in enumerate(trees) if any(own == t for own, _ in open_nodes)]
        cells = _placed(sums, ranges).where("node is not null").select("tree", "node", F.lit(0).alias("at"), "v", "n", *[f"s{i}" for i in range(width)])
        found = best_cuts(cells, least, distinct=True).collect()
        open_nodes = set()
        for r in found:  # one row a node
            trees[r.tree].splits[r.node] = (names[r.tree], float(r.cut))
            open_nodes |= {(r.tree, r.node + "0"), (r.tree, r.node + "1")}
        depth += 1
    return trees


def _levels(df: DataFrame, targets: list[list[Column]], columns: list[dict[str, Column]], least: list[int], max_depth: int | None, weights: list[Column]) -> list[Tree]:
    """Trees of several columns. The rows are sorted once by each column, and a level is two passes over them that no shuffle follows:
    the totals of the open nodes in each part, then every cut inside the parts."""
    trees, depth = [Tree() for _ in columns], 0
    open_nodes = {(t, "") for t, own in enumerate(columns) if own}
    if not open_nodes or max_depth == 0:
        return trees
    ship(df.sparkSession)
    plan, rows = _sorted(df, targets, columns, weights)
    rows.persist(StorageLevel.DISK_ONLY)
    try:
        while open_nodes and (max_depth is None or depth < max_depth):
            state = [(t, trees[t].splits, sorted(n for own, n in open_nodes if own == t)) for t in sorted({t for t, _ in open_nodes})]
            # a row for each part, open node and column
            parts = rows.mapInArrow(lambda b, s=state: _part_totals(b, plan, s), "part int, tree int, node string, at int, first double, sums array<long>").collect()
            begun = _before(parts)
            cuts = rows.mapInArrow(lambda b, s=state: _part_cuts(b, plan, s, begun, least), "tree int, node string, at int, v double, cut double, gain double")
            best = F.max_by(F.struct("at", "cut"), F.struct("gain", -F.col("at"), -F.col("v"))).alias("best")
            found = cuts.groupBy("tree", "node").agg(best).select("tree", "node", "best.*").collect()
            open_nodes = set()
            for r in found:  # one row a node
                trees[r.tree].splits[r.node] = (list(columns[r.tree])[r.at], float(r.cut))
                open_nodes |= {(r.tree, r.node + "0"), (r.tree, r.node + "1")}
            depth += 1
    finally:
        rows.unpersist()
    return trees


@dataclass(frozen=True)
class _Plan:
    """Where a tree finds what it needs in a sorted row: ``columns`` its (name, number of the value column), ``goals`` its targets' numbers."""

    columns: list[list[tuple[str, int]]]
    goals: list[list[int]]
    weighted: bool
    scales: list[int | None]

    def width(self) -> int:
        """Numbers of a running total: the weight, and two for each target."""
        return 1 + 2 * max(map(len, self.goals))


#: Decimals are summed in two whole numbers, the upper one in units of this.
UPPER = 10**9


def _sorted(df: DataFrame, targets: list[list[Column]], columns: list[dict[str, Column]], weights: list[Column]) -> tuple[_Plan, DataFrame]:
    """(part, col, v, x0, x1, ..., g0, l0, ..., w0, ...): each row once for each value column that it has a value in. Parts hold ascending
    ranges of (col, v); equal values may lie in several parts, so that none of them must hold a frequent value alone."""
    place: dict[str, int] = {}
    goal_at: dict[str, int] = {}
    values, goals = [], []
    for c in (c for own in columns for c in own.values()):
        if str(c) not in place:
            place[str(c)] = len(values)
            values.append(c.cast("double"))
    for c in (c for own in targets for c in own):
        if str(c) not in goal_at:
            goal_at[str(c)] = len(goals)
            goals.append(c)
    types = [f.dataType for f in df.select(*goals).schema]
    scales = [t.scale if isinstance(t, DecimalType) else None for t in types]
    cells = [c.alias(f"x{i}") for i, c in enumerate(values)]
    for i, (c, scale) in enumerate(zip(goals, scales)):
        if scale is None:
            cells += [F.lit(0).cast("long").alias(f"g{i}"), c.cast("long").alias(f"l{i}")]
        else:
            units = (c.cast(f"decimal(38,{scale})") * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("decimal(38,0)")
            upper = F.floor(units / UPPER).cast("long")
            cells += [upper.alias(f"g{i}"), (units - upper.cast("decimal(19,0)") * UPPER).cast("long").alias(f"l{i}")]
    cells += [w.alias(f"w{i}") for i, w in enumerate(weights)]
    n = len(values)
    each = df.select(*cells).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    # -0.0 and 0.0 are one value
    each = each.withColumn("v", F.element_at(F.array(*[f"x{i}" for i in range(n)]), F.col("col") + 1) + 0.0).where("v is not null")
    parts = n * max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = each.repartitionByRange(parts, "col", "v", F.xxhash64(*[f"x{i}" for i in range(n)], *[f"w{i}" for i in range(len(weights))])).sortWithinPartitions("col", "v")
    plan = _Plan([[(name, place[str(c)]) for name, c in own.items()] for own in columns], [[goal_at[str(c)] for c in own] for own in targets], bool(weights), scales)
    return plan, dealt.withColumn("part", F.spark_partition_id())


def _node_rows(batches: Iterator, plan: _Plan, state: list[tuple]) -> Iterator[tuple]:
    """For each batch, column and open node: (part, tree, node, at, values, numbers to be summed), rows in the order of the values."""
    for batch in batches:
        got = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        numbers = {}

        def of(name: str) -> np.ndarray:
            if name not in numbers:
                # NULLs are told by the validity of the column
                own = got[name].fill_null(0) if got[name].null_count else got[name]
                numbers[name] = own.to_numpy(zero_copy_only=False)
            return numbers[name]

        part, col, v = of("part"), of("col"), of("v")
        edges = np.flatnonzero(np.r_[True, (col[1:] != col[:-1]) | (part[1:] != part[:-1])]) if len(v) else []
        for lo, hi in zip(edges, [*edges[1:], len(v)]):
            for t, splits, nodes in state:
                ats = [at for at, (_, c) in enumerate(plan.columns[t]) if c == col[lo]]
                if not ats:
                    continue
                within = np.ones(hi - lo, bool)
                for _, c in plan.columns[t]:
                    if got[f"x{c}"].null_count:
                        within &= got[f"x{c}"].slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)
                for g in plan.goals[t]:
                    if got[f"l{g}"].null_count:
                        within &= got[f"l{g}"].slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)
                if plan.weighted:
                    within &= of(f"w{t}")[lo:hi] > 0
                where = {"": np.flatnonzero(within)}
                numbers_of = dict(plan.columns[t])
                for node in sorted(splits, key=len):
                    name, cut = splits[node]
                    inside = where.pop(node)
                    left = of(f"x{numbers_of[name]}")[lo:hi][inside] <= cut
                    where[node + "0"], where[node + "1"] = inside[left], inside[~left]
                for node in nodes:
                    inside = where[node]
                    if len(inside):
                        sums = np.zeros((len(inside), plan.width()), np.int64)
                        times = sums[:, 0] = of(f"w{t}")[lo:hi][inside] if plan.weighted else 1
                        for i, g in enumerate(plan.goals[t]):
                            for j, name in enumerate((f"g{g}", f"l{g}")):
                                if j or plan.scales[g] is not None:
                                    sums[:, 1 + 2 * i + j] = of(name)[lo:hi][inside].astype(np.int64) * times
                        for at in ats:
                            yield int(part[lo]), t, node, at, v[lo:hi][inside], sums


def _part_totals(batches: Iterator, plan: _Plan, state: list[tuple]) -> Iterator:
    import pyarrow as pa

    total: dict[tuple, list] = {}
    for part, t, node, at, v, sums in _node_rows(batches, plan, state):
        key = (part, t, node, at)
        if key in total:
            total[key][1] += sums.sum(axis=0)
        else:
            total[key] = [float(v[0]), sums.sum(axis=0)]
    names = ("part", "tree", "node", "at")
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32())
    yield pa.RecordBatch.from_arrays(
        [*[pa.array([k[i] for k in total], kind) for i, kind in enumerate(kinds)], pa.array([f for f, _ in total.values()], pa.float64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))],
        names=[*names, "first", "sums"],
    )


def _before(parts: list) -> dict[tuple, tuple]:
    """(part, tree, node, at): the totals of the parts before, those of all, and the first value of the parts after (None at the end)."""
    by: dict[tuple, list] = {}
    for r in parts:
        by.setdefault((r.tree, r.node, r.at), []).append(r)
    out = {}
    for (t, node, at), own in by.items():
        own.sort(key=lambda r: r.part)
        run = np.cumsum([r.sums for r in own], axis=0)
        for i, r in enumerate(own):
            out[r.part, t, node, at] = (run[i] - np.array(r.sums), run[-1], own[i + 1].first if i + 1 < len(own) else None)
    return out


def _doubles(plan: _Plan, t: int, sums: np.ndarray) -> list[np.ndarray]:
    """The targets' sums, exact ones rounded once."""
    out = []
    for i, g in enumerate(plan.goals[t]):
        upper, lower = sums[:, 1 + 2 * i], sums[:, 2 + 2 * i]
        if plan.scales[g] is None:
            out.append(lower.astype(float))
        else:
            out.append(((upper.astype(np.longdouble) * UPPER + lower) / np.longdouble(10 ** plan.scales[g])).astype(float))
    return out


def _part_cuts(batches: Iterator, plan: _Plan, state: list[tuple], begun: dict[tuple, tuple], least: list[int]) -> Iterator:
    """The best cut of each part, node and column. The last row seen waits until the next value of its node is known."""
    import pyarrow as pa

    waiting: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    best: dict[tuple, tuple[float, float, float]] = {}

    def try_cuts(key: tuple, v: np.ndarray, left: np.ndarray) -> None:
        """Cuts between the values v and the next ones, with the totals up to each."""
        _, t, node, at = key
        everything = begun[key][1]
        apart = np.flatnonzero((v[1:] > v[:-1]) | (np.isnan(v[1:]) & ~np.isnan(v[:-1])))
        left = left[apart]
        enough = (left[:, 0] >= least[t]) & (everything[0] - left[:, 0] >= least[t])
        apart, left = apart[enough], left[enough]
        if not len(apart):
            return
        n, gain = everything[0], np.zeros(len(apart))
        sides = zip(_doubles(plan, t, left), _doubles(plan, t, everything - left), _doubles(plan, t, everything[None]))
        for one, two, both in sides:
            gain = gain + (one * one / left[:, 0] + two * two / (n - left[:, 0]) - both * both / n)
        k = int(np.argmax(gain))
        if gain[k] > LEAST_GAIN and (key not in best or gain[k] > best[key][2]):
            low, after = float(v[apart[k]]), float(v[apart[k] + 1])
            middle = (low + after) / 2
            # between neighbouring or endless values there is no middle
            best[key] = (low, middle if middle < after else low, float(gain[k]))

    for part, t, node, at, v, sums in _node_rows(batches, plan, state):
        key = (part, t, node, at)
        v_before, total = waiting.get(key, (v[:0], begun[key][0][None]))
        left = total[-1] + np.cumsum(sums, axis=0)
        try_cuts(key, np.concatenate([v_before, v]), np.concatenate([total, left])[-len(v) - len(v_before) :])
        waiting[key] = (v[-1:], left[-1:])
    for key, (v, total) in waiting.items():
        if begun[key][2] is not None:
            try_cuts(key, np.concatenate([v, [begun[key][2]]]), total)
    keys = list(best)
    kinds = {"tree": pa.int32(), "node": pa.string(), "at": pa.int32()}
    yield pa.RecordBatch.from_arrays(
        [*[pa.array([k[i + 1] for k in keys], kind) for i, kind in enumerate(kinds.values())], *[pa.array([best[k][i] for k in keys], pa.float64()) for i in range(3)]], names=[*kinds, "v", "cut", "gain"]
    )
