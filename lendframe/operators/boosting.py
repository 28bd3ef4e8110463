"""Boosted trees grown leaf by leaf on histograms, for many groups (folds, trials) in shared aggregates.

Columns are binned once: numbers at exact quantiles, categories by level; bin 0 is for missing values. Each round of a tree is one
pass over the rows: tasks add up gradients and Hessians of the asked nodes by feature and bin, Spark sums them, and the driver,
which only ever sees these histograms, finds the splits. The best leaf of a tree is split first. So that a tree takes as many
passes as it is deep, and not one a split, the smaller child of every leaf that may be split is asked for in the same pass; the
larger one is the parent less the smaller. A split sends each bin to a side: numbers by a threshold, categories by a cut in the
order of their gradient ratios, missing values to the side that gains more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.scratch import release, ship, stored
from lendframe.operators import folded, quantiles

BINS = 64
#: Levels of a category with a bin of their own, the most frequent ones; the others share the last bin.
LEVELS = BINS - 2
STORE_EVERY = 10


@dataclass(frozen=True)
class Params:
    """``leaves``: most leaves of a tree. ``subsample`` and ``columns``: shares of rows and columns drawn for each tree."""

    trees: int = 50
    leaves: int = 31
    depth: int = 6
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    least_rows: int = 20
    subsample: float = 1.0
    columns: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in order of making; ``left`` is -1 at leaves, ``goes_left`` says it for each bin of the node's feature."""

    feature: list[int] = field(default_factory=lambda: [0])
    goes_left: list[np.ndarray] = field(default_factory=lambda: [np.zeros(BINS, dtype=bool)])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, goes_left: np.ndarray, gain: float) -> tuple[int, int]:
        self.feature[node], self.goes_left[node], self.gain[node] = feature, goes_left, gain
        self.left[node], self.right[node] = len(self.left), len(self.left) + 1
        for _ in range(2):
            self.feature.append(0)
            self.goes_left.append(np.zeros(BINS, dtype=bool))
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(0.0)
            self.gain.append(0.0)
        return self.left[node], self.right[node]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """bins: rows by features."""
        at = np.zeros(len(bins), dtype=np.int64)
        feature, table, left, right = np.array(self.feature), np.stack(self.goes_left), np.array(self.left), np.array(self.right)
        inner = np.flatnonzero(left[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = np.where(table[node, bins[inner, feature[node]]], left[node], right[node])
            inner = inner[left[at[inner]] >= 0]
        return at


@dataclass(frozen=True)
class Binning:
    """How values become bins: ``edges`` (group, column) for numbers, ``levels`` (column) for categories."""

    numeric: list[str]
    categorical: list[str]
    edges: dict[tuple[int, str], np.ndarray]
    levels: dict[str, dict[str, int]]

    def bins(self, frame, group: np.ndarray) -> np.ndarray:
        import pandas as pd

        out = np.zeros((len(frame), len(self.numeric) + len(self.categorical)), dtype=np.uint8)
        for j, c in enumerate(self.numeric):
            values = pd.to_numeric(frame[c]).to_numpy(dtype=float, na_value=np.nan)
            for g in np.unique(group):
                rows = np.flatnonzero((group == g) & ~np.isnan(values))
                out[rows, j] = 1 + np.searchsorted(self.edges.get((int(g), c), np.zeros(0)), values[rows], side="left")
        for j, c in enumerate(self.categorical, len(self.numeric)):
            known = self.levels[c]
            out[:, j] = [0 if v is None else known.get(v, BINS - 1) for v in frame[c].tolist()]
        return out


@dataclass
class Boosted:
    """Trees of each group and the log odds that they start from."""

    binning: Binning
    base: list[float]
    trees: list[list[Tree]]
    rates: list[float]

    def importance(self, group: int = 0) -> dict[str, float]:
        """The gain of all splits on a column."""
        names = [*self.binning.numeric, *self.binning.categorical]
        out = dict.fromkeys(names, 0.0)
        for tree in self.trees[group]:
            for node, left in enumerate(tree.left):
                if left >= 0:
                    out[names[tree.feature[node]]] += tree.gain[node]
        return out

    def margin(self, bins: np.ndarray, group: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            out[rows] = self.base[g] + sum(self.rates[g] * np.array(t.value)[t.leaf_of(bins[rows])] for t in self.trees[g])
        return out

    def predict(self, df: DataFrame, group: str, keep: list[str], name: str = "proba") -> DataFrame:
        """Columns ``keep`` of ``df`` and the probability by the model of each row's group."""
        ship(df.sparkSession)
        model, used = self, [group, *self.binning.numeric, *self.binning.categorical]
        schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{name} double"])

        def score(frames: Iterator) -> Iterator:
            for frame in frames:
                own = frame[f"in_{group}"].to_numpy().astype(np.int64)
                inputs = frame[[f"in_{c}" for c in used]].rename(columns=lambda c: c[3:])
                out = frame[keep].copy()
                out[name] = 1 / (1 + np.exp(-model.margin(model.binning.bins(inputs, own), own)))
                yield out

        text = lambda c: F.col(f"`{c}`").cast("string") if c in self.binning.categorical else F.col(f"`{c}`")
        return df.select(*[F.col(f"`{c}`") for c in keep], *[text(c).alias(f"in_{c}") for c in used]).mapInPandas(score, schema)


def binned(df: DataFrame, group: str, groups: int, numeric: list[str], categorical: list[str], copies: str) -> Binning:
    """Exact quantiles of each group's numbers in one query, and the most frequent levels of each category. A row counts ``copies`` times."""
    points = [i / (BINS - 1) for i in range(1, BINS - 1)]
    edges = {}
    if numeric:
        # groups by columns rows of at most ``BINS`` numbers
        for r in quantiles.exact(df, {c: F.col(f"`{c}`") for c in numeric}, points, group, times=copies).collect():
            edges[int(r[group]), r.rf] = np.unique(np.array(r.q))
    levels = {}
    for c in categorical:
        counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("v")).agg(F.sum(copies).alias("count"))
        levels[c] = {r.v: i + 1 for i, r in enumerate(counts.orderBy(F.desc("count"), "v").limit(LEVELS).collect())}
    return Binning(numeric, categorical, edges, levels)


def _shrunk(g: np.ndarray | float, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _score(g, h, p: Params):
    return _shrunk(g, p.l1) ** 2 / (h + p.l2)


def best_split(hist: np.ndarray, n_numeric: int, columns: np.ndarray, p: Params) -> tuple[float, int, np.ndarray] | None:
    """hist: features by bins by (gradient, Hessian, rows). The gain, feature and sides of the best split; ties by feature and cut."""
    best = None
    whole = hist[0].sum(axis=0)
    parent = _score(whole[0], whole[1], p)
    for j in np.flatnonzero(columns):
        h = hist[j]
        seen = np.flatnonzero(h[1:, 2] > 0) + 1
        if j >= n_numeric:
            seen = seen[np.argsort(h[seen, 0] / (h[seen, 1] + p.l2), kind="stable")]
        for missing_left in (False, True) if h[0, 2] > 0 else (False,):
            left = np.cumsum(h[seen], axis=0)
            if missing_left:
                left = np.concatenate([np.zeros((1, 3)), left]) + h[0]
            elif h[0, 2] == 0:
                left = left[:-1]
            if not len(left):
                continue
            right = whole - left
            gain = _score(left[:, 0], left[:, 1], p) + _score(right[:, 0], right[:, 1], p) - parent
            gain[(left[:, 2] < p.least_rows) | (right[:, 2] < p.least_rows)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12):
                sides = np.zeros(BINS, dtype=bool)
                cut = k - 1 if missing_left else k
                if j < n_numeric:
                    sides[1 : (seen[cut] + 1 if cut >= 0 else 1)] = True
                else:
                    sides[seen[: cut + 1]] = True
                sides[0] = missing_left
                best = (float(gain[k]), int(j), sides)
    return best


def _draw(seed: int, tree: int, ids: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row and tree."""
    x = ids.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + tree * 7_919 + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(33))) >> np.uint64(11)).astype(float) / 2.0**53


class _Growing:
    """One group's tree while it grows: histograms of its open leaves, and what has to be asked for next."""

    def __init__(self, p: Params, number: int, n_numeric: int, n_features: int) -> None:
        self.p, self.n_numeric, self.tree = p, n_numeric, Tree()
        order = np.argsort(_draw(p.seed + 1, number, np.arange(1, n_features + 1, dtype=np.uint64)))
        self.columns = np.zeros(n_features, dtype=bool)
        self.columns[order[: max(1, round(p.columns * n_features))]] = True
        self.hist: dict[int, np.ndarray] = {}
        self.splits: dict[int, tuple | None] = {}
        self.depth = {0: 0}
        self.planned: dict[int, tuple[int, int, int, int]] = {}  # leaf: its children to be, the smaller one, the larger one
        self.asked = [0]
        self.leaves, self.done = [0], False

    def take(self, hists: dict[int, np.ndarray]) -> None:
        """Histograms of what was asked; splits leaves, best first, as far as their children are known, then asks for more."""
        for node in self.asked:
            self._know(node, hists[node])
        for leaf, (_, _, small, large) in list(self.planned.items()):
            if large not in self.hist:
                self._know(large, self.hist[leaf] - self.hist[small])
        while len(self.leaves) < self.p.leaves:
            able = [(self.splits[n][0], -n) for n in self.leaves if self.splits.get(n)]
            if not able:
                break
            leaf = -max(able)[1]
            if leaf not in self.planned:
                self._plan()
                return
            left, right, _, _ = self.planned[leaf]
            self.leaves.remove(leaf)
            self.leaves += [left, right]
        self._finish()

    def _know(self, node: int, hist: np.ndarray) -> None:
        self.hist[node] = hist
        self.splits[node] = best_split(hist, self.n_numeric, self.columns, self.p) if self.depth[node] < self.p.depth else None

    def _plan(self) -> None:
        self.asked = []
        for leaf in self.leaves:
            split = self.splits.get(leaf)
            if not split or leaf in self.planned:
                continue
            gain, feature, sides = split
            left, right = self.tree.split(leaf, feature, sides, gain)
            self.depth[left] = self.depth[right] = self.depth[leaf] + 1
            n_left = self.hist[leaf][feature][sides, 2].sum()
            small, large = (left, right) if 2 * n_left <= self.hist[leaf][feature][:, 2].sum() else (right, left)
            self.planned[leaf] = (left, right, small, large)
            self.asked.append(small)

    def _finish(self) -> None:
        self.done, self.asked = True, []
        for leaf in self.leaves:
            self.tree.left[leaf] = self.tree.right[leaf] = -1
            g, h, _ = self.hist[leaf][0].sum(axis=0)
            self.tree.value[leaf] = float(-_shrunk(g, self.p.l1) / (h + self.p.l2))


def _histograms(frames: Iterator, state: dict[int, tuple], n_features: int) -> Iterator:
    """state: group -> (trees since the margins were stored, rate, tree that grows, nodes asked, number of the tree, params)."""
    import pandas as pd

    total: dict[tuple[int, int], np.ndarray] = {}
    for frame in frames:
        group = frame["g"].to_numpy()
        for g in np.unique(group):
            if int(g) not in state:
                continue
            pending, rate, tree, asked, number, p = state[int(g)]
            rows = frame[group == g]
            if p.subsample < 1:
                rows = rows[_draw(p.seed, number, rows["id"].to_numpy()) < p.subsample]
            bins = np.frombuffer(b"".join(rows["bins"]), dtype=np.uint8).reshape(-1, n_features)
            margin = rows["margin"].to_numpy() + sum(rate * np.array(t.value)[t.leaf_of(bins)] for t in pending)
            prob = 1 / (1 + np.exp(-margin))
            weight = rows["w"].to_numpy()
            grad, hess = weight * (prob - rows["y"].to_numpy()), weight * prob * (1 - prob)
            at = tree.leaf_of(bins)
            for node in asked:
                inside = np.flatnonzero(at == node)
                sums = total.setdefault((int(g), node), np.zeros((n_features, BINS, 3)))
                for j in range(n_features):
                    b = bins[inside, j]
                    for k, x in enumerate((grad, hess, weight)):
                        sums[j, :, k] += np.bincount(b, x[inside], minlength=BINS)
    out = []
    for (g, node), sums in total.items():
        j, b = np.nonzero(sums[:, :, 2])
        out.append(pd.DataFrame({"g": g, "node": node, "feature": j, "bin": b, "grad": sums[j, b, 0], "hess": sums[j, b, 1], "n": sums[j, b, 2]}))
    if out:
        yield pd.concat(out)


def fit_boosted(
    df: DataFrame, y: str, id_col: str, numeric: list[str], categorical: list[str], params: list[Params], group: str | None = None, weight: str | None = None,
    copies: str | None = None,
) -> Boosted:
    """A model for each group 0, 1, ... of the rows of ``df`` (one without ``group``), with the parameters of that number.

    A row stands for as many equal ones as ``copies`` says; they are drawn as one where a share of the rows is drawn. Where all rows
    are used, those of equal bins and y are one row of the sum of their weights. Rows with a NULL y are left out. A group without rows, or of one class, gets its log odds, within +-20, and no trees.
    """
    ship(df.sparkSession)
    groups = len(params)
    own = F.col(f"`{group}`").cast("int") if group else F.lit(0)
    times, heavy = (F.col(f"`{copies}`") if copies else F.lit(1)).cast("long"), F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    rows = df.select(
        own.alias("g"), times.alias("__copies"), F.col(f"`{y}`").cast("double").alias("y"), F.xxhash64(F.col(f"`{id_col}`")).alias("id"), (heavy * times).alias("w"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric], *[F.col(f"`{c}`").cast("string").alias(c) for c in categorical],
    ).where(F.col("y").isNotNull())
    binning = binned(rows, "g", groups, numeric, categorical, "__copies")
    base = [0.0] * groups
    usable = set()
    for r in rows.groupBy("g").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("bad")).collect():  # a row a group
        good = r.n - r.bad
        base[r.g] = math.log(r.bad / good) if r.bad and good else (20.0 if r.bad else -20.0)
        if r.bad and good:
            usable.add(r.g)

    def prepare(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            g = frame["g"].to_numpy().astype(np.int64)
            bins = binning.bins(frame, g)
            yield pd.DataFrame({"g": g, "y": frame["y"], "id": frame["id"], "w": frame["w"], "bins": [b.tobytes() for b in bins], "margin": np.array(base)[g]})

    schema = "g int, y double, id long, w double, bins binary, margin double"
    table = rows.mapInPandas(prepare, schema)
    if all(p.subsample >= 1 for p in params):
        table = table.groupBy("g", "y", "bins").agg(F.sum("w").alias("w"), F.max("margin").alias("margin")).select("g", "y", F.lit(0).cast("long").alias("id"), "w", "bins", "margin")
    return _grown(table, binning, base, usable, params, schema)


def fit_boosted_folds(table: folded.Folded, p: Params) -> tuple[Boosted, folded.Bins]:
    """A model for each fold, of all rows of the other folds, with equal parameters; and how a fold's values become bins."""
    if p.subsample < 1:
        raise ValueError("a share of the rows is drawn from single rows, see fit_boosted")
    k = table.k
    edges = {key: np.unique(np.array(q)) for key, q in table.others([i / (BINS - 1) for i in range(1, BINS - 1)], with_y=True).items()}
    levels, codes = {}, []
    for i, (c, own) in enumerate(zip(table.categorical, table.levels)):
        counts = {r.at: r.n for r in table.rows.where(F.col("y").isNotNull()).groupBy(F.col(f"c{i}").alias("at")).agg(F.sum("n").alias("n")).collect()}  # a row a level
        common = sorted((v for at, v in enumerate(own) if v is not None and at in counts), key=lambda v: (-counts[own.index(v)], v))
        levels[c] = {v: at + 1 for at, v in enumerate(common[:LEVELS])}
        codes.append(np.array([0 if v is None else levels[c].get(v, BINS - 1) for v in own] + [0], dtype=np.uint8))
    bins = folded.Bins(table.caps, table.numeric, edges, codes)
    base, usable = [0.0] * k, set()
    for g in range(k):
        good, bad = table.goods.sum() - table.goods[g], table.bads.sum() - table.bads[g]
        if good or bad:
            base[g] = math.log(bad / good) if bad and good else (20.0 if bad else -20.0)
        if good and bad:
            usable.add(g)
    spark = table.rows.sparkSession
    start = F.get(F.array(*[F.lit(float(b)) for b in base]), F.col("g"))
    rows = folded.counted_bins(table, bins).select("g", "y", F.lit(0).cast("long").alias("id"), "w", "bins", start.alias("margin"))
    # a batch of rows of one fold is added up at once
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g", "y", F.pmod(F.xxhash64("bins"), F.lit(2))).sortWithinPartitions("g")
    schema = "g int, y double, id long, w double, bins binary, margin double"
    return _grown(dealt, Binning(table.numeric, table.categorical, edges, levels), base, usable, [p] * k, schema, few=True), bins


def _grown(table: DataFrame, binning: Binning, base: list[float], usable: set[int], params: list[Params], schema: str, few: bool = False) -> Boosted:
    """The trees of all groups, round by round. ``few``: a handful of tasks hold a group, whose sums the driver adds up."""
    n_features = len(binning.numeric) + len(binning.categorical)
    table = stored(table, "boosting-rows")
    # distinct rows of few bins fill one partition: its one task needs no shuffle
    single = few or table.rdd.getNumPartitions() == 1
    trees: list[list[Tree]] = [[] for _ in params]
    since = 0
    for number in range(max(p.trees for p in params)):
        growing = {g: _Growing(params[g], number, len(binning.numeric), n_features) for g in usable if number < params[g].trees and n_features}
        while open_ := {g: t for g, t in growing.items() if not t.done}:
            state = {g: (trees[g][since:], params[g].rate, t.tree, t.asked, number, params[g]) for g, t in open_.items()}
            parts = table.mapInPandas(lambda f, s=state: _histograms(f, s, n_features), "g int, node int, feature int, bin int, grad double, hess double, n double")
            hists = {(g, node): np.zeros((n_features, BINS, 3)) for g, t in open_.items() for node in t.asked}
            # at most groups by open leaves by features by bins rows; a task's own are summed up already
            sums = (parts if single else parts.groupBy("g", "node", "feature", "bin").agg(F.sum("grad").alias("grad"), F.sum("hess").alias("hess"), F.sum("n").alias("n"))).toPandas()
            for (g, node), part in sums.groupby(["g", "node"]):
                np.add.at(hists[g, node], (part["feature"].to_numpy(), part["bin"].to_numpy()), part[["grad", "hess", "n"]].to_numpy())
            for g, t in open_.items():
                t.take({node: hists[g, node] for node in t.asked})
        for g, t in growing.items():
            trees[g].append(t.tree)
        if (number + 1) % STORE_EVERY == 0 and number + 1 < max(p.trees for p in params):
            news = {g: (trees[g][since:], params[g].rate) for g in usable}
            before, table = table, stored(table.mapInPandas(lambda f, s=news: _moved(f, s, n_features), schema), "boosting-rows")
            release(before)
            single = few or table.rdd.getNumPartitions() == 1
            since = number + 1
    release(table)
    return Boosted(binning, base, trees, [p.rate for p in params])


def _moved(frames: Iterator, news: dict[int, tuple], n_features: int) -> Iterator:
    """Margins brought up to date."""
    for frame in frames:
        bins = np.frombuffer(b"".join(frame["bins"]), dtype=np.uint8).reshape(-1, n_features)
        group, margin = frame["g"].to_numpy(), frame["margin"].to_numpy().copy()
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            own, rate = news.get(int(g), ([], 0.0))
            margin[rows] += sum(rate * np.array(t.value)[t.leaf_of(bins[rows])] for t in own)
        yield frame.assign(margin=margin)
