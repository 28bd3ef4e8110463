"""Fits and areas of all folds at once on a table that holds equal rows of a fold once, and no row for each fold that trains on it.

A fold's training rows are those of the other folds, with numbers capped by these rows' fences: tasks make them while they read a
row, so that a pass costs one reading of the table whatever the folds and trials are. Areas under the curve are exact: tasks cut
their scores into slices, a slice is ordered by one task, and the driver adds up a row for each slice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.scratch import ship, stored
from lendframe.operators import quantiles
from lendframe.operators.glm import Logit, _newton

#: Distinct rows whose scores a slice holds, about, and rows of which a task cuts the scores at once.
SLICE, BUFFER = 200_000, 200_000
#: Rows that the edges of the slices are taken from. They say how even the slices are, and nothing else.
EDGE_ROWS = 20_000


@dataclass
class Folded:
    """``rows``: fold, y, n, the numbers x0, x1, ... (a NaN is infinite) and the codes c0, c1, ... of the categories' levels.

    ``levels`` of each category in order, NULL last; ``caps`` and the sizes of slices by fold.
    """

    rows: DataFrame
    k: int
    numeric: list[str]
    categorical: list[str]
    levels: list[list[str | None]]
    caps: np.ndarray
    size: int
    goods: np.ndarray
    bads: np.ndarray

    @property
    def inputs(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.numeric))] + [f"c{i}" for i in range(len(self.categorical))]

    def others(self, points: list[float], with_y: bool = False) -> dict[tuple[int, str], list[float]]:
        """Quantiles of each fold's capped training values, by fold and column."""
        rows = self.rows.where(F.col("y").isNotNull()) if with_y else self.rows
        found = quantiles.of_others(rows, "fold", self.k, {c: F.col(f"x{i}") for i, c in enumerate(self.numeric)}, points, "n", {(g, c): self.caps[g, i] for g in range(self.k) for i, c in enumerate(self.numeric)})
        return found


def folded(rows: DataFrame, y: str, numeric: list[str], categorical: list[str], k: int, most: int) -> Folded | None:
    """The table of ``rows`` with their ``fold``; None if a category has over ``most`` levels."""
    levels = []
    for c in categorical:
        own = [r.v for r in rows.select(F.col(f"`{c}`").cast("string").alias("v")).distinct().limit(most + 1).collect()]
        if len(own) > most:
            return None
        levels.append(sorted(own, key=lambda v: (v is None, v)))
    spark = rows.sparkSession
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(math.inf))
    named = [F.col("fold").cast("int").alias("fold"), F.col(f"`{y}`").cast("double").alias("y"), *[number(c).alias(f"x{i}") for i, c in enumerate(numeric)]]
    made = rows.select(*named, *[coded(c, own).alias(f"c{i}") for i, (c, own) in enumerate(zip(categorical, levels))])
    cells = made.groupBy(*made.columns).agg(F.count(F.lit(1)).cast("double").alias("n"))
    dealt = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *[c for c in cells.columns if c not in ("n", "y")])
    table = stored(dealt, "folded")
    sizes = {r.fold: r for r in table.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.when(F.col("y") == v, F.col("n")).otherwise(0.0)).alias(f"y{v}") for v in (0, 1)]).collect()}  # a row a fold
    fences = quantiles.of_others(table, "fold", k, {c: F.when(F.col(f"x{i}") != math.inf, F.col(f"x{i}")) for i, c in enumerate(numeric)}, [0.25, 0.75], "n")
    caps = np.full((k, len(numeric)), np.inf)
    for (g, c), (low, high) in fences.items():
        caps[g, numeric.index(c)] = high + 1.5 * (high - low)
    of = lambda name: np.array([getattr(sizes[g], name) if g in sizes else 0.0 for g in range(k)])
    return Folded(table, k, list(numeric), list(categorical), levels, caps, max([0, *(r.rows for r in sizes.values())]), of("y0"), of("y1"))


def coded(column: str, levels: list[str | None]) -> F.Column:
    """The place of a level in ``levels``, of which NULL is the last."""
    known = [(v, i) for i, v in enumerate(levels) if v is not None]
    none = F.lit(len(known)).cast("int")
    if not known:
        return none
    table = F.create_map(*[F.lit(x) for pair in known for x in pair])
    return F.coalesce(table[F.col(f"`{column}`").cast("string")], none).cast("int")


def _arrays(batch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


@dataclass
class Design:
    """Standardised capped numbers, scaled by each fold's training rows, and dummies of all levels."""

    table: Folded
    means: np.ndarray
    spreads: np.ndarray
    names: list[str]

    def columns(self, g: int, numbers: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for i, v in enumerate(numbers):
            scaled = (np.minimum(v, self.caps[g, i]) - self.means[g, i]) / self.spreads[g, i]
            out.append(np.where(np.isnan(scaled), 0.0, scaled))
        return out

    @property
    def caps(self) -> np.ndarray:
        return self.table.caps

    def without_rows(self) -> Design:
        """What tasks need."""
        t = self.table
        return Design(Folded(None, t.k, t.numeric, t.categorical, t.levels, t.caps, t.size, t.goods, t.bads), self.means, self.spreads, self.names)

    def matrix(self, g: int, inputs: list[np.ndarray]) -> np.ndarray:
        """Coefficients by rows: ones, the numbers and the dummies."""
        p = len(self.table.numeric)
        codes = [np.arange(len(own))[:, None] == c[None, :] for own, c in zip(self.table.levels, inputs[p:])]
        return np.vstack([np.ones((1, len(inputs[0]))), *[v[None, :] for v in self.columns(g, inputs[:p])], *codes])

    def probabilities(self, g: int, inputs: list[np.ndarray], betas: np.ndarray) -> np.ndarray:
        """betas: fits by coefficients. Fits by rows; added up value by value in one order, so that equal rows have equal scores."""
        p, rows = len(self.table.numeric), len(inputs[0]) if inputs else 0
        columns, out = self.columns(g, inputs[:p]), []
        for beta in betas:
            at, line = 1 + p, np.full(rows, beta[0])
            for i, v in enumerate(columns):
                line += beta[1 + i] * v
            for own, c in zip(self.table.levels, inputs[p:]):
                line += beta[at : at + len(own)][c]
                at += len(own)
            with np.errstate(over="ignore"):
                out.append(1 / (1 + np.exp(-line)))
        return np.array(out)

    def scores(self, fits: list[list[Logit | None]]) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        """For ``areas``: the probabilities of the fits of each ridge and fold; those of a fold without a fit are one half."""
        lean, none = self.without_rows(), [0.0] * (len(self.names) + 1)
        betas = np.array([[[f.intercept, *f.coefficients.values()] if f else none for f in own] for own in fits])
        return lambda g, inputs: lean.probabilities(g, inputs, betas[:, g])


def design(table: Folded) -> Design:
    """Means first, then the spreads about them."""
    ship(table.rows.sparkSession)
    k, p = table.k, len(table.numeric)
    names = [f"{c}__scaled" for c in table.numeric] + [f"{c}__{'NULL' if v is None else v}" for c, own in zip(table.categorical, table.levels) for v in own]
    means, spreads = np.zeros((k, p)), np.ones((k, p))
    numbers, caps = table.rows.select("fold", "n", *table.inputs[:p]), table.caps

    def sums(batches: Iterator, about: np.ndarray | None) -> Iterator:
        import pyarrow as pa

        total = np.zeros((k, p, 2))
        for batch in batches:
            fold, n, *xs = _arrays(batch)
            for g in range(k):
                w = n * (fold != g)
                for i, x in enumerate(xs):
                    v = np.minimum(x, caps[g, i])
                    there = ~np.isnan(v)
                    v, own = v[there], w[there]
                    total[g, i] += [own.sum(), own @ v if about is None else own @ ((v - about[g, i]) ** 2)]
        g, i = (a.ravel() for a in np.indices((k, p)))
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(i, pa.int32()), pa.array(total[:, :, 0].ravel()), pa.array(total[:, :, 1].ravel())], names=["g", "i", "n", "v"])

    if p:
        for about, out in ((None, means), (means, spreads)):
            got = numbers.mapInArrow(lambda b, a=about: sums(b, a), "g int, i int, n double, v double").groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
            for r in got:  # folds by columns rows
                mean = r.v / r.n if r.n else 0.0
                out[r.g, r.i] = mean if about is None else (math.sqrt(mean) or 1.0)
    return Design(table, means, spreads, names)


def fit_ridges(made: Design, ridges: list[float], rounds: int = 25, start: dict[tuple[int, int], np.ndarray] | None = None) -> list[list[Logit | None]]:
    """A logit for each ridge and each fold, whose training rows are those of the other folds; a Newton step of all is one pass.

    ``start``: coefficients that a (ridge's number, fold) begins at, else zeros.
    """
    table, names = made.table, made.names
    k, width = table.k, len(names) + 1
    ship(table.rows.sparkSession)
    rows, lean = table.rows.where(F.col("y").isNotNull()).select("fold", "y", "n", *table.inputs), made.without_rows()
    upper = np.triu_indices(width)
    # with the rows of one fold only there is nothing to train it on
    having = [g for g in range(k) if (table.goods + table.bads).sum() > (table.goods + table.bads)[g]]

    def run(betas: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], tuple]:
        asked: dict[int, list[int]] = {}
        for i, g in betas:
            asked.setdefault(g, []).append(i)
        tables = {g: (own, np.array([betas[i, g] for i in own])) for g, own in asked.items()}
        parts = rows.mapInArrow(lambda b: _moments(b, lean, tables), "fit int, g int, at int, v double")
        # fits by cross-products rows
        got = parts.groupBy("fit", "g", "at").agg(F.sum("v").alias("v")).toPandas()
        out = {}
        for (i, g), own in got.groupby(["fit", "g"]):
            row = np.zeros(len(upper[0]) + width + 3)
            row[own["at"]] = own["v"]
            info = np.zeros((width, width))
            info[upper] = row[: len(upper[0])]
            out[int(i), int(g)] = (info + np.triu(info, 1).T, row[len(upper[0]) : -3], row[-3], row[-2], row[-1] / row[-2] if row[-2] else 0.0)
        return out

    fits = _newton(run, {(i, g): r for i, r in enumerate(ridges) for g in having}, names, rounds, start)
    return [[fits.get((i, g)) for g in range(k)] for i in range(len(ridges))]


def _moments(batches: Iterator, made: Design, tables: dict[int, tuple[list[int], np.ndarray]]) -> Iterator:
    """tables: fold -> (numbers of its fits, their coefficients). Cross-products, gradients, deviance, rows and bads of each fit."""
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        fold, y, n, *inputs = _arrays(batch)
        for g, (_, betas) in tables.items():
            w = n * (fold != g)
            x = made.matrix(g, inputs)
            i, j = np.triu_indices(len(x))
            with np.errstate(over="ignore"):
                p = np.clip(1 / (1 + np.exp(-(betas @ x))), 1e-12, 1 - 1e-12)
            q = 1 - p
            deviance = -2 * (np.log(np.where(y == 1, p, q)) @ w)
            ends = np.tile([w.sum(), (w * y).sum()], (len(p), 1))
            total[g] = total.get(g, 0) + np.hstack([(w * (p * q)) @ (x[i] * x[j]).T, (w * (y - p)) @ x.T, deviance[:, None], ends])
    for g, sums in total.items():
        fits, width = sums.shape
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(tables[g][0], width), pa.int32()), pa.array(np.full(fits * width, g), pa.int32()), pa.array(np.tile(np.arange(width), fits), pa.int32()), pa.array(sums.ravel(), pa.float64())],
            names=["fit", "g", "at", "v"],
        )


def edge_rows(table: Folded) -> list[np.ndarray]:
    """Inputs of some rows, drawn by their hash, for the edges of the slices."""
    keys = ["fold", *table.inputs]
    share = max(1, table.size * table.k // EDGE_ROWS)
    got = table.rows.select(*keys).where(F.pmod(F.xxhash64(*keys), F.lit(share)) == 0).limit(4 * EDGE_ROWS).toPandas()
    return [got[c].to_numpy() for c in table.inputs]


def areas(table: Folded, drawn: list[np.ndarray], score: Callable[[int, list[np.ndarray]], np.ndarray]) -> dict[tuple[int, int], tuple[float, float]]:
    """AUC (ties one half) and KS of each fit and fold, over the rows of the fold that have a target.

    score(fold, inputs): the scores of these rows, fits by rows, none of them NaN. Without a row of both classes there is no area.
    ``drawn``: see ``edge_rows``.
    """
    ship(table.rows.sparkSession)
    k, slices = table.k, min(1024, max(1, math.ceil(table.size / SLICE)))
    able = [g for g in range(k) if table.goods[g] and table.bads[g]]
    if not able:
        return {}
    points = np.arange(1, slices) / slices
    even = slices > 1 and len(drawn) and len(drawn[0])
    edges = {g: [np.unique(np.quantile(s, points, method="lower")) for s in score(g, drawn)] if even else None for g in able}
    rows = table.rows.where(F.col("y").isNotNull()).select("fold", "y", "n", *table.inputs)
    goods, bads = table.goods, table.bads

    def cut(batches: Iterator) -> Iterator:
        held, size = [], 0
        for batch in batches:
            held.append(_arrays(batch))
            size += len(held[-1][0])
            if size >= BUFFER:
                yield from pieces(held)
                held, size = [], 0
        if held:
            yield from pieces(held)

    def pieces(held: list[list[np.ndarray]]) -> Iterator:
        """(fit, slice, scores and signed counts) of the rows of each fold; bads count below 0."""
        import pyarrow as pa

        fold, y, n, *inputs = (np.concatenate(parts) for parts in zip(*held))
        for g in able:
            own = np.flatnonzero((fold == g) & ((y == 0) | (y == 1)))
            if not len(own):
                continue
            count, mine = np.where(y[own] == 1, -n[own], n[own]), [c[own] for c in inputs]
            fit, at, blobs = [], [], []
            for t, s in enumerate(score(g, mine)):
                parts = [np.arange(len(s))]
                if edges[g]:
                    place = np.searchsorted(edges[g][t], s, side="left")
                    parts = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place, minlength=len(edges[g][t]) + 1))[:-1])
                for one, part in enumerate(parts):
                    if len(part):
                        fit.append(t * k + g)
                        at.append(one)
                        blobs.append(np.concatenate([s[part], count[part]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fit, pa.int32()), pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["fit", "slice", "held"])

    def ordered(key, batch):
        """Pairs won within the slice, its goods and bads, and the widest gap of their shares below a score."""
        import pyarrow as pa

        fit, g = key[0].as_py(), key[0].as_py() % k
        both = [np.frombuffer(b, dtype=np.float64).reshape(2, -1) for b in batch.column("held").to_pylist()]
        s, n = np.concatenate(both, axis=1)
        order = np.argsort(s)
        s, n = s[order], n[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        good, bad = np.add.reduceat(np.maximum(n, 0), first), np.add.reduceat(np.maximum(-n, 0), first)
        below_g, below_b = np.cumsum(good) - good, np.cumsum(bad) - bad
        gap = float((below_g / goods[g] - below_b / bads[g]).max())
        row = {"fit": fit, "slice": key[1].as_py(), "won": float(bad @ (below_g + good / 2)), "goods": float(good.sum()), "bads": float(bad.sum()), "gap": gap}
        return pa.Table.from_pylist([row], schema=pa.schema([("fit", pa.int32()), ("slice", pa.int32()), *[(c, pa.float64()) for c in ("won", "goods", "bads", "gap")]]))

    cut_ = rows.mapInArrow(cut, "fit int, slice int, held binary").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fit", "slice")
    got = cut_.groupBy("fit", "slice").applyInArrow(ordered, "fit int, slice int, won double, goods double, bads double, gap double").collect()
    out: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.fit, r.slice)):  # fits by folds by slices rows
        won, good, bad, gap = out.get(r.fit, [0.0, 0.0, 0.0, 0.0])
        g = r.fit % k
        out[r.fit] = [won + r.won + r.bads * good, good + r.goods, bad + r.bads, max(gap, good / goods[g] - bad / bads[g] + r.gap)]
    return {(f // k, f % k): (float(won / (goods[f % k] * bads[f % k])), float(gap)) for f, (won, _, _, gap) in out.items()}


@dataclass
class Bins:
    """Each fold's bins of its capped values: 0 for NULL, else 1 and how many ``edges`` (fold, column) of a number lie below it, or the
    ``codes`` (one list a category) of a level."""

    caps: np.ndarray
    numeric: list[str]
    edges: dict[tuple[int, str], np.ndarray]
    codes: list[np.ndarray]

    def of(self, g: int, inputs: list[np.ndarray]) -> np.ndarray:
        """Rows by columns, the numbers first."""
        out = np.zeros((len(inputs[0]) if inputs else 0, len(inputs)), dtype=np.uint8)
        for i, c in enumerate(self.numeric):
            v = np.minimum(inputs[i], self.caps[g, i])
            out[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(self.edges.get((g, c), np.zeros(0)), v, side="left"))
        for j, codes in enumerate(self.codes, len(self.numeric)):
            out[:, j] = codes[inputs[j]]
        return out


def counted_bins(table: Folded, bins: Bins) -> DataFrame:
    """g, y, bins, w: the training rows with a target of each fold g, those of equal bins and y as one with their number."""
    ship(table.rows.sparkSession)
    k = table.k

    def count(batches: Iterator) -> Iterator:
        held, size = [], 0
        for batch in batches:
            held.append(_arrays(batch))
            size += len(held[-1][0])
            if size >= BUFFER:
                yield from counts(held)
                held, size = [], 0
        if held:
            yield from counts(held)

    def counts(held: list[list[np.ndarray]]) -> Iterator:
        import pyarrow as pa

        fold, y, n, *inputs = (np.concatenate(parts) for parts in zip(*held))
        for g in range(k):
            own = np.flatnonzero(fold != g)
            if not len(own):
                continue
            cells = np.ascontiguousarray(np.column_stack([bins.of(g, [c[own] for c in inputs]), y[own].astype(np.uint8)]))
            width = cells.max(axis=0).astype(object) + 1
            if math.prod(width) < 1 << 62:
                code = np.zeros(len(own), dtype=np.int64)
                for j, one in enumerate(width):
                    code = code * int(one) + cells[:, j]
            else:
                code = cells.view(np.dtype((np.void, cells.shape[1])))[:, 0]
            _, first, at = np.unique(code, return_index=True, return_inverse=True)
            kept = cells[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(kept), g), pa.int32()), pa.array(kept[:, -1].astype(float)), pa.array([b.tobytes() for b in kept[:, :-1]], pa.binary()), pa.array(np.bincount(at, n[own]))],
                names=["g", "y", "bins", "w"],
            )

    parts = table.rows.where(F.col("y").isNotNull()).select("fold", "y", "n", *table.inputs).mapInArrow(count, "g int, y double, bins binary, w double")
    return parts.groupBy("g", "y", "bins").agg(F.sum("w").alias("w"))


def losses(table: Folded, score: Callable[[int, list[np.ndarray]], np.ndarray], eps: float) -> dict[int, tuple[float, float]]:
    """Brier score and log loss of each fold's rows with a target, by the first fit of ``score`` (see ``areas``)."""
    ship(table.rows.sparkSession)

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, y, n, *inputs = _arrays(batch)
            for g in np.unique(fold).tolist():
                own = np.flatnonzero(fold == g)
                p, t, w = score(g, [c[own] for c in inputs])[0], y[own], n[own]
                cut = np.clip(p, eps, 1 - eps)
                total[g] = total.get(g, 0) + np.array([w.sum(), w @ (p - t) ** 2, -(w @ np.log(np.where(t == 1, cut, 1 - cut)))])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *[pa.array([float(v[i]) for v in total.values()]) for i in range(3)]], names=["g", "n", "brier", "loss"])

    rows = table.rows.where(F.col("y").isNotNull()).select("fold", "y", "n", *table.inputs)
    got = rows.mapInArrow(add, "g int, n double, brier double, loss double").groupBy("g").agg(F.sum("n").alias("n"), F.sum("brier").alias("brier"), F.sum("loss").alias("loss"))
    return {r.g: (r.brier / r.n, r.loss / r.n) for r in got.collect()}  # a row a fold


def scored(rows: DataFrame, table: Folded, score: Callable[[int, list[np.ndarray]], np.ndarray], id_col: str, y: str) -> DataFrame:
    """fold, id, y and proba of each of the ``rows`` behind ``table``, by its fold's fit."""
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(math.inf))
    inputs = [number(c).alias(f"x{i}") for i, c in enumerate(table.numeric)] + [coded(c, own).alias(f"c{i}") for i, (c, own) in enumerate(zip(table.categorical, table.levels))]
    asked = rows.select(F.col("fold").cast("int").alias("fold"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{y}`").alias("y"), *inputs)
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fold, _, _, *own = (None if i in (1, 2) else c.to_numpy(zero_copy_only=False) for i, c in enumerate(batch.columns))
            out = np.zeros(len(fold))
            for g in np.unique(fold).tolist():
                at = np.flatnonzero(fold == g)
                out[at] = score(g, [c[at] for c in own])[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], names=["fold", "id", "y", "proba"])

    return asked.mapInArrow(predict, f"fold int, id {kinds['id']}, y {kinds['y']}, proba double")
