"""Logistic regression by iteratively reweighted least squares: each step is one aggregate of the cross-products."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.functions.dist import chi2_sf, two_sided
from lendframe.functions.scratch import ship
from lendframe.operators.quantiles import values


@dataclass(frozen=True)
class Logit:
    names: list[str]
    coefficients: dict[str, float]
    intercept: float
    covariance: np.ndarray = field(repr=False)
    deviance: float
    null_deviance: float
    n: int
    converged: bool

    @property
    def aic(self) -> float:
        return self.deviance + 2 * (len(self.names) + 1)

    @property
    def pseudo_r2(self) -> float:
        return 1 - self.deviance / self.null_deviance if self.null_deviance else 0.0

    def p_value(self, name: str) -> float:
        i = self.names.index(name) + 1
        spread = math.sqrt(max(self.covariance[i, i], 0.0))
        return two_sided(self.coefficients[name] / spread) if spread else 1.0

    def interval(self, name: str, z: float = 1.959963984540054) -> tuple[float, float]:
        """Wald interval of a coefficient ("(Intercept)" too), at 95 % by default."""
        i = 0 if name == "(Intercept)" else self.names.index(name) + 1
        middle, half = (self.intercept if i == 0 else self.coefficients[name]), z * math.sqrt(max(self.covariance[i, i], 0.0))
        return middle - half, middle + half

    def likelihood_ratio(self) -> tuple[float, float]:
        """Statistic and p-value of the test against the model of the intercept alone."""
        stat = self.null_deviance - self.deviance
        return stat, chi2_sf(stat, len(self.names)) if self.names else 1.0

    def wald_p(self, names: list[str]) -> float:
        """Joint Wald test of several coefficients."""
        at = [self.names.index(n) + 1 for n in names]
        b = np.array([self.coefficients[n] for n in names])
        return chi2_sf(float(b @ np.linalg.pinv(self.covariance[np.ix_(at, at)]) @ b), len(names))

    def linear(self, offset: Column | None = None) -> Column:
        line = F.lit(self.intercept)
        for name, slope in self.coefficients.items():
            line = line + F.lit(slope) * F.col(f"`{name}`")
        return line if offset is None else line + offset

    def probability(self, offset: Column | None = None) -> Column:
        return 1 / (1 + F.exp(-self.linear(offset)))

    def table(self) -> list[tuple[str, float, float, float]]:
        rows = [("(Intercept)", self.intercept, 0)] + [(n, self.coefficients[n], i + 1) for i, n in enumerate(self.names)]
        out = []
        for name, b, i in rows:
            se = math.sqrt(max(self.covariance[i, i], 0.0))
            out.append((name, b, se, two_sided(b / se) if se else 1.0))
        return out


def fit_logit(df: DataFrame, y: str, names: list[str], offset: str | None = None, rounds: int = 25, lower: dict | None = None, upper: dict | None = None, weight: str | None = None) -> Logit:
    """Maximum likelihood; rows with a NULL in y or a predictor are left out. Separation ends unconverged, not in an error.

    ``lower`` and ``upper`` bound coefficients by name ("(Intercept)" too): bounded ones are fixed at the bound and the
    others fitted on, until no bound is broken and no fixed one wants to come back.
    """
    x_names = [f"__x{i}" for i in range(len(names))]
    rows = df.select(
        F.col(y).cast("double").alias("__y"), *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(names, x_names)],
        (F.col(offset) if offset else F.lit(0.0)).alias("__o"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"),
    ).dropna()
    k = len(names) + 1
    x = [F.lit(1.0)] + [F.col(c) for c in x_names]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def step(beta: np.ndarray) -> tuple:
        line = F.col("__o") + sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0))
        r = rows.withColumn("__p", F.greatest(F.least(1 / (1 + F.exp(-line)), F.lit(1 - 1e-12)), F.lit(1e-12)))
        p, t, w = F.col("__p"), F.col("__y"), F.col("__w")
        row = r.agg(
            *[F.sum(w * p * (1 - p) * x[i] * x[j]) for i, j in pairs], *[F.sum(w * (t - p) * c) for c in x],
            F.sum(-2 * w * F.when(t == 1, F.log(p)).otherwise(F.log(1 - p))), F.sum(w), F.sum(w * t),
        ).first()
        if not row[-2]:
            raise ValueError("no complete rows")
        info = np.zeros((k, k))
        for (i, j), v in zip(pairs, row):
            info[i, j] = info[j, i] = v
        return info, np.array(row[len(pairs) : len(pairs) + k], dtype=float), row[-3], row[-2], row[-1] / row[-2]

    return _solve(step, list(names), rounds, lower, upper)


def fit_groups(
    df: DataFrame, group: str, groups: int, y: str, names: list[str], weight: str | None = None, rounds: int = 25, ridge: float | list[float] = 0.0,
) -> list[Logit | None]:
    """A logit for each group 0, 1, ..., all in one aggregate a Newton step; None for a group without complete rows.

    ``ridge``: half of it (or of the group's own) times the squares of all slopes is added to the negative log likelihood.
    """
    penalties = ridge if isinstance(ridge, list) else [ridge] * groups
    k, x_names = len(names) + 1, [f"__x{i}" for i in range(len(names))]
    rows = df.select(
        F.col(group).cast("int").alias("__g"), F.col(y).cast("double").alias("__y"),
        *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(names, x_names)], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"),
    ).dropna()
    x = [F.lit(1.0)] + [F.col(c) for c in x_names]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def run(betas: dict[int, np.ndarray]) -> dict[int, tuple]:
        table = F.array(*[F.array(*[F.lit(float(b)) for b in betas.get(g, np.zeros(k))]) for g in range(groups)])
        own = rows.where(F.col("__g").isin(list(betas))).withColumn("__b", F.get(table, F.col("__g")))
        line = sum((F.col("__b")[i] * c for i, c in enumerate(x)), F.lit(0.0))
        r = own.withColumn("__p", F.greatest(F.least(1 / (1 + F.exp(-line)), F.lit(1 - 1e-12)), F.lit(1e-12)))
        p, t, w = F.col("__p"), F.col("__y"), F.col("__w")
        got = r.groupBy("__g").agg(
            *[F.sum(w * p * (1 - p) * x[i] * x[j]) for i, j in pairs], *[F.sum(w * (t - p) * c) for c in x],
            F.sum(-2 * w * F.when(t == 1, F.log(p)).otherwise(F.log(1 - p))), F.sum(w), F.sum(w * t),
        ).collect()
        out = {}
        for g, *row in got:
            info = np.zeros((k, k))
            for (i, j), v in zip(pairs, row):
                info[i, j] = info[j, i] = v
            out[g] = (info, np.array(row[len(pairs) : len(pairs) + k], dtype=float), row[-3], row[-2], row[-1] / row[-2] if row[-2] else 0.0)
        return out

    made = _newton(run, {g: penalties[g] for g in range(groups)}, names, rounds)
    return [made.get(g) for g in range(groups)]


def fit_ridges(df: DataFrame, group: str, groups: int, y: str, names: list[str], ridges: list[float], weight: str | None = None, rounds: int = 25) -> list[list[Logit | None]]:
    """A logit for each ridge and each group 0, 1, ..., as ``fit_groups`` has it. All ridges share a group's rows: a Newton step is one
    pass over them, whose tasks add up the cross-products of all fits."""
    ship(df.sparkSession)
    k = len(names) + 1
    rows = df.select(
        F.col(group).cast("int").alias("g"), F.col(y).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)],
    ).dropna()
    upper = np.triu_indices(k)

    def run(betas: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], tuple]:
        asked: dict[int, list[int]] = {}
        for i, g in betas:
            asked.setdefault(g, []).append(i)
        tables = {g: (own, np.array([betas[i, g] for i in own])) for g, own in asked.items()}
        parts = rows.mapInArrow(lambda b: _moments(b, tables), "fit int, g int, at int, v double")
        # fits by cross-products rows
        got = parts.groupBy("fit", "g", "at").agg(F.sum("v").alias("v")).toPandas()
        out = {}
        for (i, g), own in got.groupby(["fit", "g"]):
            row = np.zeros(len(upper[0]) + k + 3)
            row[own["at"]] = own["v"]
            info = np.zeros((k, k))
            info[upper] = row[: len(upper[0])]
            info = info + np.triu(info, 1).T
            out[int(i), int(g)] = (info, row[len(upper[0]) : -3], row[-3], row[-2], row[-1] / row[-2] if row[-2] else 0.0)
        return out

    made = _newton(run, {(i, g): r for i, r in enumerate(ridges) for g in range(groups)}, names, rounds)
    return [[made.get((i, g)) for g in range(groups)] for i in range(len(ridges))]


def _moments(batches: Iterator, tables: dict[int, tuple[list[int], np.ndarray]]) -> Iterator:
    """tables: group -> (numbers of its fits, their coefficients). Cross-products, gradients, deviance, rows and bads of each fit."""
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        g, y, w, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        x = np.column_stack([np.ones(len(g)), *x])
        i, j = np.triu_indices(x.shape[1])
        for one in np.unique(g):
            if int(one) in tables:
                at = np.flatnonzero(g == one)
                own, t, n = x[at], y[at][:, None], w[at][:, None]
                with np.errstate(over="ignore"):
                    p = np.clip(1 / (1 + np.exp(-(own @ tables[int(one)][1].T))), 1e-12, 1 - 1e-12)
                deviance = -2 * (n * np.log(np.where(t == 1, p, 1 - p))).sum(axis=0)
                sums = [(n * p * (1 - p)).T @ (own[:, i] * own[:, j]), (n * (t - p)).T @ own, deviance[:, None], np.full((p.shape[1], 1), n.sum()), np.full((p.shape[1], 1), (n * t).sum())]
                total[int(one)] = total.get(int(one), 0) + np.hstack(sums)
    for g, sums in total.items():
        fits, width = sums.shape
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(tables[g][0], width), pa.int32()), pa.array(np.full(fits * width, g), pa.int32()), pa.array(np.tile(np.arange(width), fits), pa.int32()), pa.array(sums.ravel(), pa.float64())],
            names=["fit", "g", "at", "v"],
        )


def _newton(run, penalties: dict, names: list[str], rounds: int, start: dict | None = None) -> dict:
    """Fits by key, each with its ridge, from zeros or ``start``: Newton steps of all that still move, by one call of ``run`` each."""
    k = len(names) + 1
    betas = {g: np.zeros(k) for g in penalties} | (start or {})
    previous, made = dict.fromkeys(betas, math.inf), {}
    for turn in range(rounds):
        step = run(betas)
        going = {}
        for g, (info, gradient, dev, n, mean) in step.items():
            slopes = np.r_[0.0, betas[g][1:]]
            info, gradient, dev = info + penalties[g] * np.diag(np.r_[0.0, np.ones(k - 1)]), gradient - penalties[g] * slopes, dev + penalties[g] * float(slopes @ slopes)
            done = abs(previous[g] - dev) < 1e-12 * (abs(dev) + 1e-9)
            null_dev = -2.0 * n * sum(m * math.log(m) for m in (mean, 1 - mean) if m > 0)
            b = betas[g]
            made[g] = Logit(list(names), dict(zip(names, b[1:].tolist())), float(b[0]), np.linalg.pinv(info), float(dev), float(null_dev), int(n), done)
            previous[g] = dev
            if not done and turn + 1 < rounds:
                going[g] = b + np.clip(np.linalg.pinv(info) @ gradient, -20, 20)
        betas = going
        if not betas:
            break
    return made


@dataclass(frozen=True)
class Cells:
    """A table compressed to its distinct rows and their counts, small enough for the driver."""

    columns: dict[str, np.ndarray]
    count: np.ndarray

    def fit(self, y: str, names: list[str], offset: str | None = None, rounds: int = 25) -> Logit:
        t, w = self.columns[y].astype(float), self.count.astype(float)
        x = np.column_stack([np.ones(len(w)), *[self.columns[c].astype(float) for c in names]])
        o = self.columns[offset] if offset else 0.0

        def step(beta: np.ndarray) -> tuple:
            p = np.clip(1 / (1 + np.exp(-(x @ beta + o))), 1e-12, 1 - 1e-12)
            dev = -2 * float((w * np.where(t == 1, np.log(p), np.log(1 - p))).sum())
            return x.T @ (x * (w * p * (1 - p))[:, None]), x.T @ (w * (t - p)), dev, float(w.sum()), float((w * t).sum() / w.sum())

        return _solve(step, list(names), rounds, None, None)


def compress(df: DataFrame, columns: list[str], times: str | None = None, most: int = 50_000) -> Cells | None:
    """The distinct rows of coded factors with their counts, or None if there are more than ``most``. A row counts ``times`` times."""
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns], (F.col(f"`{times}`") if times else F.lit(1)).alias("__times"))
    rows = rows.groupBy(*columns).agg(F.sum("__times").alias("count")).limit(most + 1).toPandas()
    if not 0 < len(rows) <= most:
        return None
    return Cells({c: rows[c].to_numpy() for c in columns}, rows["count"].to_numpy())


def _solve(step, names: list[str], rounds: int, lower: dict | None, upper: dict | None) -> Logit:
    """Newton steps within bounds until the deviance stands still."""
    k = len(names) + 1
    beta, previous, converged = np.zeros(k), math.inf, False
    labels = ["(Intercept)", *names]
    low = np.array([(lower or {}).get(n, -math.inf) for n in labels])
    high = np.array([(upper or {}).get(n, math.inf) for n in labels])
    beta = np.minimum(np.maximum(beta, low), high)
    info, n, null_dev, dev = np.eye(k), 0, 0.0, math.inf
    for _ in range(rounds):
        info, gradient, dev, n, mean = step(beta)
        null_dev = -2.0 * n * sum(m * math.log(m) for m in (mean, 1 - mean) if m > 0)
        if abs(previous - dev) < 1e-12 * (abs(dev) + 1e-9):
            converged = True
            break
        previous = dev
        free = ~(((beta <= low) & (gradient < 0)) | ((beta >= high) & (gradient > 0)))
        move = np.zeros(k)
        move[free] = np.linalg.pinv(info[np.ix_(free, free)]) @ gradient[free]
        beta = np.minimum(np.maximum(beta + np.clip(move, -20, 20), low), high)
    return Logit(names, dict(zip(names, beta[1:].tolist())), float(beta[0]), np.linalg.pinv(info), float(dev), float(null_dev), int(n), converged)


def constrained_logit(df: DataFrame, y: str, names: list[str], lower: dict[str, float], upper: dict[str, float]) -> DataFrame:
    """The linear predictor of a logit within bounds that may hold the intercept too."""
    fit = fit_logit(df, y, names, rounds=50, lower=lower, upper=upper)
    return df.withColumn("linear_predictor", fit.linear())


def u_shape(df: DataFrame, x: str, y: str, p_value: float = 0.05, knots: int = 20) -> DataFrame:
    """Two hinges at each of the 5-95 % quantile knots; a U is found where both slopes are positive and significant."""
    points = [0.05 + 0.9 * i / (knots - 1) for i in range(knots)]
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    found = values(rows, {x: F.col(f"`{x}`")}, [0.0, *points, 1.0]).get(x)
    low, *inner, high = found or [0.0, 0.0]
    knots_ = [k for k in sorted(set(inner)) if low < k < high]
    if not knots_:
        return df.sparkSession.createDataFrame([], "knot double, left double, right double, deviance double, detected boolean")
    # every knot has its rows: one aggregate a Newton step fits them all
    each = rows.select(F.col(f"`{x}`").cast("double").alias("v"), F.col(y).alias("y"), F.posexplode(F.array(*[F.lit(float(k)) for k in knots_])).alias("at", "knot"))
    v, knot_ = F.col("v"), F.col("knot")
    each = each.select(
        "at", "y", F.when(v < knot_, (knot_ - v) / (knot_ - low)).otherwise(0.0).alias("left"), F.when(v > knot_, (v - knot_) / (high - knot_)).otherwise(0.0).alias("right")
    )
    out = []
    for knot, fit in zip(knots_, fit_groups(each, "at", len(knots_), "y", ["left", "right"])):
        both = fit.coefficients["left"] > 0 and fit.coefficients["right"] > 0 and max(fit.p_value("left"), fit.p_value("right")) < p_value
        out.append((float(knot), fit.coefficients["left"], fit.coefficients["right"], fit.deviance, bool(both)))
    return df.sparkSession.createDataFrame(out, "knot double, left double, right double, deviance double, detected boolean")


def u_basis(df: DataFrame, x: str, knot: float, low: float, high: float) -> DataFrame:
    v = F.col(x).cast("double")
    return df.withColumns({"left": F.when(v < knot, (knot - v) / (knot - low)).otherwise(0.0), "right": F.when(v > knot, (v - knot) / (high - knot)).otherwise(0.0)})
