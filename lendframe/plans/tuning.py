"""Tuning by tree-structured Parzen estimators: densities of good and of other trials, one for each parameter.

Trials are proposed in batches, and all inner folds of all trials of a batch are fitted in shared aggregates, so that fifty trials
of five folds take as many passes over the rows as the batches do. Caps are refitted from the training rows of each inner fold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.scratch import release, stored
from lendframe.operators import folded, metrics, resample
from lendframe.operators.boosting import Params, fit_boosted
from lendframe.operators.glm import Logit
from lendframe.plans.benchmark import MOST_DUMMIES, fold_copies, spread_out

TRIALS, INNER_FOLDS, BATCH, FIRST, DRAWN = 50, 5, 10, 10, 24


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def to_unit(self, value: float) -> float:
        f = math.log if self.log else float
        return (f(value) - f(self.low)) / (f(self.high) - f(self.low))

    def of_unit(self, u: float) -> float:
        f = math.log if self.log else float
        value = f(self.low) + min(max(u, 0.0), 1.0) * (f(self.high) - f(self.low))
        value = math.exp(value) if self.log else value
        return int(round(value)) if self.whole else value


#: What each learner is tuned over.
LOGIT = {"c": Range(1e-3, 10.0, log=True)}
DEPTHWISE = {
    "trees": Range(50, 500, whole=True), "depth": Range(2, 8, whole=True), "rate": Range(0.01, 0.3, log=True), "subsample": Range(0.6, 1.0),
    "columns": Range(0.6, 1.0), "l1": Range(1e-8, 1.0, log=True), "l2": Range(1e-8, 1.0, log=True),
}
LEAFWISE = DEPTHWISE | {"depth": Range(2, 12, whole=True), "leaves": Range(8, 128, whole=True), "least_rows": Range(5, 50, whole=True)}


class Parzen:
    """Proposes points of the unit cube. A density is a mean of normal kernels at the trials, cut off at 0 and 1, and a flat prior."""

    def __init__(self, space: dict[str, Range], seed: int = 42) -> None:
        self.space, self.rng = space, np.random.default_rng(seed)
        self.points: list[list[float]] = []
        self.scores: list[float] = []

    @staticmethod
    def _widths(at: np.ndarray) -> np.ndarray:
        """Each kernel as wide as the larger gap to its neighbours, the ends included, within bounds."""
        order = np.argsort(at, kind="stable")
        edges = np.concatenate([[0.0], at[order], [1.0]])
        wide = np.empty(len(at))
        wide[order] = np.maximum(np.diff(edges)[:-1], np.diff(edges)[1:])
        return np.clip(wide, 1 / min(100, len(at) + 2), 1.0)

    @classmethod
    def density(cls, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        phi = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), otypes=[float])
        total = np.ones(len(x))
        for center, width in zip(at, cls._widths(at)):
            inside = phi((1 - center) / width) - phi(-center / width)
            total += np.exp(-0.5 * ((x - center) / width) ** 2) / (width * math.sqrt(2 * math.pi) * inside)
        return total / (len(at) + 1)

    def _sample(self, at: np.ndarray, n: int) -> np.ndarray:
        wide = self._widths(at)
        out = []
        while len(out) < n:
            k = int(self.rng.integers(len(at) + 1))
            u = self.rng.random() if k == len(at) else self.rng.normal(at[k], wide[k])
            if 0 <= u <= 1:
                out.append(u)
        return np.array(out)

    def propose(self, n: int) -> list[dict[str, float]]:
        """``n`` points; those of a batch count as bad trials for each other, so that they keep apart."""
        names, batch = list(self.space), []
        for _ in range(n):
            if len(self.points) + len(batch) < FIRST or not self.points:
                batch.append(self.rng.random(len(names)).tolist())
                continue
            order = np.argsort([-s for s in self.scores], kind="stable")
            good = order[: min(25, math.ceil(0.1 * len(order)))]
            own = np.array(self.points)
            rest = np.concatenate([np.delete(own, good, axis=0), np.array(batch).reshape(-1, len(names))])
            point = []
            for j in range(len(names)):
                x = self._sample(own[good, j], DRAWN)
                ratio = np.log(self.density(own[good, j], x)) - np.log(self.density(rest[:, j], x))
                point.append(float(x[np.argmax(ratio)]))
            batch.append(point)
        self._open = batch
        return [{name: r.of_unit(u) for (name, r), u in zip(self.space.items(), point)} for point in batch]

    def tell(self, scores: list[float]) -> None:
        self.points += self._open
        self.scores += scores


def inner_auc(copies: DataFrame, y: str, trials: list[dict], k: int, numeric: list[str], categorical: list[str], seed: int) -> list[float]:
    """Mean AUC over the inner folds of each trial of boosted trees; a trial and fold is one group of the shared fits."""
    groups = [(t, g) for t in range(len(trials)) for g in range(k)]
    rows = copies.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(trials) - 1)))).withColumn("g", F.col("trial") * k + F.col("g"))
    params = [Params(**({"leaves": 2 ** int(trials[t]["depth"])} | trials[t]), seed=seed) for t, _ in groups]
    tested = fit_boosted(rows.where("__train"), y, "__id", numeric, categorical, params, "g").predict(rows.where(~F.col("__train")), "g", ["__id", "g", "fold", y])
    found = {r.fit: r.auc for r in metrics.auc(tested.withColumnRenamed("g", "fit"), "proba", y, "fit").collect()}  # a row a group
    return mean_areas([[found.get(t * k + g) for g in range(k)] for t in range(len(trials))])


def mean_areas(areas: list[list[float | None]]) -> list[float]:
    return [float(np.mean([a for a in own if a is not None])) if any(a is not None for a in own) else 0.5 for own in areas]


class LogitTrials:
    """Trials of the logit's ridge, all on one table of distinct rows. A fit begins at the one of the nearest ridge of the batches before."""

    def __init__(self, table: folded.Folded) -> None:
        self.design, self.drawn = folded.design(table), folded.edge_rows(table)
        self.known: list[tuple[float, list[Logit | None]]] = []

    def inner_auc(self, trials: list[dict]) -> list[float]:
        ridges, k = [1 / t["c"] for t in trials], self.design.table.k
        start = {}
        for i, ridge in enumerate(ridges):
            near = min(self.known, key=lambda one: abs(math.log(one[0] / ridge)), default=(ridge, []))[1]
            start |= {(i, g): np.array([f.intercept, *f.coefficients.values()]) for g, f in enumerate(near) if f and f.converged}
        fits = folded.fit_ridges(self.design, ridges, start=start)
        self.known += list(zip(ridges, fits))
        found = folded.areas(self.design.table, self.drawn, self.design.scores(fits))
        return mean_areas([[found.get((t, g), (None,))[0] if fits[t][g] else None for g in range(k)] for t in range(len(trials))])


def tune(
    train: DataFrame, y: str, id_col: str, numeric: list[str], categorical: list[str], learner: str = "logit", trials: int = TRIALS, k: int = INNER_FOLDS,
    batch: int = BATCH, seed: int = 42, space: dict[str, Range] | None = None,
) -> DataFrame:
    """A row for each trial: its number, the parameters and the mean inner AUC. The same seed and rows give the same trials.

    learner: logit (ridge), depthwise or leafwise (boosted trees). ``train`` comes uncapped: each inner fold's caps are those of
    its own training rows.
    """
    space = space or {"logit": LOGIT, "depthwise": DEPTHWISE, "leafwise": LEAFWISE}[learner]
    folds = stored(resample.folds(train, id_col, y, k, seed), "tuning-folds")
    if learner == "logit":
        # no trial of the logit needs single rows
        table = folded.folded(folds, y, numeric, categorical, k, MOST_DUMMIES)
        if table is None:
            raise ValueError(f"over {MOST_DUMMIES} levels, too many for dummies, in one of {', '.join(categorical)}")
        copies, score = table.rows, LogitTrials(table).inner_auc
    else:
        copies = stored(spread_out(fold_copies(folds, id_col, numeric, k)), "tuning-copies")
        score = lambda tried: inner_auc(copies, y, tried, k, numeric, categorical, seed)
    sampler, rows = Parzen(space, seed), []
    while len(rows) < trials:
        tried = sampler.propose(min(batch, trials - len(rows)))
        scores = score(tried)
        sampler.tell(scores)
        rows += [(len(rows) + i, *map(float, t.values()), s) for i, (t, s) in enumerate(zip(tried, scores))]
    release(folds, copies)
    return train.sparkSession.createDataFrame(rows, "trial int, " + ", ".join(f"{name} double" for name in space) + ", auc double")


def best(tuned: DataFrame) -> dict[str, float]:
    """The parameters of the best trial, the first of equal ones."""
    row = tuned.orderBy(F.desc("auc"), "trial").first().asDict()
    return {name: v for name, v in row.items() if name not in ("trial", "auc")}
