"""Discrimination and classification metrics over (predictions, observed) columns.

Scores are pre-aggregated to distinct values by a partial sum. Running totals over them are taken within slices of the score
range, with the totals of the slices before added by a small broadcast table, so that no task orders all distinct scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.dist import two_sided, wilcoxon_p
from lendframe.functions.special import counted
from lendframe.operators.quantiles import sliced, values

EPS = 1e-15


def by_score(df: DataFrame, score: str, y: str, *keys: str, digits: int | None = None, times: str | None = None) -> DataFrame:
    s = F.round(F.col(score), digits) if digits is not None else F.col(score)
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, s.alias("s")).agg(
        counted(F.col(y) == 0, times).alias("g"), counted(F.col(y) == 1, times).alias("b")
    )


def running(rows: DataFrame, *keys: str) -> DataFrame:
    """rows: (keys, s, g, b). Adds goods and bads below each score (gb, bb) and in all (tg, tb) of its keys."""
    rows = sliced(rows.withColumnRenamed("s", "v"), list(keys)).withColumnRenamed("v", "s")
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = rows.groupBy(*keys, "slice").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    sums = sums.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("slice").alias("at"),
        F.coalesce(F.sum("g").over(before), F.lit(0)).alias("g0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
        F.sum("g").over(whole).alias("tg"), F.sum("b").over(whole).alias("tb"),
    )
    # keys are models and folds: as many rows as slices for each
    joined = rows.join(F.broadcast(sums), [F.col("slice") == F.col("at"), *[F.col(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)]])
    below = Window.partitionBy(*keys, "slice").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *keys, "s", "g", "b", (F.col("g0") + F.coalesce(F.sum("g").over(below), F.lit(0))).alias("gb"),
        (F.col("b0") + F.coalesce(F.sum("b").over(below), F.lit(0))).alias("bb"), "tg", "tb",
    )


def auc(df: DataFrame, score: str, y: str, *keys: str, digits: int | None = None, times: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties one half; NULL with one class. Also KS = max(TPR - FPR) and Gini. A row counts ``times`` times."""
    return areas(by_score(df, score, y, *keys, digits=digits, times=times), *keys)


def areas(counts: DataFrame, *keys: str) -> DataFrame:
    """``auc`` from the goods g and bads b at each score s of ``keys``."""
    rows = running(counts, *keys)
    gap = F.try_divide(F.col("tb") - F.col("bb"), F.col("tb")) - F.try_divide(F.col("tg") - F.col("gb"), F.col("tg"))
    area = F.try_divide(F.sum(F.col("b") * (F.col("gb") + F.col("g") / 2)), F.max("tb") * F.max("tg"))
    return rows.groupBy(*keys).agg(area.alias("auc"), F.greatest(F.max(gap), F.lit(0.0)).alias("ks")).withColumn("gini", 2 * F.col("auc") - 1)


def losses(df: DataFrame, prob: str, y: str, *keys: str) -> DataFrame:
    p = F.greatest(F.least(F.col(prob), F.lit(1 - EPS)), F.lit(EPS))
    t = F.col(y)
    rows = df.where(F.col(prob).isNotNull() & t.isNotNull())
    return rows.groupBy(*keys).agg(
        F.avg((F.col(prob) - t) * (F.col(prob) - t)).alias("brier"), F.avg(-F.when(t == 1, F.log(p)).otherwise(F.log(1 - p))).alias("logloss")
    )


def all_metrics(df: DataFrame, prob: str, y: str, *keys: str) -> DataFrame:
    one, two = auc(df, prob, y, *keys), losses(df, prob, y, *keys)
    return one.join(two, list(keys)) if keys else one.crossJoin(F.broadcast(two))  # one row each


def confusion(df: DataFrame, prob: str, y: str, cutoff: float) -> DataFrame:
    """(metric, value) rows; a prediction is positive above the cutoff, and a zero denominator gives 0."""
    hit, one = F.col(prob) > cutoff, F.col(y) == 1
    row = df.where(F.col(prob).isNotNull() & F.col(y).isNotNull()).agg(
        F.count_if(~hit & ~one).alias("tn"), F.count_if(hit & ~one).alias("fp"), F.count_if(~hit & one).alias("fn"), F.count_if(hit & one).alias("tp")
    )
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    cells = {
        "TN": tn, "FP": fp, "FN": fn, "TP": tp, "accuracy": share(tn + tp, tn + fp + fn + tp), "error_rate": share(fp + fn, tn + fp + fn + tp),
        "sensitivity": share(tp, tp + fn), "specificity": share(tn, tn + fp), "precision": share(tp, tp + fp),
        "f1_score": share(2 * tp, 2 * tp + fp + fn), "false_positive": share(fp, fp + tn), "false_discovery": share(fp, fp + tp),
    }
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in cells.items()])))


def roc_points(df: DataFrame, score: str, y: str) -> DataFrame:
    return running(by_score(df, score, y)).select(
        F.col("s").alias("threshold"), ((F.col("tb") - F.col("bb")) / F.col("tb")).alias("tpr"), ((F.col("tg") - F.col("gb")) / F.col("tg")).alias("fpr")
    )


def quantile_edges(df: DataFrame, column: str, bins: int, times: str | None = None) -> list[float]:
    """Inner and outer edges by linear interpolation, duplicates dropped. A row counts ``times`` times."""
    return edges_of(df, [column], bins, times).get(column, [])


def edges_of(df: DataFrame, columns: list[str], bins: int, times: str | None = None) -> dict[str, list[float]]:
    """``quantile_edges`` of several columns in one pass; a column without values is left out."""
    found = values(df, {c: F.col(f"`{c}`") for c in columns}, [i / bins for i in range(bins + 1)], times)
    return {c: sorted(set(q)) for c, q in found.items()}


def cut(x: Column, edges: list[float], right: bool = True) -> Column:
    """1-based bin of right-closed intervals (left-closed if not ``right``); the outer bins are open."""
    inner = edges[1:-1]
    return F.when(x.isNotNull(), sum(((x > e) if right else (x >= e)).cast("int") for e in inner) + F.lit(1) if inner else F.lit(1))


def reliability(df: DataFrame, prob: str, y: str, bins: int = 10) -> DataFrame:
    edges = quantile_edges(df, prob, bins)
    return df.withColumn("bin", cut(F.col(prob), edges)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed")
    )


def _placements(df: DataFrame, score: str, y: str, name: str) -> DataFrame:
    """(score value, y) to the share of the other class that it beats, ties one half: from distinct scores."""
    return running(by_score(df, score, y)).select(
        "s", F.try_divide(F.col("gb") + F.col("g") / 2, F.col("tg")).alias(f"{name}_1"), (1 - F.try_divide(F.col("bb") + F.col("b") / 2, F.col("tb"))).alias(f"{name}_0")
    )


def delong(df: DataFrame, a: str, b: str, y: str) -> dict[str, float]:
    """Paired DeLong test of two scores of the same rows; z > 0: a is better; no variance: (0, 1); under two rows of a class: no test."""
    pa, pb = _placements(df, a, y, "a"), _placements(df, b, y, "b")
    rows = df.join(pa, df[a] == pa["s"]).drop("s").join(pb, df[b] == pb["s"]).drop("s")
    va, vb = F.when(F.col(y) == 1, F.col("a_1")).otherwise(F.col("a_0")), F.when(F.col(y) == 1, F.col("b_1")).otherwise(F.col("b_0"))
    got = {
        r["y"]: r
        for r in rows.select(F.col(y).alias("y"), va.alias("va"), vb.alias("vb")).groupBy("y")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("va").alias("ma"), F.avg("vb").alias("mb"), F.var_samp(F.col("va") - F.col("vb")).alias("vd")).collect()
    }
    if not {0, 1} <= got.keys() or min(got[0]["n"], got[1]["n"]) < 2:
        return {"auc_a": got[1]["ma"] if 1 in got else None, "auc_b": got[1]["mb"] if 1 in got else None, "z": None, "p_value": None}
    one, zero = got[1], got[0]
    variance = one["vd"] / one["n"] + zero["vd"] / zero["n"]
    z = (one["ma"] - one["mb"]) / math.sqrt(variance) if variance > 0 else 0.0
    return {"auc_a": one["ma"], "auc_b": one["mb"], "z": z, "p_value": two_sided(z) if variance > 0 else 1.0}


def wilcoxon(a: list[float], b: list[float]) -> float:
    """Two-sided signed-rank test of fold metrics: a handful of numbers."""
    return wilcoxon_p([x - y for x, y in zip(a, b, strict=True)])


@dataclass(frozen=True)
class PairedAreas:
    """AUCs of models over the same rows, and the covariance matrix of these by DeLong's placements."""

    models: list[str]
    auc: np.ndarray
    covariance: np.ndarray

    def test(self, a: str, b: str) -> tuple[float, float, float]:
        """Difference, z and two-sided p-value; z > 0: a is better; without variance (0, 1)."""
        i, j = self.models.index(a), self.models.index(b)
        gap, c = float(self.auc[i] - self.auc[j]), self.covariance
        variance = float(c[i, i] + c[j, j] - 2 * c[i, j])
        z = gap / math.sqrt(variance) if variance > 1e-18 else 0.0
        return gap, z, two_sided(z) if variance > 1e-18 else 1.0


def paired_areas(predictions: DataFrame, model: str = "model", id_col: str = "id", y: str = "y", score: str = "proba") -> PairedAreas:
    """All models at once: placements of all scores in one sliced pass, then one aggregate of their covariances for each class.

    ``predictions`` has a row for each model and id, all models with the same ids and labels, else ValueError.
    """
    rows = predictions.select(F.col(model).alias("m"), F.col(id_col).alias("id"), F.col(y).alias("y"), F.col(score).cast("double").alias("p")).dropna()
    placed = running(by_score(rows, "p", "y", "m"), "m").select(
        F.col("m").alias("p_m"), F.col("s").alias("p_s"), F.try_divide(F.col("gb") + F.col("g") / 2, F.col("tg")).alias("one"),
        (1 - F.try_divide(F.col("bb") + F.col("b") / 2, F.col("tb"))).alias("zero"),
    )
    joined = rows.join(placed, (F.col("m") == F.col("p_m")) & (F.col("p") == F.col("p_s")))
    valued = joined.select("id", "y", "m", F.when(F.col("y") == 1, F.col("one")).otherwise(F.col("zero")).alias("v"))
    names = sorted(r.m for r in rows.select("m").distinct().collect())
    wide = valued.groupBy("id").agg(
        F.min("y").alias("y"), (F.min("y") == F.max("y")).alias("same"), F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("m") == name, F.col("v"))).alias(f"v{i}") for i, name in enumerate(names)]
    )
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    whole = F.col("same") & (F.col("n") == len(names))
    got = {
        r.y: r for r in wide.groupBy("y").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(~whole).alias("odd"), *[F.avg(f"v{i}").alias(f"a{i}") for i in range(len(names))], *[F.covar_samp(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs]
        ).collect()
    }
    if any(r.odd for r in got.values()):
        raise ValueError("the models' predictions do not align")
    if not {0, 1} <= got.keys() or min(got[0].n, got[1].n) < 2:
        raise ValueError("two rows of each class at least")
    covariance = np.zeros((len(names), len(names)))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = sum(r[f"c{i}_{j}"] / r.n for r in got.values())
    return PairedAreas(names, np.array([got[1][f"a{i}"] for i in range(len(names))]), covariance)


def forest(predictions: DataFrame, champion: str, **columns: str) -> DataFrame:
    """Each model's AUC over all out-of-fold rows less the champion's, with DeLong's interval at 1.96 standard errors and p-value.

    The standard error is |difference / z|, and 0.05 where z is 0.
    """
    areas = paired_areas(predictions, **columns)
    rows = []
    for m in areas.models:
        if m != champion:
            gap, z, p = areas.test(m, champion)
            half = 1.96 * (abs(gap / z) if z else 0.05)
            rows.append((m, gap, gap - half, gap + half, p))
    return predictions.sparkSession.createDataFrame(rows, "model string, difference double, low double, high double, p_value double")


def runtimes(folds: DataFrame) -> DataFrame:
    """Mean and total seconds of each model."""
    return folds.groupBy("model").agg(F.avg("runtime_s").alias("mean_s"), F.sum("runtime_s").alias("total_s"))


def bonferroni(p: Column, n: int) -> Column:
    return F.least(p * n, F.lit(1.0))


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    return folds.groupBy("model").agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
