"""Scores, deciles, grades and calibration of rating scales."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.special import counted
from lendframe.operators.metrics import cut, quantile_edges


def scaled_score(prob: Column, score: float = 600, odd: float = 50, pdo: float = 20) -> Column:
    """offset + factor * ln((1 - p) / p): ``score`` points at odds of ``odd``, ``pdo`` points to double them."""
    if odd <= 0 or pdo <= 0:
        raise ValueError("odd and pdo must be positive")
    factor = pdo / math.log(2)
    p = F.when(prob.isNotNull(), F.greatest(F.least(prob, F.lit(1 - 1e-10)), F.lit(1e-10)))
    return F.lit(score - factor * math.log(odd)) + factor * F.log((1 - p) / p)


def score_to_prob(points: Column, score: float = 600, odd: float = 50, pdo: float = 20) -> Column:
    if odd <= 0 or pdo <= 0:
        raise ValueError("odd and pdo must be positive")
    factor = pdo / math.log(2)
    return 1 / (1 + F.exp((points - (score - factor * math.log(odd))) / factor))


def score_from_parameters(df: DataFrame, coefficients: dict[str, float], intercept: float, maps: dict[str, dict], name: str = "pd") -> DataFrame:
    """The PD of a stored model; a value that a map lacks gives NULL."""
    from lendframe.operators.woe import lookup

    line = F.lit(intercept)
    for rf, slope in coefficients.items():
        line = line + F.lit(slope) * lookup(F.col(f"`{rf}`").cast("string"), maps[rf], maps[rf].get(None))
    return df.withColumn(name, 1 / (1 + F.exp(-line)))


def _mean(x: Column, times: str | None) -> Column:
    return F.try_divide(F.sum(x.cast("double") * F.col(times)), counted(x.isNotNull(), times)) if times else F.avg(x.cast("double"))


def deciles(df: DataFrame, score: str, y: str, bins: int = 10, times: str | None = None) -> DataFrame:
    """Default rate by score quantile, and whether it rises against the decile before (a reversal). A row counts ``times`` times,
    here and below."""
    edges = quantile_edges(df, score, bins, times)
    out = df.withColumn("decile", cut(F.col(score), edges)).groupBy("decile").agg(counted(F.lit(True), times).alias("n"), _mean(F.col(y), times).alias("dr"))
    before = F.lag("dr").over(Window.orderBy("decile"))
    return out.withColumn("reversal", F.coalesce(F.col("dr") > before, F.lit(False)).cast("int"))


def grades(df: DataFrame, score: str, labels: str = "ABCDEFGH", times: str | None = None) -> DataFrame:
    """The grade of each row by score quantiles; the first label is the best, of the highest scores."""
    edges = quantile_edges(df, score, len(labels), times)
    names = F.array(*[F.lit(x) for x in labels])
    return df.withColumn("grade", F.get(names, F.lit(len(labels)) - cut(F.col(score), edges)))


def fixed_grades(score: Column, table: list[tuple[str, float, float]]) -> Column:
    """The grade whose (label, low, high) holds the score; scores in the gap between two grades go to the lower, beyond the
    outermost to these. In an overlap the grade that comes first wins."""
    ordered = sorted(table, key=lambda t: t[1])
    out = F.lit(None).cast("string")
    for (low_label, _, high), (_, low, _) in zip(ordered, ordered[1:]):
        if low > high:
            out = F.when((score > high) & (score < low), low_label).otherwise(out)
    for label, low, high in reversed(table):
        out = F.when((score >= low) & (score <= high), label).otherwise(out)
    return F.when(score < ordered[0][1], ordered[0][0]).when(score > ordered[-1][2], ordered[-1][0]).otherwise(out)


def parameters(model, maps: dict[str, dict], method: str = "") -> str:
    """A model and its WoE maps as a JSON document, which ``score_from_parameters`` can use after ``read_parameters``."""
    levels = {c: [{"bin": k, "woe": v} for k, v in sorted(m.items(), key=lambda kv: (kv[0] is None, kv[0]))] for c, m in maps.items()}
    return json.dumps({"selection_method": method, "selected_variables": list(model.names), "intercept": model.intercept, "coefficients": model.coefficients, "woe_mappings": levels})


def read_parameters(text: str) -> tuple[dict[str, float], float, dict[str, dict]]:
    """Coefficients, intercept and WoE maps of a JSON document."""
    made = json.loads(text)
    return made["coefficients"], made["intercept"], {c: {r["bin"]: r["woe"] for r in rows} for c, rows in made["woe_mappings"].items()}


def rating_scale(df: DataFrame, rating: str, y: str, pd_col: str, times: str | None = None) -> DataFrame:
    return df.groupBy(F.col(rating).alias("rating")).agg(
        counted(F.col(y).isNotNull(), times).alias("no"), counted(F.col(y) == 1, times).alias("nb"), _mean(F.col(y), times).alias("dr"), _mean(F.col(pd_col), times).alias("pdc")
    )


def calibrate(scale: DataFrame, ct: float, dr: str = "dr", w: str = "no", method: str = "scaling", min_pd: float = 0.0003) -> tuple[DataFrame, dict]:
    """``pd_calib`` of each grade so that the weighted mean is ``ct``. A rating scale is a handful of rows.

    scaling: dr times a factor; grades at the floor stay there and the others are scaled on. log_odds_a: an intercept on
    the log-odds. log_odds_ab: intercept and slope, the slope drawn to 1.
    """
    rows = scale.collect()
    rates, weights = [r[dr] for r in rows], [float(r[w]) for r in rows]
    total = sum(weights)
    mean = lambda values: sum(v * x for v, x in zip(values, weights)) / total
    logit = [math.log(max(min(r, 1 - 1e-10), 1e-10) / (1 - max(min(r, 1 - 1e-10), 1e-10))) for r in rates]
    expit = lambda x: 1 / (1 + math.exp(-x))
    if method == "scaling":
        floored, factor = set(), 1.0
        for _ in range(len(rows) + 1):
            fixed = sum(min_pd * weights[i] for i in floored)
            free = sum(rates[i] * weights[i] for i in range(len(rows)) if i not in floored)
            factor = (ct * total - fixed) / free if free else 1.0
            low = {i for i in range(len(rows)) if i not in floored and rates[i] * factor < min_pd}
            if not low:
                break
            floored |= low
        out = [min(1.0, min_pd if i in floored else rates[i] * factor) for i in range(len(rows))]
        params = {"factor": factor}
    elif method == "log_odds_a":
        low, high = -10.0, 10.0
        for _ in range(200):
            a = (low + high) / 2
            low, high = (a, high) if mean([expit(a + x) for x in logit]) < ct else (low, a)
        out, params = [expit(a + x) for x in logit], {"a": a}
    elif method == "log_odds_ab":
        a, b = 0.0, 1.0
        for _ in range(500):  # Gauss-Newton on (mean - ct, sqrt(0.001) (b - 1))
            p = [expit(a + b * x) for x in logit]
            miss, da, db = mean(p) - ct, mean([q * (1 - q) for q in p]), mean([q * (1 - q) * x for q, x in zip(p, logit)])
            haa, hab, hbb = da * da + 1e-12, da * db, db * db + 0.001
            ga, gb = miss * da, miss * db + 0.001 * (b - 1)
            det = haa * hbb - hab * hab
            step_a, step_b = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            a, b = a - step_a, b - step_b
            if abs(step_a) + abs(step_b) < 1e-13:
                break
        out, params = [expit(a + b * x) for x in logit], {"a": a, "b": b}
    else:
        raise ValueError("method: scaling, log_odds_a or log_odds_ab")
    made = [(*r, p) for r, p in zip(rows, out)]
    return scale.sparkSession.createDataFrame(made, scale.schema.simpleString()[7:-1].replace(":", " ") + ", pd_calib double"), params


def stress(scale: DataFrame, shift: float, pd_col: str, w: str) -> DataFrame:
    moved = F.least(F.col(pd_col) + shift, F.lit(1.0))
    return scale.agg((F.sum(moved * F.col(w)) / F.sum(w)).alias("stressed_ct"))


def hhi(df: DataFrame, x: str) -> DataFrame:
    """Sum of squared shares; infinite, missing-only or zero-sum input is an error."""
    row = df.agg(F.sum(x).alias("s"), F.count(x).alias("n"), F.max(F.abs(F.col(x)).cast("double")).alias("m")).first()
    if not row.n or not row.s or row.m == float("inf"):
        raise ValueError("hhi needs finite values with a sum other than zero")
    return df.agg((F.sum(F.col(x).cast("double") * F.col(x)) / (F.sum(x) * F.sum(x))).alias("hhi"))


def composite(models: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Min-max AUC, Gini and KS, with stability, sign, parsimony and monotonicity, weighted into one score."""
    weights = weights or {"auc": 0.25, "gini": 0.15, "ks": 0.10, "stability": 0.20, "sign": 0.15, "parsimony": 0.10, "monotonicity": 0.05}
    whole = Window.partitionBy()

    def part(name: str) -> Column:
        if name not in ("auc", "gini", "ks"):
            return F.col(name)
        low, high = F.min(name).over(whole), F.max(name).over(whole)
        return F.when(high > low, (F.col(name) - low) / (high - low)).otherwise(1.0)

    return models.withColumn("composite", sum(w * part(n) for n, w in weights.items()))


def stability(auc: float, cv_auc: float, most: float = 0.03) -> float:
    """1 where the cross-validated AUC equals the development AUC, down to 0 at a gap of ``most``."""
    return max(0.0, min(1.0, 1 - abs(auc - cv_auc) / most))


def parsimony(n: int, least: int = 4, most: int = 12) -> float:
    """1 for ``least`` variables or fewer, down to 0 for ``most``."""
    return max(0.0, min(1.0, 1 - (n - least) / (most - least)))


def variable_overlap(a: list[str], b: list[str]) -> float:
    return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 0.0
