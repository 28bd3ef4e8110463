"""The scorecard pipeline: quality, preparation, bivariate, three model builders, comparison, calibration, validation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.operators import metrics, profile, resample, scorecard, selection, validation, woe
from lendframe.operators.glm import Logit


@dataclass(frozen=True)
class Scorecard:
    champion: str
    model: Logit
    models: DataFrame
    scale: DataFrame
    assessment: DataFrame
    scored: DataFrame


def build(df: DataFrame, y: str, id_col: str, numeric: list[str], categorical: list[str], ct: float | None = None) -> Scorecard:
    """Run all stages; row-level data stays on the executors, models and scales are the only things collected.

    Numbers are winsorised and cut at quintiles, all factors are WoE-coded, columns of too low IV or near-zero variance go,
    and three builders (MIV, forward by p-value, importance in boosted trees) run side by side.
    """
    # the stages before the bins read these columns
    df = df.select(id_col, y, *numeric, *categorical).cache()
    checked = profile.nzv(df, categorical).where("high_freq_ratio = 1").select("rf").collect() if categorical else []
    dull = {r.rf for r in checked}
    capped, _ = profile.winsorise(df, numeric)
    binned, factors = capped, [c for c in categorical if c not in dull]
    edges = metrics.edges_of(capped, numeric, 5)
    binned = binned.withColumns({f"{c}_bin": F.coalesce(F.format_string("%02d", metrics.cut(F.col(c), edges.get(c, []))), F.lit("SC")) for c in numeric})
    factors += [f"{c}_bin" for c in numeric]
    binned = binned.select(id_col, y, *factors)
    # later stages ask a row for its factors, fold and half only: they read equal rows once, with their count
    parts = {"__fold": resample.fold_of(df, id_col, 5, 1984), "__half": F.pmod(F.xxhash64(id_col), F.lit(2))}
    counts = binned.withColumns(parts).groupBy(y, *factors, *parts).agg(F.count(F.lit(1)).alias("__n")).cache()
    table = woe.woe_table(counts, factors, y, "__n")
    wide = selection.with_woe(counts, y, factors, "__n")
    pairs = profile.correlation_pairs(wide, [f"{c}_woe" for c in factors], -1.0, "__n")
    pairs = pairs.select(F.regexp_replace("rf1", "_woe$", "").alias("rf1"), F.regexp_replace("rf2", "_woe$", "").alias("rf2"), "corr")
    listed = [r.rf for r in woe.shortlist(table, iv=0.02, low=0.0, pairs=pairs).orderBy(F.desc("iv"), "rf").limit(15).collect()]
    raw = {c: f"__raw_{c}" for c in listed}
    kept = ["__fold", "__half", "__n", *raw.values()]
    # factors that are not listed tell no rows apart any more
    counts = counts.groupBy(y, *listed, *parts).agg(F.sum("__n").alias("__n")).withColumns({r: F.col(c) for c, r in raw.items()}).cache()
    coded = woe.replace_woe(counts, y, listed, "__n")[0].cache()
    builders = {
        "miv": lambda: selection.step_miv(counts, y, listed, times="__n"),
        "forward": lambda: selection.step_fwd(coded, y, listed, times="__n"),
        "boosted": lambda: selection.boosted_selection(coded, y, listed, times="__n"),
    }
    with ThreadPoolExecutor(len(builders)) as pool:  # independent jobs of one session
        made = dict(zip(builders, pool.map(lambda f: f(), builders.values())))
    def judged(name: str) -> tuple:
        s = made[name]
        frame = s.data.select(*kept, y, s.model.probability().alias("pd")).cache()
        m = metrics.auc(frame, "pd", y, times="__n").first()
        cv = resample.kfold_validation(coded, y, s.selected, id_col, 5, fold="__fold", times="__n").agg(F.avg("auc")).first()[0] if s.selected else m.auc
        signs = float(all(b < 0 for b in s.model.coefficients.values()))
        dec = scorecard.deciles(frame.withColumn("score", scorecard.scaled_score(F.col("pd"))), "score", y, times="__n").agg(F.sum("reversal")).first()[0]
        measures = (scorecard.stability(m.auc, cv), signs, scorecard.parsimony(len(s.selected)), float(dec == 0))
        return (name, m.auc, m.gini, m.ks, *measures, len(s.selected), s.model.pseudo_r2), frame

    with ThreadPoolExecutor(len(made)) as pool:
        results = list(pool.map(judged, made))
    rows, scored = [row for row, _ in results], {row[0]: frame for row, frame in results}
    table = df.sparkSession.createDataFrame(
        rows, "model string, auc double, gini double, ks double, stability double, sign double, parsimony double, monotonicity double, n_variables int, pseudo_r2 double"
    )
    ranked = scorecard.composite(table)
    best = ranked.orderBy(F.desc("composite"), "model").first().model
    frame = scored[best].withColumn("score", scorecard.scaled_score(F.col("pd")))
    graded = scorecard.grades(frame, "score", times="__n")
    scale = scorecard.rating_scale(graded, "grade", y, "pd", "__n")
    rate = ct if ct is not None else frame.agg(F.sum(F.col(y).cast("double") * F.col("__n")) / F.sum("__n")).first()[0]
    scale, _ = scorecard.calibrate(scale, rate)
    m = next(r for r in rows if r[0] == best)
    het = validation.heterogeneity(graded, y, "grade", times="__n").agg(F.max("p_value")).first()[0]
    halves = [r.auc for r in validation.half_split_auc(frame, "pd", y, F.col("__half"), "__n").collect() if r.auc is not None]
    power = validation.predictive_power(scale.where("pdc > 0 and pdc < 1")).collect()
    tests = [(f"binomial test of grade {r.rating}", r.binomial_p) for r in power] + [("Hosmer-Lemeshow test", power[0].hl_p)] * bool(power)
    rates = [(r.rating, r.nb / r.no) for r in sorted(scale.collect(), key=lambda r: r.rating)]  # grades
    overall, flags = validation.assessment({"auc": m[1], "gini": m[2], "ks": m[3], "auc_difference": max(halves) - min(halves) if halves else 0.0}, tests, rates)
    facts = [("auc", m[1], ""), ("gini", m[2], ""), ("ks", m[3], ""), ("heterogeneity max p", het, ""), ("overall", None, overall), *[("flag", None, f) for f in flags]]
    assessment = df.sparkSession.createDataFrame(facts, "measure string, value double, result string")
    # a row's score is that of its factors
    scores = graded.select(*raw.values(), "pd", "score", "grade").dropDuplicates(list(raw.values()))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{r}`")) for c, r in raw.items()] or F.lit(True)
    scored_rows = binned.where(F.col(y).isNotNull()).join(scores, same).select(y, "pd", "score", "grade")
    return Scorecard(best, made[best].model, ranked, scale, assessment, scored_rows)
