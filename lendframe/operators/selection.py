"""Stepwise selection: one greedy engine, with scorers for MIV and likelihood steps, and block-wise models.

A factor is a term of one column (as it is, or coded by weight of evidence) or of several (dummies of its levels). Terms of
one column are judged by their coefficient, terms of several by a joint Wald test.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.dist import chi2_sf
from lendframe.functions.special import clean, is_numeric, require, require_binary
from lendframe.operators.boosting import Params, fit_boosted
from lendframe.operators.glm import Logit, compress, fit_logit
from lendframe.operators.quantiles import sliced
from lendframe.operators.woe import MOST_LEVELS, woe_table, woe_table_expected, with_woe

CODINGS = (None, "WoE", "dummy", "mixed")
METHODS = ("stepMIV", "stepFWD", "stepRPC")


@dataclass(frozen=True)
class Selection:
    selected: list[str]
    steps: DataFrame
    model: Logit
    data: DataFrame
    warnings: list[str] = field(default_factory=list)


def parse_formula(formula: str) -> tuple[str, list[str]]:
    target, _, right = formula.partition("~")
    return target.strip(), [t for t in (x.strip() for x in right.split("+")) if t and t != "1"]


def _start(target: str, start: str | list[str]) -> tuple[str, list[str]]:
    """``start``: names, or a formula that names the target too."""
    if isinstance(start, str):
        named, names = parse_formula(start)
        if target and named != target:
            raise ValueError(f"the start model is for {named}, not for {target}")
        return named, names
    return target, list(start)


def coded(df: DataFrame, target: str, factors: list[str], coding: str | None, plain: list[str] = (), times: str | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """The table with coded columns, and the columns of each factor's term; ``plain`` factors stay as they are.

    Dummies: a 0/1 column for each level but the first in sorted order, NULL being a level; at most ten levels. Mixed: numbers stay
    as they are, other factors get dummies. A row counts ``times`` times, here and below.
    """
    if coding not in CODINGS:
        raise ValueError("coding: WoE, dummy, mixed or None")
    terms = {c: [c] for c in factors}
    names = [c for c in factors if c not in plain and not (coding == "mixed" and is_numeric(df, c))]
    if coding == "WoE" and names:
        df = with_woe(df, target, names, times)
        terms |= {c: [f"{c}_woe"] for c in names}
    if coding in ("dummy", "mixed") and names:
        made: dict[str, Column] = {}
        n = {r.rf: r.n for r in woe_table(df, names, target).groupBy("rf").agg(F.count(F.lit(1)).alias("n")).collect()}
        if wide := [c for c in names if n.get(c, 0) > MOST_LEVELS + 1]:
            raise ValueError(f"over {MOST_LEVELS} levels, too many for dummies: {', '.join(wide)}")
        levels: dict[str, list] = {}
        for r in woe_table(df, names, target).select("rf", "bin").collect():  # ten levels a factor
            levels.setdefault(r.rf, []).append(r.bin)
        for c in names:
            rest = sorted(levels.get(c, []), key=lambda v: (v is None, v))[1:]
            terms[c] = [f"{c}__{'NULL' if v is None else v}" for v in rest]
            made |= {name: F.col(f"`{c}`").cast("string").eqNullSafe(F.lit(v)).cast("int") for name, v in zip(terms[c], rest)}
        df = df.withColumns(made)
    return df, terms


def miv_table(df: DataFrame, target: str, candidates: list[str], pd_col: str, compat: bool = False, times: str | None = None) -> DataFrame:
    """Marginal information value of each candidate: observed against expected WoE, and its G-statistic.

    ``compat``: expected counts as of whole numbers only, so that the expected WoE is 0 and MIV is plain IV.
    """
    seen = woe_table(df, candidates, target, times).select("rf", "bin", "no", "ng", "nb", "dist_g", "dist_b", "woe")
    expect = woe_table_expected(df, candidates, pd_col, times).select(
        F.col("rf").alias("e_rf"), F.col("bin").alias("e_bin"), F.col("ng").alias("e_g"), F.col("nb").alias("e_b"), F.col("woe").alias("e_woe")
    )
    rows = seen.join(expect, (F.col("rf") == F.col("e_rf")) & F.col("bin").eqNullSafe(F.col("e_bin")), "full")
    floor, zero = F.lit(1e-10), F.lit(0.0)
    ng, nb = F.coalesce("ng", zero), F.coalesce("nb", zero)
    e_woe = F.lit(0.0) if compat else F.coalesce("e_woe", zero)
    part = (F.coalesce("dist_g", zero) - F.coalesce("dist_b", zero)) * (F.coalesce("woe", zero) - e_woe)
    term = lambda o, e: F.when(o > 0, 2 * o * F.log(o / F.greatest(F.coalesce(e, zero), floor))).otherwise(0.0)
    return rows.groupBy("rf").agg(
        F.sum(part).alias("miv"), F.sum(term(ng, F.col("e_g")) + term(nb, F.col("e_b"))).alias("g_stat"), (F.count(F.lit(1)) - 1).alias("df")
    )


class Fitter:
    """Fits of terms on one table. Coded factors have few distinct rows: then one pass compresses the table and all fits run on that."""

    def __init__(self, df: DataFrame, target: str, terms: dict[str, list[str]], offset: str | None = None, times: str | None = None):
        self.df, self.target, self.terms, self.offset, self.times = df, target, terms, offset, times
        columns = list(dict.fromkeys([target, *(c for t in terms.values() for c in t), *([offset] if offset else [])]))
        self.cells = compress(df.dropna(subset=columns), columns, times)

    def __call__(self, factors: list[str]) -> Logit:
        names = [c for f in factors for c in self.terms[f]]
        return self.cells.fit(self.target, names, self.offset) if self.cells else fit_logit(self.df, self.target, names, self.offset, weight=self.times)

    def p_value(self, fit: Logit, factor: str) -> float:
        names = self.terms[factor]
        return fit.p_value(names[0]) if len(names) == 1 else fit.wald_p(names) if names else 1.0

    def sign_ok(self, fit: Logit, factor: str, sign: int) -> bool:
        names = self.terms[factor]
        return not sign or len(names) != 1 or fit.coefficients[names[0]] * sign > 0


def checked(fit: Fitter, model: Logit, start: list[str], p_value: float, sign: int) -> list[str]:
    """What is wrong with the terms of a start model."""
    out = [f"{c}: not significant in the start model" for c in start if fit.p_value(model, c) >= p_value]
    return out + [f"{c}: coefficient of the wrong sign in the start model" for c in start if not fit.sign_ok(model, c, sign)]


def step_miv(
    df: DataFrame, target: str, candidates: list[str], miv_threshold: float = 0.02, p_value: float = 0.05, compat: bool = False,
    start: str | list[str] = (), coding: str = "WoE", coding_start: bool = True, offset: str | None = None,
    times: str | None = None,
) -> Selection:
    """Add the candidate of the largest MIV while it exceeds the threshold and its G-test is significant.

    The current model is fitted once a step, and one grouped pass scores all candidates. Ties go by name. ``start``: a
    formula or names that are in the model from the beginning, coded too unless ``coding_start`` is off.
    """
    target, first = _start(target, start)
    require(df, target, *first, *candidates)
    require_binary(df, target)
    candidates = [c for c in candidates if c not in first]
    base, terms = coded(df.where(F.col(target).isNotNull()), target, [*first, *candidates], coding, [] if coding_start else first, times)
    fit = Fitter(base, target, terms, offset, times)
    chosen, steps = list(first), []
    while True:
        model = fit(chosen)
        left = [c for c in candidates if c not in chosen]
        if not left:
            break
        scored = miv_table(base.withColumn("__pd", model.probability(F.col(offset) if offset else None)), target, left, "__pd", compat, times).collect()
        best = max(sorted(scored, key=lambda r: r.rf), key=lambda r: r.miv)
        p = chi2_sf(best.g_stat, best.df) if best.df else 1.0
        if best.miv <= miv_threshold or p >= p_value:
            break
        chosen.append(best.rf)
        steps.append((len(steps) + 1, best.rf, float(best.miv), float(best.g_stat), p))
    table = df.sparkSession.createDataFrame(steps, "step int, rf string, miv double, g_stat double, p_value double")
    return Selection(chosen, table, model, base)


Rule = Callable[[Fitter, Logit, str, list[str]], float | None]


def greedy(fit: Fitter, candidates: list[str], rule: Rule, start: list[str] = ()) -> tuple[list[str], list[tuple], Logit]:
    """Fit each candidate with what is chosen; ``rule`` gives its rank (smaller is better) or None. Ties go by name."""
    chosen, steps = list(start), []
    model = fit(chosen)
    while left := sorted(c for c in candidates if c not in chosen):
        fits = [(rank, c, m) for c in left for m in [fit([*chosen, c])] for rank in [rule(fit, m, c, [*chosen, c])] if rank is not None]
        if not fits:
            break
        _, name, model = min(fits, key=lambda x: (x[0], x[1]))
        chosen.append(name)
        names = fit.terms[name]
        steps.append((len(steps) + 1, name, model.coefficients[names[0]] if len(names) == 1 else None, fit.p_value(model, name), model.aic))
    return chosen, steps, model


def _p_rule(p_value: float, sign: int, free: list[str] = ()) -> Rule:
    """The candidate's own p-value; ``free`` factors may have any sign."""
    def rule(fit: Fitter, model: Logit, name: str, _: list[str]) -> float | None:
        p = fit.p_value(model, name)
        return p if p < p_value and (name in free or fit.sign_ok(model, name, sign)) else None
    return rule


def _size_rule(p_value: float, sign: int, free: list[str] = ()) -> Rule:
    """Among significant candidates the largest coefficient."""
    def rule(fit: Fitter, model: Logit, name: str, _: list[str]) -> float | None:
        ok = fit.p_value(model, name) < p_value and (name in free or fit.sign_ok(model, name, sign))
        return -max(abs(model.coefficients[c]) for c in fit.terms[name]) if ok else None
    return rule


def concordance(df: DataFrame, y: str, columns: list[str]) -> dict[str, float]:
    """Share of (bad, good) pairs in which the bad row has the larger value, ties one half, less one half, for all columns at once.

    It has the sign of the rank correlation with a 0/1 target. NULL, NaN and infinite values are left out; a column without a pair
    is left out. Values are counted, cut into slices and summed up by slice, so that no task holds a column.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("rf"), clean(df, c).cast("double").alias("v")) for c in columns])
    long = df.where(F.col(y).isNotNull()).select(F.col(y).alias("y"), F.inline(cells)).where(F.col("v").isNotNull())
    rows = sliced(long.groupBy("rf", "v").agg(F.count_if(F.col("y") == 0).alias("g"), F.count_if(F.col("y") == 1).alias("b")), ["rf"])
    before = Window.partitionBy("rf").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most as many rows a column as there are slices
    starts = rows.groupBy("rf", "slice").agg(F.sum("g").alias("n")).select(F.col("rf").alias("s_rf"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    joined = rows.join(F.broadcast(starts), (F.col("rf") == F.col("s_rf")) & (F.col("slice") == F.col("s")))
    below = F.coalesce(F.sum("g").over(Window.partitionBy("rf", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = joined.withColumn("won", F.col("b") * (F.col("start") + below + F.col("g") / 2))
    got = won.groupBy("rf").agg((F.try_divide(F.sum("won"), F.sum("g") * F.sum("b")) - 0.5).alias("c")).collect()
    return {r.rf: r.c for r in got if r.c is not None}


def _midranks(values: list[float]) -> list[float]:
    return [sum(w < v for w in values) + sum(w == v for w in values) / 2 for v in values]


Trend = dict[str, float | dict[str, float]]


def observed_trends(df: DataFrame, target: str, terms: dict[str, list[str]], source: DataFrame) -> Trend:
    """What the data say of each factor: the sign of its rank correlation with the target, or for dummies the default rate of each
    level less that of the reference level. Factors and levels without data are left out."""
    single = [c for c, names in terms.items() if len(names) == 1 and not names[0].startswith(f"{c}__")]
    many = [c for c in terms if c not in single]
    found = concordance(df, target, [terms[c][0] for c in single]) if single else {}
    out: Trend = {c: found[terms[c][0]] for c in single if terms[c][0] in found}
    if many:
        rates: dict[str, dict] = {}
        for r in woe_table(source, many, target).select("rf", "bin", "dr").collect():  # ten levels a factor
            rates.setdefault(r.rf, {})[f"{r.rf}__{'NULL' if r.bin is None else r.bin}"] = r.dr
        for c, by in rates.items():
            reference = [v for k, v in by.items() if k not in terms[c]]
            if len(reference) == 1 and reference[0] is not None:
                out[c] = {k: v - reference[0] for k, v in by.items() if k in terms[c] and v is not None}
    return out


def consistent(fit: Logit, names: list[str], seen: float | dict[str, float] | None) -> bool:
    """Whether coefficients go with the data: a number's sign; for dummies each sign and the order of the levels."""
    if seen is None:
        return True
    if not isinstance(seen, dict):
        return bool(np.sign(seen) == np.sign(fit.coefficients[names[0]]))
    levels = [n for n in names if n in seen]
    gaps, slopes = [seen[n] for n in levels], [fit.coefficients[n] for n in levels]
    return all(np.sign(g) == np.sign(b) for g, b in zip(gaps, slopes)) and _midranks(gaps) == _midranks(slopes)


def _aic_rule(p_value: float, sign: int, trends: Trend | None = None, unchecked: list[str] = ()) -> Rule:
    """AIC, where all terms of the model stay significant and keep their sign, or go with the data if ``trends`` are given."""
    def rule(fit: Fitter, model: Logit, _: str, names: list[str]) -> float | None:
        for n in names:
            if n in unchecked:
                continue
            right = fit.sign_ok(model, n, sign) and (trends is None or consistent(model, fit.terms[n], trends.get(n)))
            if not right or fit.p_value(model, n) >= p_value:
                return None
        return model.aic
    return rule


STEPS = "step int, rf string, coefficient double, p_value double, aic double"


def _prepared(df: DataFrame, target: str, candidates: list[str], start, coding, coding_start, offset, times=None) -> tuple[Fitter, str, list[str], list[str]]:
    target, first = _start(target, start)
    require(df, target, *first, *candidates, *([offset] if offset else []))
    require_binary(df, target)
    candidates = [c for c in candidates if c not in first]
    rows = df.where(F.col(target).isNotNull())
    if coding is None:
        rows = rows.dropna(subset=[*first, *candidates])
    rows, terms = coded(rows, target, [*first, *candidates], coding, [] if coding_start else first, times)
    return Fitter(rows, target, terms, offset, times), target, first, candidates


def _selection(df: DataFrame, fit: Fitter, chosen: list[str], steps: list[tuple], model: Logit, warnings: list[str]) -> Selection:
    return Selection(chosen, df.sparkSession.createDataFrame(steps, STEPS), model, fit.df, warnings)


def _by_aic(fit: Fitter, df: DataFrame, target: str, p_value: float, sign: int, trend: bool, unchecked: list[str]) -> Rule:
    return _aic_rule(p_value, sign, observed_trends(fit.df, target, fit.terms, df) if trend else None, unchecked)


def step_fwd(
    df: DataFrame, target: str, candidates: list[str], p_value: float = 0.05, sign: int = -1, offset: str | None = None,
    start: str | list[str] = (), coding: str | None = None, coding_start: bool = True, check_start: bool = True, by_aic: bool = False, trend: bool = False,
    times: str | None = None,
) -> Selection:
    """Forward by the lowest p-value. ``sign``: of accepted coefficients, -1 for WoE with bad = 1, 0 for any.

    ``start``: a formula or names that are in the model from the beginning; their terms are checked and complaints are in
    ``warnings``. ``coding``: None for columns that are coded already, WoE, dummy or mixed. Trends are not taken with ``times``.
    """
    if trend and times:
        raise ValueError("trend: of rows that are not counted")
    fit, target, first, rest = _prepared(df, target, candidates, start, coding, coding_start, offset, times)
    rule = _by_aic(fit, df, target, p_value, sign, trend, () if check_start else first) if by_aic else _p_rule(p_value, sign)
    chosen, steps, model = greedy(fit, rest, rule, first)
    return _selection(df, fit, chosen, steps, model, checked(fit, fit(first), first, p_value, sign) if check_start and first else [])


def step_fwdr(df: DataFrame, target: str, candidates: list[str], p_value: float = 0.05, sign: int = 0, offset: str | None = None, trend: bool = True, **more) -> Selection:
    """Forward by AIC among candidates with which all terms stay significant and go with the data; see ``step_fwd``.

    With the data goes a number whose coefficient has the sign of its rank correlation with the target, and a factor in dummies
    whose coefficients have the signs and the order of its levels' default rates against the reference level.
    """
    return step_fwd(df, target, candidates, p_value, sign, offset, by_aic=True, trend=trend, **more)


def step_rpc(
    df: DataFrame, target: str, profile: dict[str, int], p_value: float = 0.05, sign: int = -1, by_aic: bool = False, offset: str | None = None,
    start: str | list[str] = (), coding: str | None = None, coding_start: bool = True, check_start: bool = True, trend: bool = False,
) -> Selection:
    """Forward within groups of candidates, by ascending priority; each group starts from what is chosen. See ``step_fwd``."""
    fit, target, first, rest = _prepared(df, target, list(profile), start, coding, coding_start, offset)
    chosen, steps, model = list(first), [], fit(first)
    rule = _by_aic(fit, df, target, p_value, sign, trend, () if check_start else first) if by_aic else _p_rule(p_value, sign)
    for group in sorted(set(profile.values())):
        chosen, more, model = greedy(fit, [c for c in rest if profile[c] == group], rule, chosen)
        steps += [(len(steps) + i + 1, *m[1:]) for i, m in enumerate(more)]
    return _selection(df, fit, chosen, steps, model, checked(fit, fit(first), first, p_value, sign) if check_start and first else [])


def step_rpcr(df: DataFrame, target: str, profile: dict[str, int], p_value: float = 0.05, sign: int = 0, trend: bool = True, **more) -> Selection:
    """``step_rpc`` by AIC, with the checks of ``step_fwdr``."""
    return step_rpc(df, target, profile, p_value, sign, by_aic=True, trend=trend, **more)


def forward_or_any(df: DataFrame, target: str, candidates: list[str], p_value: float = 0.05, sign: int = -1, **more) -> Selection:
    """``step_fwd``; where no candidate is significant with the right sign, any significant one will do."""
    got = step_fwd(df, target, candidates, p_value, sign, **more)
    return got if got.selected else step_fwd(df, target, candidates, p_value, 0, **more)


def by_importance(importance: dict[str, float], share: float = 0.90, least: int = 4, most: int = 12) -> list[str]:
    """Factors by descending importance until they make up ``share`` of all, the one that crosses it included; ties by name."""
    ranked = sorted(importance, key=lambda c: (-importance[c], c))
    total, run, picked = sum(importance.values()), 0.0, []
    for c in ranked:
        picked.append(c)
        run += importance[c]
        if run > share * total:
            break
    return ranked[: min(max(len(picked), least), most)]


def swap_search(fit: Fitter, ranked: list[str], names: list[str], p_value: float, sign: int, rounds: int = 3) -> tuple[list[str], Logit, list[str]]:
    """Mends a model by its ranking: terms of the wrong sign give way, worst rank first, to the next candidates not tried yet.

    Each round swaps out all terms of the wrong sign and refits; after ``rounds`` those that are left are dropped, and so are terms
    without significance, the weakest first.
    """
    model, out, said = fit(names), list(names), []
    waiting = [c for c in ranked if c not in out]
    for _ in range(rounds):
        wrong = [c for c in ranked[::-1] if c in out and not fit.sign_ok(model, c, sign)]
        if not wrong or not waiting:
            break
        for c in wrong:
            out.remove(c)
            if waiting:
                new = waiting.pop(0)
                out.append(new)
                said.append(f"{c}: wrong sign, swapped for {new}")
            else:
                said.append(f"{c}: wrong sign, left out")
        model = fit(out)
    while out:
        bad = [c for c in out if not fit.sign_ok(model, c, sign) or fit.p_value(model, c) >= p_value]
        if not bad:
            break
        worst = max(bad, key=lambda c: (not fit.sign_ok(model, c, sign), fit.p_value(model, c), c))
        said.append(f"{worst}: left out of the boosted selection")
        out.remove(worst)
        model = fit(out)
    return out, model, said


def boosted_selection(df: DataFrame, target: str, candidates: list[str], p_value: float = 0.05, sign: int = -1, trees: int = 40, depth: int = 4, seed: int = 42, times: str | None = None) -> Selection:
    """Candidates by the gain of their splits in boosted trees, then a logit of them, mended by ``swap_search``."""
    rows = df.dropna(subset=[target, *candidates])
    fit = Fitter(rows, target, {c: [c] for c in candidates}, times=times)
    if fit.cells:  # the trees see the distinct rows with their counts
        made = pd.DataFrame({**{c: fit.cells.columns[c].astype(float) for c in [target, *candidates]}, "__w": fit.cells.count.astype(float)})
        ready = df.sparkSession.createDataFrame(made)
    else:
        ready = rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in [target, *candidates]], (F.col(f"`{times}`").cast("double") if times else F.lit(1.0)).alias("__w"))
    ready = ready.withColumn("__id", F.xxhash64(target, *candidates))
    learner = fit_boosted(ready, target, "__id", list(candidates), [], [Params(trees=trees, leaves=2**depth, depth=depth, seed=seed)], weight="__w")
    importance = learner.importance()
    ranked = sorted(importance, key=lambda c: (-importance[c], c))
    names, logit, warnings = swap_search(fit, ranked, by_importance(importance), p_value, sign)
    steps = [(i + 1, c, logit.coefficients[c], logit.p_value(c), logit.aic) for i, c in enumerate(names)]
    return _selection(df, fit, names, steps, logit, warnings)


def blocks(
    df: DataFrame, target: str, plan: dict[str, str], kind: str = "staged", p_value: float = 0.05, sign: int = -1, method: str = "stepFWD",
    priority: dict[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Models of blocks of candidates, in the order of block names; ``plan`` maps candidates to blocks.

    staged: the linear predictors of earlier blocks are the offset. embedded: the predicted probabilities of all earlier
    blocks are candidates of any sign. ensemble: blocks by themselves, and a logit of their predictions. ``method``:
    stepFWD goes by p-value, stepMIV by the size of significant coefficients, stepRPC by p-value within ``priority``
    groups. Returns the scored table and the steps.
    """
    if kind not in ("staged", "embedded", "ensemble") or method not in METHODS:
        raise ValueError("kind: staged, embedded or ensemble; method: stepMIV, stepFWD or stepRPC")
    rows = df.dropna(subset=[target, *plan])
    steps, scores = [], []
    for block in sorted(set(plan.values())):
        names = [c for c, b in plan.items() if b == block]
        offset = "__offset" if kind == "staged" and scores else None
        earlier = list(scores) if kind == "embedded" else []
        fit = Fitter(rows, target, {c: [c] for c in [*names, *earlier]}, offset)
        rule = (_size_rule if method == "stepMIV" else _p_rule)(p_value, sign, earlier)
        groups = {c: (priority or {}).get(c, 0) for c in names} if method == "stepRPC" else dict.fromkeys(names, 0)
        groups |= dict.fromkeys(earlier, max(groups.values(), default=0))
        chosen, more, model = [], [], fit([])
        for group in sorted(set(groups.values())):
            chosen, found, model = greedy(fit, [c for c, g in groups.items() if g == group], rule, chosen)
            more += found
        name = f"pred_{block}"
        score = model.linear(F.col(offset) if offset else None)
        rows = rows.withColumn(name, 1 / (1 + F.exp(-score)) if kind == "embedded" else score)
        if kind == "staged":
            rows = rows.withColumn("__offset", F.col(name))
        scores.append(name)
        steps += [(block, i + 1, *m[1:]) for i, m in enumerate(more)]
    if kind == "ensemble":
        rows = rows.withColumn("prediction", fit_logit(rows, target, scores).probability())
    else:
        rows = rows.withColumn("prediction", F.col(scores[-1]) if kind == "embedded" else 1 / (1 + F.exp(-F.col(scores[-1]))))
    return rows.drop("__offset"), df.sparkSession.createDataFrame(steps, f"block string, {STEPS}")
