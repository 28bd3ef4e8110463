"""Validation tests on application portfolios and rating scales.

Row-level work is one grouped aggregate; tests run on the grades. P-values that queries return use the polynomial normal
cdf of ``functions.dist``, so that they can be checked in SQL.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.dist import beta_cdf, binomial_cdf, chi2_ppf, chi2_sf, f_sf, phi, phi_column, phi_inverse, two_sided
from lendframe.functions.draws import normals
from lendframe.functions.scratch import ship
from lendframe.operators.metrics import cut, quantile_edges


def two_proportions(b1: Column, n1: Column, b2: Column, n2: Column) -> Column:
    """Pooled z of the first share against the second."""
    pool = (b1 + b2) / (n1 + n2)
    spread = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    return F.try_divide(b1 / n1 - b2 / n2, spread)


def heterogeneity(df: DataFrame, y: str, rating: str, alpha: float = 0.05, times: str | None = None) -> DataFrame:
    """Each grade against the one before: one-sided pooled z in the direction of corr(grade code, default). A row counts ``times`` times."""
    rows = df.where(F.col(y).isNotNull() & F.col(rating).isNotNull())
    n = F.col(f"`{times}`") if times else F.lit(1)
    scale = rows.groupBy(F.col(rating).alias("rating")).agg(F.sum(n).alias("no"), F.sum(F.col(y).cast("long") * n).alias("nb"))
    order = Window.orderBy("rating")
    whole = Window.partitionBy()
    code = F.row_number().over(order)
    scale = scale.withColumn("code", code)
    # corr(code, y) from grade sums has the sign of cov = E(code y) - E(code) E(y)
    n = F.sum("no").over(whole)
    lean = F.sum(F.col("code") * F.col("nb")).over(whole) / n - F.sum(F.col("code") * F.col("no")).over(whole) / n * F.sum("nb").over(whole) / n
    scale = scale.withColumns({"greater": lean > 0, "b0": F.lag("nb").over(order), "n0": F.lag("no").over(order)})
    z = two_proportions(F.col("nb"), F.col("no"), F.col("b0"), F.col("n0"))
    out = scale.withColumn("z", z)
    p = F.when(F.col("greater"), 1 - phi_column(F.col("z"))).otherwise(phi_column(F.col("z")))
    return out.select(
        "rating", "no", "nb", (F.col("nb") / F.col("no")).alias("dr"), "z", F.when(F.col("z").isNotNull(), p).alias("p_value")
    ).withColumn("res", F.when(F.col("p_value").isNull(), None).when(F.col("p_value") < alpha, "H1").otherwise("H0"))


def homogeneity(df: DataFrame, y: str, rating: str, segment: str, segments: int = 4, alpha: float = 0.05, numeric: bool = False) -> DataFrame:
    """Within each grade, each segment against the rest: two-sided pooled z, not tested under 30 observations.

    A numeric segment of over 4 distinct values is cut into ``segments`` equally wide intervals, right-closed.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(rating).isNotNull() & F.col(segment).isNotNull())
    seg = F.col(segment).cast("string")
    if numeric:
        row = rows.agg(F.countDistinct(segment), F.min(segment).cast("double"), F.max(segment).cast("double")).first()
        if row[0] > 4:
            width = (row[2] - row[1]) / segments
            seg = F.greatest(F.least(F.ceil((F.col(segment) - row[1]) / width), F.lit(segments)), F.lit(1)).cast("string")
    counts = rows.groupBy(F.col(rating).alias("rating"), seg.alias("segment")).agg(F.count(F.lit(1)).alias("no"), F.sum(F.col(y).cast("long")).alias("nb"))
    grade = Window.partitionBy("rating")
    counts = counts.withColumns({"no_rest": F.sum("no").over(grade) - F.col("no"), "nb_rest": F.sum("nb").over(grade) - F.col("nb")})
    enough = (F.col("no") >= 30) & (F.col("no_rest") >= 30)
    out = counts.withColumn("z", F.when(enough, two_proportions(F.col("nb"), F.col("no"), F.col("nb_rest"), F.col("no_rest"))))
    out = out.withColumn("p_value", F.when(F.col("z").isNotNull(), 2 * (1 - phi_column(F.abs("z")))))
    return out.withColumn("res", F.when(~enough, "Less than 30 observations.").when(F.col("p_value") < alpha, "H1").otherwise("H0"))


def predictive_power(scale: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Binomial, Jeffreys, z-score and Hosmer-Lemeshow (df = number of grades) tests of (rating, pdc, no, nb)."""
    rows = scale.collect()  # grades
    hl = sum((r.nb - r.no * r.pdc) ** 2 / (r.no * r.pdc * (1 - r.pdc)) for r in rows)
    hl_p = chi2_sf(hl, len(rows))
    out = []
    for r in rows:
        z = (r.nb / r.no - r.pdc) / math.sqrt(r.pdc * (1 - r.pdc) / r.no)
        out.append((
            r.rating, int(r.no), int(r.nb), float(r.pdc), 1 - binomial_cdf(int(r.nb) - 1, int(r.no), r.pdc),
            beta_cdf(r.pdc, r.nb + 0.5, r.no - r.nb + 0.5), z, 1 - phi(z), hl, hl_p,
        ))
    return scale.sparkSession.createDataFrame(
        out, "rating string, no long, nb long, pdc double, binomial_p double, jeffreys_p double, z double, zscore_p double, hl double, hl_p double"
    )


def power(scale: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Chance that each test rejects, were the observed rate true: exact sums over the number of defaults.

    ``power_hl`` is that of the Hosmer-Lemeshow test over all grades.
    """
    out = []
    for r in scale.collect():
        odr, n, pdc = r.nb / r.no, int(r.no), r.pdc
        parts = {"binomial": 0.0, "jeffreys": 0.0, "zscore": 0.0}
        spread = math.sqrt(max(n * odr * (1 - odr), 1e-9))
        low, high = max(0, int(n * odr - 10 * spread - 10)), min(n, int(n * odr + 10 * spread + 10))
        for b in range(low, high + 1):
            mass = binomial_cdf(b, n, odr) - binomial_cdf(b - 1, n, odr)
            z = (b / n - pdc) / math.sqrt(pdc * (1 - pdc) / n)
            tests = {"binomial": 1 - binomial_cdf(b - 1, n, pdc), "jeffreys": beta_cdf(pdc, b + 0.5, n - b + 0.5), "zscore": 1 - phi(z)}
            for k, p in tests.items():
                parts[k] += mass * (p < alpha)
        out += [(r.rating, k, v) for k, v in parts.items()]
    return scale.sparkSession.createDataFrame(out, "rating string, test string, power double")


def _binomial_masses(n: int, p: float):
    """Counts of defaults around the expected one, up to 12 standard errors off, and their chances."""
    import numpy as np

    if p <= 0 or p >= 1:
        return np.array([n if p >= 1 else 0]), np.ones(1)
    spread = math.sqrt(n * p * (1 - p))
    low, high = max(0, int(n * p - 12 * spread - 12)), min(n, int(n * p + 12 * spread + 12))
    d = np.arange(low, high + 1)
    steps = np.log((n - d[:-1]) / (d[:-1] + 1)) + math.log(p / (1 - p))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(logs - logs.max())
    return d, mass / mass.sum()


def power_hl_bounds(scale: DataFrame, alpha: float = 0.05, cells: int = 4096) -> tuple[float, float] | None:
    """Bounds on the chance that Hosmer-Lemeshow rejects, were the observed rates true; None unless they exceed the PDs overall.

    The statistic is a sum over grades, so its distribution is the convolution of the grades' terms under their binomials, on a
    grid of ``cells`` steps up to the critical value. Terms rounded down give the lower bound, terms rounded up the upper one.
    Rows are grades; grades with a PD of 0 or 1 have no term.
    """
    import numpy as np

    rows = [r for r in scale.collect() if r.no]
    if sum(r.nb for r in rows) <= sum(r.no * r.pdc for r in rows):
        return None
    step = chi2_ppf(1 - alpha, len(rows)) / cells
    bounds = []
    for rounded in (np.floor, np.ceil):
        held = np.zeros(cells + 1)
        held[0] = 1.0
        for r in rows:
            variance = r.no * r.pdc * (1 - r.pdc)
            if variance <= 0:
                continue
            d, mass = _binomial_masses(int(r.no), r.nb / r.no)
            at = rounded((d - r.no * r.pdc) ** 2 / variance / step)
            # what lies beyond the critical value can't come back
            term = np.bincount(at[at <= cells].astype(int), mass[at <= cells], minlength=cells + 1)
            size = 2 * len(held)
            held = np.fft.irfft(np.fft.rfft(held, size) * np.fft.rfft(term, size), size)[: cells + 1]
        bounds.append(float(min(1.0, max(0.0, 1 - held.sum()))))
    return bounds[0], bounds[1]


def power_hl(scale: DataFrame, alpha: float = 0.05, cells: int = 4096) -> float | None:
    """The middle of ``power_hl_bounds``, off by half their distance at most."""
    bounds = power_hl_bounds(scale, alpha, cells)
    return None if bounds is None else (bounds[0] + bounds[1]) / 2


def normal_test(df: DataFrame, pdc: str, odr: str) -> DataFrame:
    """One-sided test over periods of observed over calibrated rates; ``se`` holds a variance, as is customary here."""
    d = F.col(odr) - F.col(pdc)
    row = df.agg(F.count(d).alias("n"), F.sum(d).alias("s"), F.var_samp(d).alias("se"))
    out = row.withColumn("z", F.try_divide(F.col("s"), F.sqrt(F.col("n") * F.col("se"))))
    return out.withColumn("p_value", 1 - phi_column(F.col("z"))).select("n", F.col("s").alias("estimate"), "se", "z", "p_value")


def dp_testing(auc: float, goods: int, bads: int, auc_test: float, alternative: str = "two.sided", alpha: float = 0.05) -> dict:
    """Hanley-McNeil test of an AUC against a given one."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    se = math.sqrt((auc * (1 - auc) + (bads - 1) * (q1 - auc * auc) + (goods - 1) * (q2 - auc * auc)) / (goods * bads))
    z = (auc - auc_test) / se
    p = {"two.sided": two_sided(z), "less": phi(z), "greater": 1 - phi(z)}[alternative]
    return {"auc": auc, "se": se, "z": z, "p_value": p, "res": "H1" if p < alpha else "H0"}


def psi(base: DataFrame, target: DataFrame, column: str, bins: int = 10, numeric: bool = True) -> DataFrame:
    """Population stability by bin: quantile bins of the base (values if few), or categories; missing sides count 0.

    Both tables use the same edges; shares are floored at 1e-10 in the logarithm.
    """
    if numeric:
        few = base.agg(F.countDistinct(column)).first()[0] <= bins
        if few:  # under ``bins`` values
            points = sorted(r[0] for r in base.select(column).where(F.col(column).isNotNull()).distinct().collect())
            if not points:
                raise ValueError(f"the base has no values of {column}")
            edges = [points[0], *[(a + b) / 2 for a, b in zip(points, points[1:])], points[-1]]
        else:
            edges = quantile_edges(base, column, bins)
        key = cut(F.col(column), edges, right=False).cast("string")
    else:
        key = F.col(column).cast("string")
    side = lambda df, name: df.where(F.col(column).isNotNull()).groupBy(key.alias("bin")).agg(F.count(F.lit(1)).alias(name))
    joined = side(base, "base_no").join(side(target, "target_no"), "bin", "left" if numeric else "full").fillna(0, ["base_no", "target_no"])
    whole = Window.partitionBy()
    shares = joined.withColumns({"base_pct": F.col("base_no") / F.sum("base_no").over(whole), "target_pct": F.col("target_no") / F.sum("target_no").over(whole)})
    floor = F.lit(1e-10)
    a, b = F.col("target_pct"), F.col("base_pct")
    return shares.withColumn("psi", (a - b) * F.log(F.greatest(a, floor) / F.greatest(b, floor)))


def psi_summary(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row for the bins of ``psi``: the index, its two critical values, and the chi-squared form of the index."""
    floor = F.lit(1e-10)
    p, q = F.greatest(F.col("base_pct"), floor), F.greatest(F.col("target_pct"), floor)
    row = table.agg(F.sum("psi").alias("psi"), F.sum((p - q) * (p - q) / p).alias("psi_star"), F.count(F.lit(1)).alias("bins"), F.sum("base_no").alias("n"), F.sum("target_no").alias("m")).first()
    cv = psi_critical(row.bins, row.n, row.m, alpha)
    made = [(row.psi, cv["cv_zscore"], row.psi_star, cv["cv_chisq"], 1 - alpha)]
    return table.sparkSession.createDataFrame(made, "psi double, cv_zscore double, psi_star double, cv_chisq double, ci double")


def psi_critical(bins: int, n_base: int, n_target: int, alpha: float = 0.05) -> dict[str, float]:
    """Critical values of the index: by the normal approximation and by chi-squared, and the sample size factor."""
    factor = 1 / n_base + 1 / n_target
    z = factor * (bins - 1) + phi_inverse(1 - alpha) * factor * math.sqrt(2 * (bins - 1))
    return {"cv_zscore": z, "cv_chisq": chi2_ppf(1 - alpha, bins - 1) * factor, "factor": factor}


def _chi2(counts: DataFrame, *strata: str) -> DataFrame:
    """counts: (strata, outcome, sensitive, n). Pearson's statistic per stratum, Yates-corrected for two by two."""
    whole = Window.partitionBy(*strata)
    full = counts.withColumns({
        "row": F.sum("n").over(Window.partitionBy(*strata, "outcome")), "col": F.sum("n").over(Window.partitionBy(*strata, "sensitive")),
        "all": F.sum("n").over(whole),
    })
    levels = counts.groupBy(*strata).agg(F.countDistinct("outcome").alias("r"), F.countDistinct("sensitive").alias("c"))
    rows = full.join(levels, list(strata)) if strata else full.crossJoin(F.broadcast(levels))  # one row
    expect = F.col("row") * F.col("col") / F.col("all")
    gap = F.abs(F.col("n") - expect)
    gap = F.when((F.col("r") == 2) & (F.col("c") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    # cells without rows add their expected count; the sum of all expected is the total
    return rows.groupBy(*strata).agg(
        (F.sum(gap * gap / expect) + F.max("all") - F.sum(expect)).alias("chi2"), ((F.max("r") - 1) * (F.max("c") - 1)).alias("df")
    )


def fairness_discrete(df: DataFrame, sensitive: str, outcome: str, conditional: str | None = None) -> DataFrame:
    """Statistical parity (chi-squared of outcome by group), or conditional parity (summed over strata)."""
    keys = [F.col(conditional).alias("stratum")] if conditional else []
    counts = df.groupBy(*keys, F.col(outcome).alias("outcome"), F.col(sensitive).alias("sensitive")).agg(F.count(F.lit(1)).alias("n"))
    if not conditional:
        return _chi2(counts)
    return _chi2(counts, "stratum").agg(F.sum("chi2").alias("chi2"), F.sum("df").alias("df"))


def fairness_continuous(df: DataFrame, sensitive: str, outcome: str) -> DataFrame:
    """One-way analysis of variance of a continuous outcome by group, from group sums."""
    g = df.groupBy(sensitive).agg(F.count(outcome).alias("n"), F.sum(outcome).alias("s"), F.sum(F.col(outcome) * F.col(outcome)).alias("q"))
    row = g.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("between"),
        (F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))).alias("within"),
    )
    return row.select((F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"), ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))


def fairness_continuous_conditional(df: DataFrame, sensitive: str, outcome: str, conditional: str) -> tuple[float, int, int]:
    """F statistic and its degrees of freedom: do groups differ in a continuous outcome beside the conditional's levels?

    Both attributes are dummies of one linear model; it and the model without the groups are fitted on the cells' sums.
    """
    import numpy as np

    cells = df.dropna(subset=[sensitive, outcome, conditional]).groupBy(F.col(sensitive).alias("s"), F.col(conditional).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("t"), F.sum(F.col(outcome) * F.col(outcome)).alias("q")
    ).collect()  # levels by levels
    groups, strata = (sorted({r[i] for r in cells}) for i in (0, 1))
    n, t = np.array([r.n for r in cells], dtype=float), np.array([r.t for r in cells], dtype=float)
    own = np.array([[float(r.s == g) for g in groups[1:]] for r in cells]).reshape(len(cells), -1)
    base = np.array([[1.0] + [float(r.c == k) for k in strata[1:]] for r in cells])

    def left(x: np.ndarray) -> float:
        return float(-(b := np.linalg.pinv(x.T @ (x * n[:, None])) @ (x.T @ t)) @ (x.T @ t))

    df1, df2 = own.shape[1], int(n.sum()) - own.shape[1] - base.shape[1]
    total = float(sum(r.q for r in cells))
    full, less = total + left(np.hstack([base, own])), total + left(base)
    return ((less - full) / df1) / (full / df2), df1, df2


def fairness_p(row) -> float:
    return chi2_sf(row.chi2, row.df) if "chi2" in row else f_sf(row.f, row.df1, row.df2)


def fairness_vld(df: DataFrame, sensitive: str, observed: str, modelled: str, conditional: str, discrete: bool = True) -> DataFrame:
    """(test, statistic, p_value): statistical parity, conditional parity and equal opportunity."""
    good = df.where(F.col(observed) == 1)
    if discrete:
        got = {
            "statistical parity": fairness_discrete(df, sensitive, modelled), "conditional parity": fairness_discrete(df, sensitive, modelled, conditional),
            "equal opportunity": fairness_discrete(good, sensitive, modelled),
        }
    else:
        got = {"statistical parity": fairness_continuous(df, sensitive, modelled), "equal opportunity": fairness_continuous(good, sensitive, modelled)}
    rows = [(name, row[0] if discrete else row["f"], fairness_p(row)) for name, t in got.items() for row in [t.first()]]
    if not discrete:
        f, df1, df2 = fairness_continuous_conditional(df, sensitive, modelled, conditional)
        rows.insert(1, ("conditional parity", f, f_sf(f, df1, df2)))
    return df.sparkSession.createDataFrame(rows, "test string, statistic double, p_value double")


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """1 / (1 - R squared) without a constant: the diagonal of the inverse cross-products, from one aggregate."""
    import numpy as np

    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs]).first()
    m = np.zeros((len(columns),) * 2)
    for (i, j), v in zip(pairs, row):
        m[i, j] = m[j, i] = v
    inverse = np.linalg.inv(m)
    return {c: float(m[i, i] * inverse[i, i]) for i, c in enumerate(columns)}


def evrs(df: DataFrame, y: str, pd_est: str, pd_bm: str, id_col: str, lgd: float | str = 0.45, rf: float = 0.02, elasticity: float = 5.0, threshold: float = 0.5, sims: int = 500, seed: int = 991) -> DataFrame:
    """Simulated return of pricing by two PD models observed with noise: one row (sim, model, portfolio_return) each.

    Each model's log odds get a normal error of 0.5, drawn apart for the two from a hash of (seed, id, simulation, model).
    A customer leaves where the chance 1 - exp(-elasticity * overprice) against the spread of the benchmark without error
    reaches the threshold; those who stay bring the spread, or lose ``lgd`` (a number or a column) on default. No customer
    left: 0. Rows with a NULL are left out.
    """
    loss = F.lit(lgd) if isinstance(lgd, float) else F.col(lgd)
    base = df.select(F.col(id_col).alias("id"), F.col(y).alias("y"), F.col(pd_est).alias("e"), F.col(pd_bm).alias("b"), loss.cast("double").alias("lgd")).dropna()
    ship(df.sparkSession)
    # every row is drawn for 2 * sims times, so that the few partitions of a scan would be too few
    dealt = base.select(F.col("id").cast("string"), *[F.col(c).cast("double") for c in ("y", "e", "b", "lgd")]).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    sums = dealt.mapInArrow(partial(_returns, sims=sims, seed=seed, rf=rf, elasticity=elasticity, threshold=threshold), "sim int, model string, total double, n long")
    return sums.groupBy("sim", "model").agg(F.coalesce(F.try_divide(F.sum("total"), F.sum("n")), F.lit(0.0)).alias("portfolio_return"))


def _returns(batches, sims: int, seed: int, rf: float, elasticity: float, threshold: float):
    """Rows (sim, model, total, n) of one partition: the gain of those who stay and their number."""
    import numpy as np
    import pyarrow as pa

    total, n, seen = np.zeros((sims, 2)), np.zeros((sims, 2), dtype=np.int64), False
    asked = lambda p, lgd: (1 + rf) / (1 - np.clip(p * lgd, 0.0, 0.999)) - 1 - rf
    for batch in batches:
        names = np.array([v.encode() for v in batch.column("id").to_pylist()], dtype=object)
        lengths = np.array([len(v) for v in names], dtype=int)
        y, e, b, lgd = (batch.column(c).to_numpy() for c in ("y", "e", "b", "lgd"))
        for length in np.unique(lengths):  # keys of one length are hashed together
            seen, own = True, np.nonzero(lengths == length)[0]
            middles = np.frombuffer(b"".join(names[own]), np.uint8).reshape(len(own), length)
            fair, bad, loss = asked(b[own], lgd[own]), y[own] == 1, lgd[own]
            for m, (model, p) in enumerate((("estimated", e[own]), ("benchmark", b[own]))):
                safe = np.clip(p, 1e-10, 1 - 1e-10)
                odds = np.log(safe / (1 - safe))
                for sim in range(sims):
                    noise = normals(f"{seed}|".encode(), middles, f"|{sim + 1}|{model}".encode())
                    price = asked(1 / (1 + np.exp(-(odds + 0.5 * noise))), loss)
                    stays = 1 - np.exp(-elasticity * np.maximum(price - fair, 0.0)) < threshold
                    total[sim, m] += np.where(bad, -loss, price)[stays].sum()
                    n[sim, m] += np.count_nonzero(stays)
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(1, sims + 1), 2), pa.int32()), pa.array(["estimated", "benchmark"] * sims), pa.array(total.ravel()), pa.array(n.ravel())], names=["sim", "model", "total", "n"]
        )


def evrs_summary(returns: DataFrame) -> DataFrame:
    """Mean, population deviation, least and largest return of each model."""
    r = F.col("portfolio_return")
    return returns.groupBy("model").agg(F.avg(r).alias("mean_return"), F.stddev_pop(r).alias("std_return"), F.min(r).alias("min_return"), F.max(r).alias("max_return"))


def spread(p: Column, lgd: float | Column = 0.45, rf: float = 0.02) -> Column:
    """Credit spread that makes up for expected loss."""
    loss = F.greatest(F.least(p * lgd, F.lit(0.999)), F.lit(0.0))
    return (1 + rf) / (1 - loss) - 1 - rf


#: Least AUC, Gini and KS, and the most that the AUC of halves and the stability index may differ (fixed values).
LEAST = {"auc": 0.70, "gini": 0.35, "ks": 0.30}
MOST = {"auc_difference": 0.05, "psi": 0.25}
MARGIN = 0.01


def assessment(facts: dict[str, float], tests: list[tuple[str, float]], rates: list[tuple[str, float]] = (), alpha: float = 0.05) -> tuple[str, list[str]]:
    """FAIL for too little discrimination, PASS WITH FLAGS if anything else is wrong or marginal, else PASS; and the flags.

    facts: auc, gini, ks, auc_difference, psi; tests: (name, p-value) that should not be significant; rates: default rates
    by grade, which should rise.
    """
    weak = [f"{k} {facts[k]:.4f} < {v}" for k, v in LEAST.items() if k in facts and facts[k] < v]
    flags = weak + [f"{k} {facts[k]:.4f} > {v}" for k, v in MOST.items() if k in facts and facts[k] > v]
    flags += [f"{name} fails (p = {p:.4f})" for name, p in tests if p is not None and p < alpha]
    flags += [f"inverted default rates at {a} and {b}" for (a, x), (b, y) in zip(rates, rates[1:]) if y < x]
    flags += [f"marginal: {name} (p = {p:.4f})" for name, p in tests if p is not None and abs(p - alpha) < MARGIN]
    return ("FAIL" if weak else "PASS WITH FLAGS" if flags else "PASS"), flags


def half_split_auc(df: DataFrame, score: str, y: str, half: Column, times: str | None = None) -> DataFrame:
    from lendframe.operators.metrics import auc

    return auc(df.withColumn("half", half), score, y, "half", times=times)
