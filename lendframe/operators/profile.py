"""Profiling and cleaning: every operator serves all columns with a constant number of shuffles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.dist import chi2_sf, phi_column
from lendframe.functions.special import SC_THRESHOLD, clean, is_numeric, is_special, long_form, require
from lendframe.operators.quantiles import of_counts, values

POINTS = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def univariate(df: DataFrame, columns: list[str], codes: list = (), separately: bool = False, threshold: float = SC_THRESHOLD) -> DataFrame:
    """Per numeric column and kind of case: counts, exact percentiles, mean, its error, signs and outliers.

    Special cases (NULL, NaN, infinite, ``codes``) are one row per column, or one per code if ``separately``.
    """
    require(df, *columns)
    rows = long_form(df, columns, numeric=True).withColumn("sc", is_special(F.col("value"), codes))
    kind = F.when(~F.col("sc"), "complete cases").otherwise(
        F.concat(F.lit("special case "), F.coalesce(F.col("value").cast("string"), F.lit("null"))) if separately else F.lit("special cases")
    )
    rows = rows.withColumn("bin_type", kind)
    x = F.when(~F.col("sc"), F.col("value"))
    first = rows.groupBy("rf", "bin_type").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), F.stddev_samp(x).alias("sd"),
        F.count_if(x < 0).alias("neg"), F.count_if(x > 0).alias("pos"),
    )
    counts = rows.groupBy("rf", "bin_type", "sc", F.col("value").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.where(~F.col("sc"))
    found = of_counts(whole.select("rf", "v", "n"), ["rf"], list(POINTS.values())).select(F.col("rf").alias("q_rf"), F.col("q").alias("pct"))
    spread = 1.5 * (F.col("pct")[4] - F.col("pct")[2])
    outside = (F.col("v") < F.col("pct")[2] - spread) | (F.col("v") > F.col("pct")[4] + spread)
    # one row per column: bounded by the schema
    placed = counts.join(F.broadcast(found), (F.col("rf") == F.col("q_rf")) & ~F.col("sc"), "left")
    more = placed.groupBy(F.col("rf").alias("m_rf"), F.col("bin_type").alias("m_type")).agg(
        F.count("v").alias("cnt_unique"), F.first("pct", True).alias("pct"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("cnt_outliers"),
    )
    total = F.sum("cnt").over(Window.partitionBy("rf"))
    special = F.sum(F.when(F.col("bin_type") != "complete cases", F.col("cnt")).otherwise(0)).over(Window.partitionBy("rf"))
    complete = F.col("bin_type") == "complete cases"
    return first.join(more, (F.col("rf") == F.col("m_rf")) & (F.col("bin_type") == F.col("m_type"))).select(
        "rf", "bin_type", "cnt", (F.col("cnt") / total).alias("pct"), "cnt_unique", "min",
        *[F.col("pct")[i].alias(name) for i, name in enumerate(POINTS)], "avg",
        (F.col("sd") / F.sqrt("cnt")).alias("avg_se"), "max", "neg", "pos",
        F.when(complete, F.col("cnt_outliers")).alias("cnt_outliers"), (special / total > threshold).cast("int").alias("sc_ind"),
    )


def univariate_categorical(df: DataFrame, columns: list[str], codes: list = ()) -> DataFrame:
    rows = long_form(df, columns, numeric=False).withColumn("sc", is_special(F.col("value"), codes, numeric=False))
    kind = F.when(F.col("sc"), "special cases").otherwise("complete cases")
    out = rows.groupBy("rf", kind.alias("bin_type")).agg(F.count(F.lit(1)).alias("cnt"), F.countDistinct("value").alias("cnt_unique"))
    return out.withColumn("pct", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("rf")))


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("rf"), clean(df, c).isNull().alias("gone")) for c in columns])
    return df.select(F.inline(rows)).groupBy("rf").agg(F.count_if("gone").alias("n_missing"), F.avg(F.col("gone").cast("double")).alias("pct_missing"))


def nzv(df: DataFrame, columns: list[str], codes: list[str] = ()) -> DataFrame:
    """Near-zero variance: the two most frequent complete values of each column and their ratio."""
    rows = long_form(df, columns, numeric=False).withColumn("sc", is_special(F.col("value"), codes, numeric=False))
    counts = rows.groupBy("rf", "sc", "value").agg(F.count(F.lit(1)).alias("n"))
    # the two most frequent values by partial aggregates: no task ranks a column
    of = lambda keep: F.min(F.when(keep, F.struct((-F.col("n")).alias("least"), "value")))
    out = counts.groupBy("rf").agg(
        F.sum(F.when(F.col("sc"), F.col("n")).otherwise(0)).alias("sc_num"), F.sum(F.when(~F.col("sc"), F.col("n")).otherwise(0)).alias("cc_num"),
        F.count_if(~F.col("sc")).alias("cc_unique"), of(~F.col("sc")).alias("one"),
    )
    tops = out.select(F.col("rf").alias("t_rf"), F.col("one.value").alias("top"))
    # one row a column
    second = counts.join(F.broadcast(tops), (F.col("rf") == F.col("t_rf")) & ~F.col("sc") & (F.col("value") != F.col("top"))).groupBy(F.col("rf").alias("s_rf")).agg(of(F.lit(True)).alias("two"))
    out = out.join(F.broadcast(second), F.col("rf") == F.col("s_rf"), "left").select(
        "rf", "sc_num", "cc_num", "cc_unique", F.col("one.value").alias("mfq_value"), F.col("two.value").alias("smfq_value"),
        (-F.col("one.least")).alias("mfq"), (-F.col("two.least")).alias("smfq"),
    )
    total = F.col("sc_num") + F.col("cc_num")
    ratio = F.col("mfq") / F.col("smfq")
    share = F.col("cc_num") / total
    return out.withColumns({
        "cc_pct": share, "unique_pct": F.col("cc_unique") / total, "ratio": ratio,
        "ind": F.coalesce((share < 0.1) & (ratio > 19), F.lit(False)).cast("int"),
        "high_freq_ratio": F.coalesce(ratio > 19, F.lit(False)).cast("int"),
    })


def correlation_pairs(df: DataFrame, columns: list[str], least: float = 0.7, times: str | None = None) -> DataFrame:
    """All pairs of columns in one aggregate; at most columns squared rows. With ``times``, how many equal rows a row stands for, in
    two: the second is of differences from the means."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    corr = [F.corr(a, b) for a, b in pairs]
    if times:
        n = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(times)) for a, b in pairs]
        means = df.agg(F.array(*[F.array(*[F.try_divide(F.sum(w * F.col(c)), F.sum(w)) for c in pair]) for pair, w in zip(pairs, n)]).alias("m")).first().m
        known = [(a - F.lit(m[0]), b - F.lit(m[1]), w) for a, b, m, w in ((F.col(a), F.col(b), m, w) for (a, b), m, w in zip(pairs, means, n))]
        corr = [F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a) * F.sum(w * b * b))) for a, b, w in known]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("rf1"), F.lit(b).alias("rf2"), c.alias("corr")) for (a, b), c in zip(pairs, corr)]).alias("p"))
    return row.select(F.inline("p")).where(F.abs("corr") > least)


def normality_p(df: DataFrame, columns: list[str], codes: list = ()) -> dict[str, float]:
    """Pearson's chi-squared normality test of complete cases over ceil(2 n^0.4) equally likely classes."""
    if not columns:
        return {}
    rows = long_form(df, columns, numeric=True).where(~is_special(F.col("value"), codes))
    # a row a column
    moments = {r.rf: r for r in rows.groupBy("rf").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()}
    classes = {rf: math.ceil(2 * r.n**0.4) for rf, r in moments.items() if r.n >= 10 and r.s > 0}
    if not classes:
        return {}
    table = df.sparkSession.createDataFrame([(rf, moments[rf].m, moments[rf].s, k) for rf, k in sorted(classes.items())], "e_rf string, m double, s double, k int")
    share = phi_column((F.col("value") - F.col("m")) / F.col("s"))
    at = F.least(F.floor(share * F.col("k")), F.col("k") - 1)
    counts = rows.join(F.broadcast(table), F.col("rf") == F.col("e_rf")).groupBy("rf", at.alias("class")).count()
    squares = {r.rf: r.q for r in counts.groupBy("rf").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("q")).collect()}
    return {rf: chi2_sf(squares[rf] * k / moments[rf].n - moments[rf].n, k - 3) for rf, k in classes.items()}


def impute(df: DataFrame, columns: list[str], codes: list = (), method: str = "automatic", p_value: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Replace special cases: numbers by mean, median, zero (or by a normality test), strings by the mode.

    Columns with under 10 % complete cases stay as they are. Returns the table and a report with one row a column.
    """
    if method not in ("automatic", "mean", "median", "zero"):
        raise ValueError("method: automatic, mean, median or zero")
    require(df, *columns)
    special = {c: is_special(clean(df, c), codes, numeric=is_numeric(df, c)) for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        x = F.when(~special[c], clean(df, c))
        aggs += [F.count(x).alias(f"n{i}"), (F.avg(x) if is_numeric(df, c) else F.lit(None)).alias(f"v{i}")]
    numbers = {c: F.when(~special[c], clean(df, c)) for c in columns if is_numeric(df, c)}
    medians = values(df, numbers, [0.5]) if method in ("automatic", "median") else {}
    texts = [c for c in columns if c not in numbers]
    modes = {r.rf: r.mfq_value for r in nzv(df, texts, codes).collect()} if texts else {}
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    p = normality_p(df, [c for c in columns if is_numeric(df, c)], codes) if method == "automatic" else {}
    report, new = [], {}
    for i, c in enumerate(columns):
        share, value, how = (row[f"n{i}"] / row["n"] if row["n"] else 0.0), row[f"v{i}"] if c in numbers else modes.get(c), "mode"
        if is_numeric(df, c):
            how = method if method != "automatic" else "median" if p.get(c, 1.0) < p_value else "mean"
            value = 0.0 if how == "zero" else value if how == "mean" else medians.get(c, [None])[0]
            if value is not None and df.schema[c].dataType.typeName() in ("integer", "long", "short", "byte"):
                value = float(round(value))
        done = share >= 0.1 and value is not None
        if done:
            new[c] = F.when(special[c], F.lit(value).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`"))
        report.append((c, how if done else "skipped", None if value is None else str(value), row["n"] - row[f"n{i}"]))
    return df.withColumns(new), df.sparkSession.createDataFrame(report, "rf string, method string, value string, n_replaced long")


def winsorise(df: DataFrame, columns: list[str], codes: list = (), method: str = "iqr", range_val: float = 1.5, lower: float = 0.05, upper: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Cap complete cases at the IQR fences or at percentiles; special cases and strings stay."""
    require(df, *columns)
    numeric = [c for c in columns if is_numeric(df, c)]
    points = [0.25, 0.75] if method == "iqr" else [lower, upper]
    x = {c: F.when(~is_special(clean(df, c), codes), clean(df, c)) for c in numeric}
    found = values(df, x, points)
    new, report = {}, []
    for c in [c for c in numeric if c in found]:
        low, high = found[c]
        if method == "iqr":
            low, high = low - range_val * (high - low), high + range_val * (high - low)
        capped = F.when(x[c] > high, F.lit(high)).when(x[c] < low, F.lit(low)).otherwise(F.col(f"`{c}`").cast("double"))
        new[c] = capped
        report.append((c, low, high))
    return df.withColumns(new), df.sparkSession.createDataFrame(report, "rf string, lower double, upper double")


def fold_safe_caps(df: DataFrame, fold: str, columns: list[str], folds: list[int]) -> DataFrame:
    """Upper IQR fence of each column for each fold, from the rows of the other folds."""
    cells = F.array(*[F.struct(F.lit(c).alias("rf"), clean(df, c).cast("double").alias("v")) for c in columns])
    counts = df.select(F.col(fold).alias("own"), F.inline(cells)).where(F.col("v").isNotNull()).groupBy("own", "rf", "v").agg(F.count(F.lit(1)).alias("n"))
    others = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col("own"))
    spread = counts.select(F.explode(others).alias("fold"), "rf", "v", "n").groupBy("fold", "rf", "v").agg(F.sum("n").alias("n"))
    q = F.col("q")
    return of_counts(spread, ["fold", "rf"], [0.25, 0.75]).select("fold", "rf", (q[1] + 1.5 * (q[1] - q[0])).alias("upper_cap"))
