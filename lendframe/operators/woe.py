"""Weight of evidence and information value: many columns in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.special import FLOOR, SC_LABEL, counted, is_numeric, long_form, require

MOST_LEVELS = 10


def woe_of(dist_g: Column, dist_b: Column) -> Column:
    return F.log(F.greatest(dist_g, F.lit(FLOOR)) / F.greatest(dist_b, F.lit(FLOOR)))


def _table(rows: DataFrame, keys: list[str], good: Column, bad: Column, count: Column) -> DataFrame:
    counts = rows.groupBy(*keys).agg(count.alias("no"), good.alias("ng"), bad.alias("nb"))
    # totals by partial aggregates: a column of very many levels is in no one task
    whole = keys[:-1]
    totals = counts.groupBy(*[F.col(k).alias(f"t_{k}") for k in whole]).agg(F.sum("no").alias("so"), F.sum("ng").alias("sg"), F.sum("nb").alias("sb"))
    out = counts.join(F.broadcast(totals), [F.col(k) == F.col(f"t_{k}") for k in whole]).drop(*[f"t_{k}" for k in whole])  # a row a column
    out = out.withColumns({
        "pct_o": F.try_divide("no", "so"), "pct_g": F.try_divide("ng", "sg"), "pct_b": F.try_divide("nb", "sb"),
        "dr": F.try_divide("nb", "no"), "dist_g": F.try_divide("ng", "sg"), "dist_b": F.try_divide("nb", "sb"),
    })
    out = out.withColumn("woe", woe_of(F.col("dist_g"), F.col("dist_b")))
    out = out.withColumn("iv_b", (F.col("dist_g") - F.col("dist_b")) * F.col("woe"))
    sums = out.groupBy(*[F.col(k).alias(f"s_{k}") for k in whole]).agg(F.sum("iv_b").alias("iv_s"))
    return out.join(F.broadcast(sums), [F.col(k) == F.col(f"s_{k}") for k in whole]).drop(*[f"s_{k}" for k in whole])


def woe_table(df: DataFrame, columns: list[str], target: str, times: str | None = None) -> DataFrame:
    """One row per (rf, bin): counts, shares, default rate, WoE = ln(share of goods / share of bads) and IV.

    NULL is a bin; rows without a target aren't counted. Shares are floored at 1e-10 in WoE only. A row stands for as many equal
    ones as ``times`` says, here and below.
    """
    require(df, target, *columns)
    rows = long_form(df, columns, target, *([times] if times else []), numeric=False).withColumnRenamed("value", "bin")
    y = F.col(target)
    return _table(rows, ["rf", "bin"], counted(y == 0, times), counted(y == 1, times), counted(y.isNotNull(), times))


def woe_table_expected(df: DataFrame, columns: list[str], pd_col: str, times: str | None = None) -> DataFrame:
    """The same table for expected counts: goods are the sum of 1 - p and bads the sum of p."""
    rows = long_form(df, columns, pd_col, *([times] if times else []), numeric=False).withColumnRenamed("value", "bin")
    p, n = F.col(pd_col), F.col(f"`{times}`") if times else F.lit(1)
    return _table(rows, ["rf", "bin"], F.sum((1 - p) * n), F.sum(p * n), counted(p.isNotNull(), times))


def auc_of_bins(table: DataFrame) -> DataFrame:
    """AUC of a model saturated in the bins: Mann-Whitney over bins by default rate, NULL bin left out."""
    by = Window.partitionBy("rf").orderBy("dr")
    bins = table.where(F.col("bin").isNotNull() & (F.col("no") > 0)).groupBy("rf", "dr").agg(F.sum("ng").alias("g"), F.sum("nb").alias("b"))
    below = F.coalesce(F.sum("g").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        bins.withColumn("won", F.col("b") * (below + F.col("g") / 2)).groupBy("rf")
        .agg(F.sum("won").alias("won"), F.sum("g").alias("g"), F.sum("b").alias("b"))
        .select("rf", F.when(F.col("g") + F.col("b") >= 10, F.try_divide("won", F.col("g") * F.col("b"))).alias("auc"))
    )


def levels(df: DataFrame, columns: list[str]) -> dict[str, int]:
    row = df.agg(*[F.countDistinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def bivariate(df: DataFrame, target: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """WoE table and AUC of the categorical columns. Info: code 1 numeric (left out), code 2 over ten levels (left out)."""
    numeric = [c for c in columns if is_numeric(df, c)]
    rest = [c for c in columns if c not in numeric]
    n = levels(df, rest) if rest else {}
    wide = [c for c in rest if n[c] > MOST_LEVELS]
    table = woe_table(df, [c for c in rest if c not in wide], target)
    auc = auc_of_bins(table).withColumnRenamed("rf", "a_rf")
    info = df.sparkSession.createDataFrame([(c, 1) for c in numeric] + [(c, 2) for c in wide], "rf string, info_code int")
    return table.join(F.broadcast(auc), F.col("rf") == F.col("a_rf"), "left").drop("a_rf"), info


def lookup(value: Column, mapping: dict, null_value=None) -> Column:
    """A folded map: unmapped and NULL give ``null_value``."""
    pairs = [x for k, v in mapping.items() if k is not None for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None)
    return F.coalesce(F.when(value.isNotNull(), found), F.lit(null_value))


#: Levels of a table of columns that go into the plan as maps; columns of more are joined to their table.
MAPPED_LEVELS = 1000


def _woe_of(df: DataFrame, target: str, columns: list[str], names: dict[str, str], times: str | None = None) -> DataFrame:
    """``df`` with the WoE of each column under its name: by a map in the plan if levels are few, by a join if they are many."""
    table = woe_table(df, columns, target, times).select("rf", "bin", "woe")
    counts = {r.rf: r.n for r in table.groupBy("rf").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [c for c in columns if counts.get(c, 0) <= MAPPED_LEVELS]
    maps: dict[str, dict] = {c: {} for c in few}
    for r in table.where(F.col("rf").isin(few)).collect() if few else []:
        maps[r.rf][r.bin] = r.woe
    out = df.withColumns({names[c]: lookup(F.col(f"`{c}`").cast("string"), maps[c], maps[c].get(None)) for c in few})
    for c in [c for c in columns if c not in few]:
        own = table.where(F.col("rf") == c).select(F.col("bin").alias("__bin"), F.col("woe").alias("__woe"))
        joined = out.join(own, F.col(f"`{c}`").cast("string").eqNullSafe(F.col("__bin")), "left")
        out = joined.drop("__bin", *([names[c]] if names[c] == c else [])).withColumnRenamed("__woe", names[c])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{n}`") for n in names.values() if n not in df.columns])


def with_woe(df: DataFrame, target: str, columns: list[str], times: str | None = None) -> DataFrame:
    """``df`` and a column c_woe for each column c."""
    return _woe_of(df, target, columns, {c: f"{c}_woe" for c in columns}, times) if columns else df


def replace_woe(df: DataFrame, target: str, columns: list[str], times: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Each categorical column replaced by its WoE. Info code 1: numeric, passed; 2: over ten levels, still encoded."""
    numeric = [c for c in columns if is_numeric(df, c)]
    rest = [c for c in columns if c not in numeric]
    n = levels(df, rest) if rest else {}
    made = _woe_of(df, target, rest, {c: c for c in rest}, times) if rest else df
    info = df.sparkSession.createDataFrame([(c, 1) for c in numeric] + [(c, 2) for c in rest if n[c] > MOST_LEVELS], "rf string, info_code int")
    return made, info


def encode_woe(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """A stored WoE map; an unmapped value is an error unless NULL is mapped, then it takes NULL's WoE."""
    if None not in mapping:
        known = [k for k in mapping]
        if df.where(F.col(column).isNull() | ~F.col(column).isin(known)).limit(1).count():
            raise ValueError(f"{column} has values that the map lacks")
    return df.withColumn(f"{column}_woe", lookup(F.col(column).cast("string"), mapping, mapping.get(None)))


def num_slice(x: Column, mapping: list[tuple[float, float]], codes: list = (), sc_label: str = SC_LABEL) -> Column:
    """Interval labels; the first is open below, the last above, a later one wins at a shared edge."""
    out = F.lit(None).cast("string")
    last = len(mapping) - 1
    show = lambda v: f"{v:g}"
    for i, (low, high) in enumerate(mapping):
        if low == high:
            out = F.when(x == low, f"{i + 1:02d} [{show(low)}]").otherwise(out)
            continue
        left, right = ("(-inf" if i == 0 else f"[{show(low)}"), ("inf" if i == last else show(high))
        inside = F.lit(True) if i == 0 else x >= low
        if i != last:
            inside = inside & (x < high)
        out = F.when(inside, f"{i + 1:02d} {left},{right})").otherwise(out)
    special = x.isNull() | F.isnan(x.cast("double")) | (x.isin(list(codes)) if codes else F.lit(False))
    return F.when(special, sc_label).otherwise(out)


def cat_slice(df: DataFrame, column: str, mapping: dict[str, str], sc_label: str = SC_LABEL) -> DataFrame:
    """Categories to groups; NULL is ``sc_label``, an unmapped category an error."""
    if df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(mapping))).limit(1).count():
        raise ValueError(f"{column} has categories that the map lacks")
    return df.withColumn(f"{column}_slice", lookup(F.col(column), mapping, sc_label))


def create_partitions(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nested dummies: for sorted levels l1 < ... < lk a column rf_li that is 1 from level i on, i >= 2.

    Info: code 1 under two or over ten levels (left out), code 2 a level of under 5 % of the rows.
    """
    n = levels(df, columns)
    fit = [c for c in columns if 2 <= n[c] <= MOST_LEVELS]
    counts: dict[str, list] = {c: [] for c in fit}
    for r in long_form(df, fit, numeric=False).groupBy("rf", "value").count().orderBy("rf", "value").collect() if fit else []:
        counts[r.rf].append((r.value, r["count"]))
    new, info = {}, [(c, 1) for c in columns if c not in fit]
    for c in fit:
        known = [v for v, _ in counts[c] if v is not None]
        if is_numeric(df, c):
            known.sort(key=float)
        total = sum(k for _, k in counts[c])
        if any(k < 0.05 * total for _, k in counts[c]):
            info.append((c, 2))
        for i, level in enumerate(known[1:], 1):
            at = F.array_position(F.array(*[F.lit(v) for v in known]), F.col(f"`{c}`").cast("double" if is_numeric(df, c) else "string").cast("string"))
            new[f"{c}_{level}"] = F.when(F.col(f"`{c}`").isNull(), None).otherwise((at > i).cast("int"))
    return df.withColumns(new), df.sparkSession.createDataFrame(info, "rf string, info_code int")


def shortlist(table: DataFrame, iv: float = 0.1, low: float = 0.05, high: float = 0.15, pairs: DataFrame | None = None, corr: float = 0.7) -> DataFrame:
    """Columns by IV: those of at least ``iv``; under 5 of them, of at least ``low``; over 15, of at least ``high``.

    ``pairs``: (rf1, rf2, corr) of coded columns. Of a pair above ``corr`` the one of lower IV goes, ties by name.
    """
    per = table.groupBy("rf").agg(F.sum("iv_b").alias("iv"))
    n = F.count_if(F.col("iv") >= iv).over(Window.partitionBy())
    listed = per.withColumn("cut", F.when(n < 5, low).when(n > 15, high).otherwise(iv)).where("iv >= cut").select("rf", "iv")
    if pairs is None:
        return listed
    close = pairs.where(F.abs("corr") > corr).select("rf1", "rf2")
    one, two = (listed.select(F.col("rf").alias(f"rf{i}"), F.col("iv").alias(f"iv{i}")) for i in (1, 2))
    # as many rows as pairs of columns
    both = close.join(one, "rf1").join(two, "rf2")
    loser = F.when((F.col("iv1") < F.col("iv2")) | ((F.col("iv1") == F.col("iv2")) & (F.col("rf1") > F.col("rf2"))), F.col("rf1")).otherwise(F.col("rf2"))
    return listed.join(both.select(loser.alias("rf")), "rf", "left_anti")


def oriented(auc: Column) -> Column:
    """The AUC of a score whichever way it points."""
    return F.greatest(auc, 1 - auc)


def coverage(dictionary: DataFrame, listed: DataFrame, category: str = "category") -> DataFrame:
    """Per risk category of the dictionary (rf, category): factors in all, factors listed, and whether any is."""
    mine = listed.select("rf", F.lit(1).alias("__in"))
    return dictionary.join(mine, "rf", "left").groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count("__in").alias("n_listed")).withColumn("covered", F.col("n_listed") > 0)
