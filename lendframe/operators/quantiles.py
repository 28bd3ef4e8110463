"""Exact quantiles without a task that holds a column.

Values are counted first. The counted values of each key are cut into slices of near-equal numbers of distinct values
by approximate quantiles; the totals of the slices tell which of them hold the wanted ranks, and only those slices are
ordered. Any number of keys and points takes the same number of shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.scratch import release, ship, stored


def slices_of(df: DataFrame) -> int:
    """Slices grow with the shuffle partitions that the session was given, and so with the data."""
    return max(64, min(1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def sliced(counts: DataFrame, keys: list[str], slices: int | None = None) -> DataFrame:
    """counts: (keys, v, ...). Adds ``slice``: ascending ranges of v, of near-equal numbers of rows of ``counts`` for each key."""
    n = slices or slices_of(counts)
    points = F.array(*[F.lit(i / n) for i in range(1, n)])
    # all columns are asked for here too: Spark then takes the exchange under ``counts`` for the same one and makes it once
    asked = F.max(F.xxhash64(*counts.columns)).isNotNull()
    edges = counts.groupBy(*keys).agg(F.when(asked, F.array_distinct(F.percentile_approx("v", points, F.lit(10 * n)))).alias("edges"))
    named = edges.select(*[F.col(k).alias(f"e_{k}") for k in keys], "edges")
    # a row a key with at most ``n`` numbers; keys are columns, folds and nodes
    joined = counts.join(F.broadcast(named), [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in keys] or F.lit(True))
    return below(joined, "edges", "v", n, "slice").drop("edges", *[f"e_{k}" for k in keys])


def below(df: DataFrame, edges: str, value: str, most: int, name: str) -> DataFrame:
    """Adds ``name``, how many of the ascending ``edges`` (an array column of up to ``most``) lie below ``value``: by halving, in
    plain columns, as a lambda over the array would look at every edge of every row."""
    df = df.withColumn(name, F.lit(0))
    step = 1 << max(0, most.bit_length() - 1)
    while step:
        at = F.col(name)
        df = df.withColumn(name, F.when(F.get(F.col(edges), at + (step - 1)) < F.col(value), at + step).otherwise(at))
        step >>= 1
    return df


def of_counts(counts: DataFrame, keys: list[str], points: list[float], slices: int | None = None) -> DataFrame:
    """counts: (keys, v, n), one row for each value of a key, v not NULL. One row (keys, q): the quantiles at ``points``.

    Between two ranks the value is interpolated linearly.
    """
    rows = sliced(counts, keys, slices)
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most ``slices`` rows a key
    totals = rows.groupBy(*keys, "slice").agg(F.sum("n").alias("n")).select(
        *keys, "slice", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(*keys)).alias("all")
    )
    # the plan has as many expressions for one point as for a hundred
    at = F.array(*[F.lit(float(p)) for p in points])
    place = lambda p: (F.col("all") - 1) * p
    ranks = F.transform(at, lambda p, i: F.array(F.struct((2 * i).alias("i"), F.floor(place(p)).alias("rank")), F.struct((2 * i + 1).alias("i"), F.ceil(place(p)).alias("rank"))))
    inside = F.filter(F.flatten(ranks), lambda r: (r["rank"] >= F.col("start")) & (r["rank"] < F.col("start") + F.col("n")))
    asked = totals.select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col("slice").alias("w_slice"), "start", "all", inside.alias("asked")).where(F.size("asked") > 0)
    same = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys] + [F.col("slice") == F.col("w_slice")]
    upto = F.sum("n").over(Window.partitionBy(*keys, "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # points by keys rows
    held = rows.join(F.broadcast(asked), same).withColumn("upto", F.col("start") + upto)
    found = held.select(*keys, "v", "all", F.inline(F.filter("asked", lambda r: (r["rank"] < F.col("upto")) & (r["rank"] >= F.col("upto") - F.col("n")))))
    got = found.groupBy(*keys).agg(F.max("all").alias("all"), F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("by"))
    low, high = (lambda i: F.col("by")[2 * i]), (lambda i: F.col("by")[2 * i + 1])
    return got.select(*keys, F.transform(at, lambda p, i: between(low(i), high(i), place(p) - F.floor(place(p)))).alias("q"))


def between(low: Column, high: Column, share: Column) -> Column:
    """``low * (1 - share) + high * share`` with the first product unrounded, as DuckDB has it: equal cuts print alike.

    The rounding errors of the product and of the sum (Dekker, Knuth) are added back. Without a share it is ``low`` itself, and
    values too large to be split are interpolated plainly.
    """
    halves = lambda x: ((x * SPLIT) - (x * SPLIT - x), x - ((x * SPLIT) - (x * SPLIT - x)))
    low, high = low.cast("double"), high.cast("double")
    rest = 1 - share
    (a, a_low), (b, b_low) = halves(low), halves(rest)
    p, q = low * rest, high * share
    p_off = ((a * b - p) + a * b_low + a_low * b) + a_low * b_low
    total = p + q
    back = total - p
    total_off = (p - (total - back)) + (q - back)
    exact = total + (p_off + total_off)
    return F.when(share == 0, low).when(F.greatest(F.abs(low), F.abs(high)) < 1e290, exact).otherwise(total)


#: Splits a double into two halves of 26 bits.
SPLIT = 134217729.0


def exact(df: DataFrame, columns: dict[str, Column], points: list[float], *keys: str, times: str | None = None) -> DataFrame:
    """(keys, rf, q): quantiles of the numeric ``columns`` for each key; NULL and NaN don't count. ``times``: as many equal rows a row stands for."""
    cells = F.array(*[F.struct(F.lit(name).alias("rf"), F.nanvl(c.cast("double"), F.lit(None)).alias("v")) for name, c in columns.items()])
    long = df.select(*keys, (F.col(times) if times else F.lit(1)).cast("long").alias("__times"), F.inline(cells)).where(F.col("v").isNotNull())
    counts = long.groupBy(*keys, "rf", "v").agg(F.sum("__times").alias("n"))
    return of_counts(counts, [*keys, "rf"], points)


def of_others(
    df: DataFrame, fold: str, k: int, columns: dict[str, Column], points: list[float], times: str, caps: dict[tuple[int, str], float] | None = None,
) -> dict[tuple[int, str], list[float]]:
    """(fold, name): the quantiles of a column over the rows of the other folds 0, ..., k - 1, NULL left out; none without such rows.

    A value is counted for its own fold, and not copied for the others. ``caps``: of a fold's values, larger ones are cut to it.
    """
    if not columns:
        return {}
    ship(df.sparkSession)
    cells = F.array(*[F.struct(F.lit(name).alias("rf"), c.cast("double").alias("v")) for name, c in columns.items()])
    long = df.select(F.col(fold).cast("int").alias("own"), F.col(times).cast("long").alias("n"), F.inline(cells)).where(F.col("v").isNotNull())
    counts = stored(long.groupBy("rf", "v", "own").agg(F.sum("n").alias("n")), "quantile-counts")
    most = slices_of(df)
    near = counts.groupBy("rf").agg(F.percentile_approx("v", F.array(*[F.lit(i / most) for i in range(1, most)]), F.lit(10 * most)).alias("edges"))
    edges = {r.rf: np.unique(np.array(r.edges, dtype=float)) for r in near.collect()}  # columns rows

    def parted(frames: Iterator) -> Iterator:
        for frame in frames:
            at = np.zeros(len(frame), dtype=np.int64)
            for rf in frame["rf"].unique():
                own = (frame["rf"] == rf).to_numpy()
                at[own] = np.searchsorted(edges[rf], frame["v"].to_numpy()[own], side="left")
            yield frame.assign(slice=at)

    rows = counts.mapInPandas(parted, "rf string, v double, own int, n long, slice int")
    wanted: dict[tuple[str, int], list[tuple[int, int]]] = {}
    shares: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
    sizes: dict[str, dict[int, dict[int, int]]] = {}
    for r in rows.groupBy("rf", "slice", "own").agg(F.sum("n").alias("n")).collect():  # columns by slices by folds rows
        sizes.setdefault(r.rf, {}).setdefault(r.slice, {})[r.own] = r.n
    for rf, by_slice in sizes.items():
        at = sorted(by_slice)
        for g in range(k):
            ends = np.cumsum([sum(n for own, n in by_slice[s].items() if own != g) for s in at])
            if not ends[-1]:
                continue
            for p in points:
                place = (int(ends[-1]) - 1) * float(p)
                low, high = math.floor(place), math.ceil(place)
                shares.setdefault((g, rf), []).append((low, high, place - low))
                for rank in {low, high}:
                    i = int(np.searchsorted(ends, rank, side="right"))
                    wanted.setdefault((rf, at[i]), []).append((g, rank, rank - (int(ends[i - 1]) if i else 0)))

    def pick(key, frame):
        import pandas as pd

        frame = frame.sort_values("v")
        v, own, n = (frame[c].to_numpy() for c in ("v", "own", "n"))
        out = []
        asked = sorted(set(wanted[key[0], int(key[1])]))
        for g in sorted({g for g, _, _ in asked}):
            upto = np.cumsum(np.where(own == g, 0, n))
            out += [(key[0], g, rank, v[np.searchsorted(upto, inside, side="right")]) for h, rank, inside in asked if h == g]
        return pd.DataFrame(out, columns=["rf", "g", "rank", "v"])

    held = [(F.col("rf") == rf) & F.col("slice").isin([s for f, s in wanted if f == rf]) for rf in sizes]
    found: dict[tuple[int, str], dict[int, float]] = {}
    if held:
        inside = held[0]
        for one in held[1:]:
            inside = inside | one
        # a row for each fold, column and rank
        for r in rows.where(inside).select("rf", "slice", "own", "v", "n").groupBy("rf", "slice").applyInPandas(pick, "rf string, g int, rank long, v double").collect():
            found.setdefault((r.g, r.rf), {})[r.rank] = min(r.v, (caps or {}).get((r.g, r.rf), math.inf))
    release(counts)
    return {key: [between_values(found[key][low], found[key][high], share) for low, high, share in own] for key, own in shares.items()}


def between_values(low: float, high: float, share: float) -> float:
    """``between`` of numbers."""
    if share == 0:
        return low
    rest = 1 - share
    halves = lambda x: ((x * SPLIT) - (x * SPLIT - x), x - ((x * SPLIT) - (x * SPLIT - x)))
    p, q = low * rest, high * share
    total = p + q
    if not max(abs(low), abs(high)) < 1e290:
        return total
    (a, a_low), (b, b_low) = halves(low), halves(rest)
    p_off = ((a * b - p) + a * b_low + a_low * b) + a_low * b_low
    back = total - p
    return total + (p_off + ((p - (total - back)) + (q - back)))


def values(df: DataFrame, columns: dict[str, Column], points: list[float], times: str | None = None) -> dict[str, list[float]]:
    """Quantiles by column name; a column without values is left out."""
    return {r.rf: list(r.q) for r in exact(df, columns, points, times=times).collect()} if columns else {}
