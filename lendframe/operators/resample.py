"""Folds, cross-validation, bootstrap and SMOTE, with randomness from hashes of an id: independent of partitions."""

from __future__ import annotations

import math
from functools import partial, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from lendframe.functions.draws import hashed, uniform
from lendframe.functions.scratch import ship, stored
from lendframe.functions.special import require_binary
from lendframe.operators.glm import Cells, compress, fit_groups, fit_logit
from lendframe.operators.metrics import auc
from lendframe.operators.quantiles import slices_of

#: Rows of a cell that a task of the bootstrap counts at once, and draws that a task fits.
CELL, DRAWS = 50_000, 20
#: Rows of a block that is compared with another block, and rows of it whose distances are held at once.
BLOCK, STRIP = 2048, 128


def order_key(id_col: str, seed: int) -> Column:
    """A pseudo-random order that other engines can compute: multiplicative hashing of an integer id."""
    return (F.col(id_col).cast("long") + seed) * F.lit(2654435761) % F.lit(1 << 32)


def placed(df: DataFrame, id_col: str, keys: list[str], seed: int) -> DataFrame:
    """Adds ``__place``, the rank from 0 of each row in the hash order of its keys, and ``__all``, the rows of its keys.

    The rank is the place within a slice of the hash order plus the sizes of the slices before, so that no task orders more
    than a slice.
    """
    salt = slices_of(df)
    rows = df.withColumn("__key", order_key(id_col, seed)).withColumn("__slice", F.floor(F.col("__key") / F.lit((1 << 32) / salt)))
    sizes = rows.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__all"))
    # classes times slices rows
    joined = rows.join(F.broadcast(sizes), [F.col("__slice") == F.col("__s"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]])
    place = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy("__key", id_col)) - 1 + F.col("__before")
    return joined.withColumn("__place", place).drop("__key", "__slice", "__s", "__before", *[f"__{c}" for c in keys])


def folds(df: DataFrame, id_col: str, y: str | None, k: int = 10, seed: int = 2191) -> DataFrame:
    """A ``fold`` column of near-equal sizes, per class if ``y`` is given."""
    rows = placed(df, id_col, [y] if y else [], seed)
    return rows.withColumn("fold", F.floor(F.col("__place") * k / F.col("__all")).cast("int")).drop("__place", "__all")


def fold_of(df: DataFrame, id_col: str, k: int = 10, seed: int = 2191) -> Column:
    """The fold of ``folds`` without classes as a column for ``df``; NULL without an id, and rows of one id share a fold.

    Of the slices of the hash order only those that hold the first row of a fold are ordered, and no other row is shuffled.
    """
    salt = slices_of(df)
    key = order_key(id_col, seed)
    rows = df.select(key.alias("key"), F.col(id_col).alias("id")).where(F.col("key").isNotNull()).withColumn("slice", F.floor(F.col("key") / F.lit((1 << 32) / salt)))
    sizes = sorted(tuple(r) for r in rows.groupBy("slice").count().collect())  # a row a slice
    total, before, asked = sum(n for _, n in sizes), 0, []
    firsts = sorted({p for p in (-(-f * total // k) for f in range(1, k)) if p < total})
    for slice_, n in sizes:
        asked += [(slice_, p - before + 1) for p in firsts if before <= p < before + n]
        before += n
    if not asked:
        return F.when(key.isNotNull(), F.lit(0))
    place = F.row_number().over(Window.partitionBy("slice").orderBy("key", "id"))
    within = rows.where(F.col("slice").isin(sorted({s for s, _ in asked}))).withColumn("place", place)
    wanted = [(F.col("slice") == s) & (F.col("place") == p) for s, p in asked]
    edges = [(r["slice"], r.place, r.key, r.id) for r in within.where(reduce(or_, wanted)).collect()]  # under k rows
    # a first row serves all folds that begin with it, of which the last is its own
    share = {p: sum(-(-f * total // k) == p for f in range(1, k)) for p in firsts}
    starts = dict(zip(asked, firsts))
    return sum((F.when((key > e) | ((key == e) & (F.col(id_col) >= F.lit(i))), share[starts[s, p]]).otherwise(0) for s, p, e, i in edges), F.when(key.isNotNull(), F.lit(0)))


def fold_count(df: DataFrame, y: str, k: int) -> int:
    """How many folds there are: no more than the rarer class has rows, nor than there are rows (leave-one-out)."""
    if k < 0:
        raise ValueError("k can't be negative")
    require_binary(df, y)
    sizes = {r[0]: r[1] for r in df.where(F.col(y).isNotNull()).groupBy(y).count().collect()}
    least = min(sizes.get(0, 0), sizes.get(1, 0))
    return min(least if 0 < least < k else k, sum(sizes.values()))


def kfold_indices(df: DataFrame, id_col: str, y: str, kind: str = "stratified", k: int = 10, seed: int = 2191) -> DataFrame:
    """``folds`` of the rows with a target, with the number of folds cut by ``fold_count``. kind: random or stratified."""
    if kind not in ("random", "stratified"):
        raise ValueError("kind: random or stratified")
    number = fold_count(df, y, k)
    rows = df.where(F.col(y).isNotNull())
    return folds(rows, id_col, y if kind == "stratified" and number < rows.count() else None, number, seed)


def kfold_validation(df: DataFrame, y: str, predictors: list[str], id_col: str, k: int = 10, seed: int = 1984, fold: str | None = None, times: str | None = None) -> DataFrame:
    """Refit per fold; AUC, mean squared error and its root on the fold left out. ``fold``: a column of folds made before by
    ``fold_of``. A row counts ``times`` times."""
    rows = df.where(F.col(fold).isNotNull()).withColumn("fold", F.col(fold)) if fold else folds(df, id_col, None, k, seed).cache()
    columns = [y, *predictors]
    # coded factors have few distinct rows: then all fits run on their counts
    cells = compress(rows.dropna(subset=columns), ["fold", *columns], times)
    if cells is not None:
        done = []
        for f in range(k):
            held = cells.columns["fold"] == f
            fit = Cells({c: cells.columns[c][~held] for c in columns}, cells.count[~held]).fit(y, list(predictors))
            p = 1 / (1 + np.exp(-(fit.intercept + sum(fit.coefficients[c] * cells.columns[c][held] for c in predictors))))
            t, n = cells.columns[y][held], cells.count[held]
            if n.sum():
                area, ks, gini = _counted_auc(p, t, n)
                amse = float((n * (t - p) ** 2).sum() / n.sum())
                done.append((f, area, ks, gini, amse, amse**0.5))
        return df.sparkSession.createDataFrame(done, "fold int, auc double, ks double, gini double, amse double, rmse double")
    # every fit has the rows of the other folds: one aggregate a Newton step serves all folds
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    count = (F.col(times) if times else F.lit(1)).alias("__n")
    fits = fit_groups(rows.select(*columns, count, F.explode(others).alias("__for")), "__for", k, y, list(predictors), weight="__n")
    table = F.array(*[F.array(*[F.lit(float(b)) for b in ([f.intercept, *f.coefficients.values()] if f else [0.0] * (len(predictors) + 1))]) for f in fits])
    own = rows.dropna(subset=columns).withColumn("__b", F.get(table, F.col("fold")))
    line = sum((F.col("__b")[i + 1] * F.col(f"`{c}`") for i, c in enumerate(predictors)), F.col("__b")[0])
    out = own.select("fold", y, count, (1 / (1 + F.exp(-line))).alias("p"))
    amse = F.sum((F.col(y) - F.col("p")) ** 2 * F.col("__n")) / F.sum("__n")
    got = auc(out, "p", y, "fold", times="__n").join(out.groupBy("fold").agg(amse.alias("amse")), "fold")
    return got.withColumn("rmse", F.sqrt("amse"))


def bootstrap_validation(df: DataFrame, y: str, predictors: list[str], id_col: str, b: int = 20, seed: int = 1122) -> DataFrame:
    """Refit on Poisson(1) weighted rows, AUC on the rows left out of each draw.

    Coded factors have few distinct rows: then these are counted for all draws, and the fits run on the counts, in tasks of some
    draws each. Else each draw is fitted on the rows.
    """
    columns = [y, *predictors]
    rows = df.select(id_col, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).dropna(subset=columns)
    cells = compress(rows, columns)
    out = []
    if cells is None:
        for i in range(b):
            drawn = df.withColumn("__w", _poisson(id_col, F.lit(i), seed))
            fit = fit_logit(drawn.where("__w > 0"), y, predictors, weight="__w")
            got = auc(drawn.where("__w = 0").select(y, fit.probability().alias("p")), "p", y).first()
            out.append((i, got.auc, got.ks, got.gini))
    else:
        out = _drawn_fits(rows, id_col, cells, y, list(predictors), b, seed)
        return out.orderBy("draw")
    return df.sparkSession.createDataFrame(out, "draw int, auc double, ks double, gini double")


def _drawn_fits(rows: DataFrame, id_col: str, cells: Cells, y: str, predictors: list[str], b: int, seed: int) -> DataFrame:
    """Rows are grouped by their cell, of which a large one is parted, and counted for all draws; then each draw is fitted in a task."""
    spark, columns = rows.sparkSession, [y, *predictors]
    ship(spark)
    parts = -(-cells.count // CELL)
    known = [(i, int(parts[i]), *(float(cells.columns[c][i]) for c in columns)) for i in range(len(cells.count))]
    names = [f"c{i}" for i in range(len(columns))]
    table = spark.createDataFrame(known, "cell int, parts int, " + ", ".join(f"{n} double" for n in names))
    # at most as many rows as ``compress`` lets pass
    placed = rows.join(F.broadcast(table), [F.col(f"`{c}`") == F.col(n) for c, n in zip(columns, names)])
    keyed = placed.select("cell", _start(id_col, seed).alias("start"), "parts").withColumn("part", F.pmod(F.xxhash64("start"), F.col("parts")))
    counts = keyed.select("cell", "part", "start").groupBy("cell", "part").applyInArrow(lambda g: _draw_counts(g, b), "block int, cell int, inside binary, outside binary")
    fits = counts.groupBy("block").applyInArrow(lambda g: _fit_draws(g, cells, y, predictors, b), "draw int, auc double, ks double, gini double")
    return stored(fits, "bootstrap")


def _draw_counts(group: pa.Table, b: int) -> pa.Table:
    """For each block of draws: how often the cell's rows are in each of them, and how many are left out."""
    start = group["start"].to_numpy().astype(np.uint32)
    chances = [np.uint32(math.ceil(c * 2**32)) for c in POISSON]
    inside, outside = np.zeros(b, np.int64), np.zeros(b, np.int64)
    width = max(1, (1 << 20) // len(start))
    for first in range(0, b, width):
        draws = (np.arange(first, min(b, first + width), dtype=np.uint64) * np.uint64(2654435761)).astype(np.uint32)
        # 32-bit words wrap as the remainders of _poisson do
        mixed = draws[:, None] + start
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(739982445)
        reached = [np.count_nonzero(mixed >= c, axis=1) for c in chances]
        inside[first : first + width], outside[first : first + width] = sum(reached), len(start) - reached[0]
    blocks = range(0, b, DRAWS)
    return pa.table({
        "block": pa.array(range(len(blocks)), pa.int32()), "cell": pa.array([group["cell"][0].as_py()] * len(blocks), pa.int32()),
        "inside": pa.array([inside[f : f + DRAWS].tobytes() for f in blocks], pa.binary()), "outside": pa.array([outside[f : f + DRAWS].tobytes() for f in blocks], pa.binary()),
    })


def _fit_draws(group: pa.Table, cells: Cells, y: str, predictors: list[str], b: int) -> pa.Table:
    first, at = group["block"][0].as_py() * DRAWS, group["cell"].to_numpy()
    own = min(b, first + DRAWS) - first
    inside, outside = np.zeros((own, len(cells.count))), np.zeros((own, len(cells.count)))
    for name, held in (("inside", inside), ("outside", outside)):
        for cell, value in zip(at, group[name]):
            held[:, cell] += np.frombuffer(value.as_py(), np.int64)
    out = []
    for i in range(own):
        fit = Cells(cells.columns, inside[i]).fit(y, predictors)
        line = fit.intercept + sum(fit.coefficients[c] * cells.columns[c] for c in predictors)
        out.append((first + i, *_counted_auc(1 / (1 + np.exp(-line)), cells.columns[y], outside[i])))
    draw, *measures = zip(*out)
    return pa.table({"draw": pa.array(draw, pa.int32()), **{n: pa.array(m, pa.float64()) for n, m in zip(("auc", "ks", "gini"), measures)}})


#: Cumulative chances of 0, 1, ... 5 of a Poisson variable of mean 1 (fixed values).
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518)


def _start(id_col: str, seed: int) -> Column:
    return F.conv(F.substring(hashed(F.lit(seed), F.col(id_col)), 1, 8), 16, 10).cast("long")


def _poisson(id_col: str, draw: Column, seed: int) -> Column:
    """How often a row is in a draw: from a 32-bit hash of its id that every draw moves on by a multiplicative step."""
    mixed = (_start(id_col, seed) + draw * F.lit(2654435761)) % F.lit(1 << 32)
    u = (mixed.bitwiseXOR(F.shiftright(mixed, 15)) * F.lit(739982445)) % F.lit(1 << 32) / F.lit(float(1 << 32))
    return sum((u >= c).cast("int") for c in POISSON)


def _counted_auc(p: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[float | None, float, float | None]:
    """AUC, KS and Gini of counted rows, ties one half; no AUC with one class."""
    at = np.unique(p, return_inverse=True)[1]
    good, bad = (np.bincount(at, weights=n * (t == k)) for k in (0, 1))
    if not good.sum() or not bad.sum():
        return None, 0.0, None
    below, upto = np.cumsum(good) - good, np.cumsum(bad) - bad
    area = float((bad * (below + good / 2)).sum() / (good.sum() * bad.sum()))
    return area, float(max(((bad.sum() - upto) / bad.sum() - (good.sum() - below) / good.sum()).max(), 0.0)), 2 * area - 1


def spans_of(df: DataFrame, numeric: list[str]) -> list[float]:
    row = df.agg(*[(F.max(f"`{c}`") - F.min(f"`{c}`")).cast("double") for c in numeric]).first() if numeric else []
    return [float(v or 1.0) for v in row]


def heom_neighbours(df: DataFrame, id_col: str, numeric: list[str], categorical: list[str], k: int = 5, spans: list[float] | None = None) -> DataFrame:
    """The k nearest rows of each by HEOM: range-scaled differences, 0/1 for categories, 1 for a missing side.

    All pairs are compared, as the distance has no index, so this is for minority classes. They are dealt in blocks of
    about ``BLOCK`` rows by blocks, whose number grows with the rows, and each block keeps its own k best before the final
    choice: no task holds more than two blocks and ``STRIP`` rows of their distances, and k rows a block are shuffled for one row.
    """
    ship(df.sparkSession)
    spans = spans or spans_of(df, numeric)
    df = df.where(F.col(id_col).isNotNull())
    blocks = max(1, math.ceil(df.count() / BLOCK))
    block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    kinds = [df.schema[c].dataType for c in numeric]
    # decimals as whole numbers, whose differences are exact
    units = [float(10**t.scale) if isinstance(t, DecimalType) else 1.0 for t in kinds]
    values = [(F.col(f"`{c}`") * F.lit(10**t.scale) if isinstance(t, DecimalType) else F.col(f"`{c}`")).cast("double").alias(f"n{i}") for i, (c, t) in enumerate(zip(numeric, kinds))]
    side = lambda own, other: df.select(F.col(id_col).alias("id"), *values, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(categorical)], block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(other))
    kind = f"a_id {df.schema[id_col].dataType.simpleString()}, b_id {df.schema[id_col].dataType.simpleString()}, distance double"
    best = side("i", "j").groupBy("i", "j").cogroup(side("j", "i").groupBy("i", "j")).applyInArrow(partial(_block_neighbours, spans=spans, units=units, categories=len(categorical), k=k), kind)
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy("distance", "b_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("a_id").alias("id"), F.col("b_id").alias("neighbour"), "distance", "rank")


def _block_neighbours(left: pa.Table, right: pa.Table, spans: list[float], units: list[float], categories: int, k: int) -> pa.Table:
    """The k nearest rows of ``right`` (all, if fewer) for each of ``left``; of equal distances the smaller ids."""
    right = right.take(pc.sort_indices(right["id"]))
    n = left.num_rows

    def coded(name: str) -> tuple[np.ndarray, np.ndarray]:
        both = pa.concat_tables([left.select([name]), right.select([name])])[name].combine_chunks()
        if pa.types.is_floating(both.type):
            both = pc.add(both, pa.scalar(0.0, both.type))  # -0.0 equals 0.0
        at = pc.fill_null(both.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        return at[:n], at[n:]

    ids, groups = coded("id"), [coded(f"c{i}") for i in range(categories)]
    numbers = [[(pc.fill_null(t[f"n{i}"], 0.0).to_numpy(), pc.is_null(t[f"n{i}"]).to_numpy()) for t in (left, right)] for i in range(len(spans))]
    rows, columns, found = [], [], []
    for start in range(0, n, STRIP):
        own = slice(start, start + STRIP)
        total = np.zeros((len(ids[0][own]), right.num_rows))
        for ((a, a_null), (b, b_null)), span, unit in zip(numbers, spans, units):
            part = np.subtract.outer(a[own], b)
            if unit != 1.0:
                part /= unit
            part /= span
            part *= part
            part[a_null[own]] = 1.0
            part[:, b_null] = 1.0
            total += part
        for a, b in groups:
            total += (a[own, None] != b) | (a[own, None] < 0) | (b < 0)
        np.sqrt(total, out=total)
        same, distance = ids[0][own, None] == ids[1], total
        if np.isnan(total).any():
            distance = np.where(np.isnan(total), np.inf, total)
        if distance is total and same.any():
            distance = total.copy()
        distance[same] = np.inf
        limit = np.partition(distance, k - 1, axis=1)[:, k - 1] if k < distance.shape[1] else np.full(len(distance), np.inf)
        r, c = np.nonzero((distance <= limit[:, None]) & ~same)
        order = np.lexsort((c, distance[r, c], r))
        r, c = r[order], c[order]
        # the place within the own row's list
        kept = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[kept], c[kept]
        rows.append(r + start), columns.append(c), found.append(total[r, c])
    r, c, d = (np.concatenate(x) if x else np.array([], dtype) for x, dtype in ((rows, int), (columns, int), (found, float)))
    return pa.table({"a_id": left["id"].take(pa.array(r)), "b_id": right["id"].take(pa.array(c)), "distance": pa.array(d)})


def smote(df: DataFrame, y: str, minority, osr: float, id_col: str, numeric: list[str], categorical: list[str] = (), bounds: dict[str, tuple] | None = None, k: int = 5, seed: int = 81000) -> DataFrame:
    """The table and round(osr * minority rows) synthetic rows of the minority class; ``smote`` flags them.

    Every minority row is used as often as the others, and the rest goes to those first in the order of a hash. A synthetic
    row lies between its row and one of the row's k nearest by one random factor; categories come from the neighbour.
    Differences are scaled by the range in the whole table. ``bounds``: (lower, upper, type) per numeric column. A class of
    one row has no neighbour and gets no synthetic rows.
    """
    small = df.where(F.col(y) == minority)
    near = stored(heom_neighbours(small, id_col, list(numeric), list(categorical), k, spans_of(df, list(numeric))), "smote-neighbours")
    n = small.count()
    total = round(osr * n)
    ranked = placed(small.select(F.col(id_col).alias("id")), "id", [], seed)
    copies = F.lit(total // max(n, 1)) + (F.col("__place") < total % max(n, 1)).cast("int")
    picks = ranked.withColumn("n", copies).where("n > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("c"))
    draw = lambda what: uniform(F.lit(seed), F.col("id"), F.col("c"), F.lit(what))
    # a class of k rows or fewer has fewer neighbours
    held = near.groupBy("id").agg(F.max("rank").alias("__held"))
    picks = picks.join(held, "id").withColumn("rank", F.floor(draw("neighbour") * F.col("__held")).cast("int") + 1).drop("__held")
    made = picks.join(near, ["id", "rank"]).join(small.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"a_{c}") for c in numeric]), "id")
    made = made.join(small.select(F.col(id_col).alias("neighbour"), *[F.col(c).alias(f"b_{c}") for c in [*numeric, *categorical]]), "neighbour")
    new = {}
    for c in numeric:
        v = F.col(f"a_{c}") + draw("factor") * (F.col(f"b_{c}") - F.col(f"a_{c}"))
        if bounds and c in bounds:
            low, high, kind = bounds[c]
            v = F.greatest(F.least(v, F.lit(high)), F.lit(low))
            v = F.bround(v, 0) if kind == "integer" else v
        new[c] = v
    rows = made.select(*[new[c].cast(df.schema[c].dataType).alias(c) for c in numeric], *[F.col(f"b_{c}").alias(c) for c in categorical], F.lit(minority).alias(y), F.lit(1).alias("smote"))
    return df.withColumn("smote", F.lit(0)).unionByName(rows, allowMissingColumns=True)
