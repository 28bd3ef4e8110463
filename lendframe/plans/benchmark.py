"""Fold-by-model benchmark with fold-safe preparation, paired tests and summaries; models are plug-ins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.functions.dist import wilcoxon_p
from lendframe.functions.scratch import release, stored
from lendframe.functions.special import FLOOR
from lendframe.operators import folded, metrics, profile, quantiles, resample
from lendframe.operators.boosting import Params, fit_boosted, fit_boosted_folds
from lendframe.operators.glm import Logit, fit_groups


class Model(Protocol):
    """A plug-in for one fold: the test rows with a ``proba`` column. Pretrained networks join through ``mapInPandas`` in it."""

    name: str

    def fit_predict(self, train: DataFrame, test: DataFrame, y: str, numeric: list[str], categorical: list[str]) -> DataFrame: ...


class FoldModel:
    """A model of all folds at once, and so of one.

    ``rows`` has a copy of each row for each fold g, with ``__train`` false for the one that the row is tested in, and the numbers
    capped as the fold's training rows say. ``__n``, 1 if it isn't there, says how many equal training rows a row stands for.
    ``by_row``: the model needs each row by itself. The result: the copies to be tested, with a ``proba`` column.
    """

    name: str
    by_row = False

    def fit_folds(self, rows: DataFrame, y: str, k: int, numeric: list[str], categorical: list[str]) -> DataFrame:
        raise NotImplementedError

    def fit_table(self, table: folded.Folded) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        """The same fits from distinct rows that aren't copied for each fold; scores as ``folded.areas`` takes them."""
        raise NotImplementedError

    def fit_predict(self, train: DataFrame, test: DataFrame, y: str, numeric: list[str], categorical: list[str]) -> DataFrame:
        both = [d.withColumns({"g": F.lit(0), "__train": F.lit(own)}) for d, own in ((train, True), (test, False))]
        rows = both[0].unionByName(both[1])
        if "fold" not in rows.columns:
            rows = rows.withColumn("fold", F.lit(0))
        if "__id" not in rows.columns:
            rows = rows.withColumn("__id", F.monotonically_increasing_id())
        return self.fit_folds(rows, y, 1, numeric, categorical)


def _by_group(values: list, kind: str) -> Column:
    """The value of the row's fold."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("g"))


def scored_by(rows: DataFrame, fits: list[Logit | None], names: list[str]) -> DataFrame:
    line = _by_group([f.intercept if f else None for f in fits], "double")
    for n in names:
        line = line + _by_group([f.coefficients[n] if f else None for f in fits], "double") * F.col(f"`{n}`")
    return rows.where(~F.col("__train")).withColumn("proba", 1 / (1 + F.exp(-line)))


def _counted(rows: DataFrame) -> DataFrame:
    return rows if "__n" in rows.columns else rows.withColumn("__n", F.lit(1).cast("long"))


def _design(rows: DataFrame, y: str, names: list[str]) -> DataFrame:
    """What the steps of a fit read, stored: they would make it anew each time."""
    return stored(rows.select("__id", "g", "fold", "__train", "__n", F.col(f"`{y}`"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names]), "fold-design")


class WoeLogit(FoldModel):
    """Five quantile bins of each number and the levels of categories, coded by the weight of evidence of the fold's training rows."""

    name = "woe_logit"

    def fit_folds(self, rows: DataFrame, y: str, k: int, numeric: list[str], categorical: list[str]) -> DataFrame:
        rows, factors = _counted(rows), list(categorical)
        train = rows.where("__train")
        points = [i / 5 for i in range(1, 5)]
        found = {(r.g, r.rf): sorted(set(r.q)) for r in quantiles.exact(train, {c: F.col(f"`{c}`") for c in numeric}, points, "g", times="__n").collect()} if numeric else {}
        bins = {}
        for c in numeric:  # folds by columns by four edges
            edges = F.get(F.array(*[F.array(*[F.lit(float(e)) for e in found.get((g, c), [])]).cast("array<double>") for g in range(k)]), F.col("g"))
            value = F.col(f"`{c}`")
            at = F.size(F.filter(edges, lambda e: e < value))
            bins[f"{c}_bin"] = F.when(value.isNull(), "SC").otherwise(at.cast("string"))
            factors.append(f"{c}_bin")
        rows = rows.withColumns(bins)
        cells = F.array(*[F.struct(F.lit(c).alias("rf"), F.col(f"`{c}`").cast("string").alias("bin")) for c in factors])
        number = lambda v: F.sum(F.when(F.col("y") == v, F.col("__n")).otherwise(0))
        counts = rows.where("__train").select("g", F.col(y).alias("y"), "__n", F.inline(cells)).groupBy("g", "rf", "bin").agg(number(0).alias("good"), number(1).alias("bad"))
        totals = counts.groupBy(F.col("g").alias("t_g"), F.col("rf").alias("t_rf")).agg(F.sum("good").alias("goods"), F.sum("bad").alias("bads"))
        shares = counts.join(F.broadcast(totals), (F.col("g") == F.col("t_g")) & (F.col("rf") == F.col("t_rf")))  # folds by factors rows
        floor = lambda a, b: F.greatest(F.try_divide(F.col(a), F.col(b)), F.lit(FLOOR))
        table = stored(shares.select("g", "rf", "bin", F.log(floor("good", "goods") / floor("bad", "bads")).alias("woe")), "fold-woe")
        for c in factors:
            own = table.where(F.col("rf") == c).select(F.col("g").alias("w_g"), F.col("bin").alias("w_bin"), F.col("woe").alias(f"{c}_woe"))
            rows = rows.join(own, (F.col("g") == F.col("w_g")) & F.col(f"`{c}`").cast("string").eqNullSafe(F.col("w_bin")), "left").drop("w_g", "w_bin")
        names = [f"{c}_woe" for c in factors]
        # a level that the training rows don't have counts as neutral
        rows = _design(rows.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names}), y, names)
        # the rows of equal bins are one
        coded = stored(rows.where("__train").groupBy("g", y, *names).agg(F.sum("__n").alias("__n")), "fold-cells")
        fits = fit_groups(coded, "g", k, y, names, weight="__n")
        release(coded)
        return scored_by(rows, fits, names)


    def fit_table(self, table: folded.Folded) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        edges = {key: np.unique(np.array(q)) for key, q in table.others([i / 5 for i in range(1, 5)]).items()}
        # levels have codes from 0, of which NULL's is one like the others
        bins = folded.Bins(table.caps, table.numeric, edges, [np.arange(len(own) + 1, dtype=np.uint8) for own in table.levels])
        cells = stored(folded.counted_bins(table, bins), "fold-cells")
        names = [*table.numeric, *table.categorical]
        at = lambda i: F.conv(F.hex(F.substring("bins", i + 1, 1)), 16, 10).cast("int")
        counts = cells.select("g", "y", "w", F.posexplode(F.array(*[at(i) for i in range(len(names))])).alias("i", "bin")).groupBy("g", "i", "bin", "y").agg(F.sum("w").alias("w")).collect() if names else []
        table_ = np.zeros((2, table.k, len(names), 256))
        for r in counts:  # folds by columns by bins rows
            if r.y in (0, 1):
                table_[int(r.y), r.g, r.i, r.bin] = r.w
        totals = table_.sum(axis=3, keepdims=True)
        shares = np.maximum(np.divide(table_, totals, out=np.zeros_like(table_), where=totals > 0), FLOOR)
        woe = np.log(shares[0] / shares[1])

        def code(frames: Iterator) -> Iterator:
            for frame in frames:
                own, g = np.frombuffer(b"".join(frame["bins"]), dtype=np.uint8).reshape(len(frame), -1), frame["g"].to_numpy()
                yield frame[["g", "y", "w"]].assign(**{f"w{i}": woe[g, i, own[:, i]] for i in range(len(names))})

        coded = stored(cells.mapInPandas(code, ", ".join(["g int, y double, w double", *[f"w{i} double" for i in range(len(names))]])), "fold-coded")
        fits = fit_groups(coded, "g", table.k, "y", [f"w{i}" for i in range(len(names))], weight="w")
        release(cells, coded)
        betas = [np.r_[f.intercept, list(f.coefficients.values())] if f else np.zeros(len(names) + 1) for f in fits]

        def score(g: int, inputs: list[np.ndarray]) -> np.ndarray:
            own = bins.of(g, inputs)
            line = np.full(len(own), betas[g][0])
            for i in range(own.shape[1]):
                line += betas[g][1 + i] * woe[g, i][own[:, i]]
            return 1 / (1 + np.exp(-line))[None, :]

        return score


class PlainLogit(FoldModel):
    """Standardised numbers and dummies of all levels, with a ridge of 1 / c on the slopes."""

    def __init__(self, c: float = 1.0, name: str = "logit"):
        self.c, self.name = c, name

    def fit_folds(self, rows: DataFrame, y: str, k: int, numeric: list[str], categorical: list[str]) -> DataFrame:
        rows, names = self.design(rows, y, k, numeric, categorical)
        return scored_by(rows, fit_groups(rows.where("__train"), "g", k, y, names, weight="__n", ridge=1 / self.c), names)

    def fit_table(self, table: folded.Folded) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        made = folded.design(table)
        return made.scores(folded.fit_ridges(made, [1 / self.c]))

    @staticmethod
    def design(rows: DataFrame, y: str, k: int, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, list[str]]:
        """The stored model columns and their names; the scale is that of each fold's training rows."""
        rows = _counted(rows)
        train, n = rows.where("__train"), F.col("__n")
        mean_of = lambda c, v: F.try_divide(F.sum(n * v), F.sum(F.when(F.col(f"`{c}`").isNotNull(), n)))
        means = {r.g: r for r in train.groupBy("g").agg(*[mean_of(c, F.col(f"`{c}`")).alias(f"m_{i}") for i, c in enumerate(numeric)], F.count(F.lit(1)).alias("n")).collect()}
        off = lambda i, c: F.col(f"`{c}`") - _by_group([(means[g][f"m_{i}"] if g in means else None) for g in range(k)], "double")
        spreads = {r.g: r for r in train.groupBy("g").agg(*[F.sqrt(mean_of(c, off(i, c) * off(i, c))).alias(f"s_{i}") for i, c in enumerate(numeric)], F.count(F.lit(1)).alias("n")).collect()}
        got = {g: means[g].asDict() | spreads[g].asDict() for g in means}
        made = {}
        for i, c in enumerate(numeric):
            mean, spread = ([(got[g][f"{n}_{i}"] if g in got else None) for g in range(k)] for n in ("m", "s"))
            scaled = (F.col(f"`{c}`") - _by_group(mean, "double")) / _by_group([v or 1.0 for v in spread], "double")
            made[f"{c}__scaled"] = F.coalesce(scaled, F.lit(0.0))
        for c in categorical:
            levels = [r.v for r in train.select(F.col(f"`{c}`").cast("string").alias("v")).distinct().limit(MOST_DUMMIES + 1).collect()]
            if len(levels) > MOST_DUMMIES:
                raise ValueError(f"over {MOST_DUMMIES} levels, too many for dummies: {c}")
            made |= {f"{c}__{'NULL' if v is None else v}": F.col(f"`{c}`").cast("string").eqNullSafe(F.lit(v)).cast("double") for v in sorted(levels, key=lambda v: (v is None, v))}
        return _design(rows.withColumns(made), y, list(made)), list(made)


class BoostedTrees(FoldModel):
    def __init__(self, params: Params = Params(trees=20, leaves=8, depth=3), name: str = "boosted_trees"):
        self.params, self.name, self.by_row = params, name, params.subsample < 1

    def fit_folds(self, rows: DataFrame, y: str, k: int, numeric: list[str], categorical: list[str]) -> DataFrame:
        rows = _counted(rows)
        model = fit_boosted(rows.where("__train"), y, "__id", numeric, categorical, [self.params] * k, "g", copies="__n")
        return model.predict(rows.where(~F.col("__train")), "g", ["__id", "g", "fold", y])

    def fit_table(self, table: folded.Folded) -> Callable[[int, list[np.ndarray]], np.ndarray]:
        model, bins = fit_boosted_folds(table, self.params)
        return lambda g, inputs: 1 / (1 + np.exp(-model.margin(bins.of(g, inputs), np.full(len(inputs[0]) if inputs else 0, g))))[None, :]


MOST_DUMMIES = 100


def default_models(n: int = 0) -> list[FoldModel]:
    return [WoeLogit(), PlainLogit(), BoostedTrees()]


def spread_out(copies: DataFrame) -> DataFrame:
    """Dealt to all shuffle partitions: every pass of every fit reads these rows, and folds come in few partitions."""
    return copies.repartition(int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__id")


def fold_copies(rows: DataFrame, id_col: str, numeric: list[str], k: int) -> DataFrame:
    """A copy of each row for each fold g, its numbers capped by the fences of the rows of the other folds."""
    copies = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("__train", F.col("fold") != F.col("g")).withColumn("__id", F.col(f"`{id_col}`"))
    return copies.withColumns(_capped(rows, numeric, k))


def fold_cells(rows: DataFrame, y: str, id_col: str | None, numeric: list[str], categorical: list[str], k: int) -> DataFrame:
    """``fold_copies`` with equal rows of a fold as one for training, ``__n`` of them, so that a row is copied once for each fold only if no
    other equals it. Rows are tested each by itself, or without ``id_col`` as counted ones too."""
    columns = ["fold", y, *numeric, *categorical]
    cells = rows.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
    others = cells.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("fold") != F.col("g"))
    tested = rows.select(*columns, F.lit(1).cast("long").alias("__n"), F.col(f"`{id_col}`").alias("__id")) if id_col else cells.withColumn("__id", F.lit(None).cast("long"))
    tested = tested.withColumn("g", F.col("fold")).withColumn("__train", F.lit(False))
    both = others.withColumn("__id", F.lit(None).cast(tested.schema["__id"].dataType)).withColumn("__train", F.lit(True)).unionByName(tested)
    dealt = both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", *[F.col(f"`{c}`") for c in [*numeric, *categorical]], "__id")
    return dealt.withColumns(_capped(rows, numeric, k))


def _capped(rows: DataFrame, numeric: list[str], k: int) -> dict[str, Column]:
    """The numbers of a copy for fold g, capped by the fences of the rows of the other folds."""
    fences = profile.fold_safe_caps(rows, "fold", numeric, list(range(k)))
    caps = {(r.fold, r.rf): r.upper_cap for r in fences.collect()} if numeric else {}  # folds by columns rows
    capped = {}
    for c in numeric:
        cap = _by_group([caps.get((g, c)) for g in range(k)], "double")
        capped[c] = F.when(F.col(f"`{c}`") > cap, cap).otherwise(F.col(f"`{c}`").cast("double"))
    return capped


def run(
    df: DataFrame, y: str, id_col: str, numeric: list[str], categorical: list[str], models: list[Model | FoldModel], k: int = 10, seed: int = 42, path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions (model, fold, id, y, proba) and metrics per model and fold.

    Caps come from the training rows of each fold; all folds' caps are one query. With ``path`` each fold of a model is
    written there as a part when it is done, and a run that is started again leaves out the parts that are there.
    """
    spark = df.sparkSession
    rows = stored(resample.folds(df, id_col, y, k, seed), "benchmark-folds")
    at_once = [isinstance(m, FoldModel) and not path for m in models]
    # equal rows are trained on and scored as one, but for models that need them all
    tabled = [one and not m.by_row and type(m).fit_table is not FoldModel.fit_table for m, one in zip(models, at_once)]
    table = folded.folded(rows, y, numeric, categorical, k, MOST_DUMMIES) if any(tabled) else None
    if table is not None and np.count_nonzero(table.goods + table.bads) < 2:
        # nothing to train on for the one fold
        release(table.rows)
        table = None
    if table is None:
        # no models, or a category of many levels
        tabled = [False] * len(models)
    singly = [not one or m.by_row for m, one in zip(models, at_once)]
    copies = stored(spread_out(fold_copies(rows, id_col, numeric, k)), "benchmark-copies") if any(s and not t for s, t in zip(singly, tabled)) else None
    cells = stored(fold_cells(rows, y, id_col, numeric, categorical, k), "benchmark-cells") if not all(s or t for s, t in zip(singly, tabled)) else None
    drawn = folded.edge_rows(table) if table else []
    done = _parts(spark, path) if path else set()
    kept, lazy, measured = [], [], []

    def keep(model: Model | FoldModel, got: DataFrame, began: float) -> None:
        own = got.select(F.lit(model.name).alias("model"), F.col("fold").cast("int").alias("fold"), F.col("__id").alias("id"), F.col(y).alias("y"), "proba")
        if path:
            own.withColumn("runtime_s", F.lit(time.time() - began)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "fold").parquet(path)
        else:
            part = stored(own, "benchmark-part")
            kept.append(part.withColumn("runtime_s", F.lit(time.time() - began)))

    for m, one, by_row, by_table in zip(models, at_once, singly, tabled):
        began = time.time()
        if by_table:
            score = m.fit_table(table)
            found, lost = folded.areas(table, drawn, score), folded.losses(table, score, metrics.EPS)
            # a fold's rows are scored where somebody reads them
            lazy.append(folded.scored(rows, table, score, id_col, y).select(F.lit(m.name).alias("model"), "fold", "id", "y", "proba"))
            for g, (brier, logloss) in sorted(lost.items()):
                auc, ks = found.get((0, g), (None, 0.0))
                measured.append((m.name, g, auc, max(ks, 0.0), None if auc is None else 2 * auc - 1, brier, logloss, time.time() - began))
            continue
        # a run that may have to start again goes fold by fold
        if one:
            keep(m, m.fit_folds(copies if by_row else cells, y, k, numeric, categorical), began)
            continue
        for f in range(k):
            if (m.name, f) not in done:
                began, own = time.time(), copies.where(F.col("g") == f)
                keep(m, m.fit_predict(own.where("__train"), own.where(~F.col("__train")), y, numeric, categorical), began)
    parts, results = list(lazy), []
    if measured:
        # models by folds rows
        results.append(spark.createDataFrame(measured, "model string, fold int, auc double, ks double, gini double, brier double, logloss double, runtime_s double"))
    if path or kept:
        whole = spark.read.parquet(path).where(F.col("model").isin([m.name for m in models])) if path else reduce(DataFrame.unionByName, kept)
        parts.append(whole.select("model", "fold", "id", "y", "proba"))
        timed = whole.groupBy(F.col("model").alias("t_model"), F.col("fold").alias("t_fold")).agg(F.max("runtime_s").alias("runtime_s"))
        scored = metrics.all_metrics(parts[-1], "proba", "y", "model", "fold")
        # models by folds rows
        results.append(scored.join(F.broadcast(timed), (F.col("model") == F.col("t_model")) & (F.col("fold") == F.col("t_fold"))).drop("t_model", "t_fold"))
    scored = stored(reduce(DataFrame.unionByName, results), "benchmark-metrics")
    # the folds' rows stay where predictions are yet to be made from them
    release(*[d for d in (None if lazy else rows, table and table.rows, copies, cells) if d is not None])
    return reduce(DataFrame.unionByName, parts), scored


def _parts(spark, path: str) -> set[tuple[str, int]]:
    """(model, fold) of the parts under a path: as many as models times folds."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return set()
    return {(r.model, r.fold) for r in spark.read.parquet(path).select("model", "fold").distinct().collect()}


def aligned(predictions: DataFrame, a: str, b: str) -> None:
    """An error unless two models have the same rows and labels."""
    one, two = (predictions.where(F.col("model") == m).select("fold", "id", F.col("y").alias(f"y_{s}")) for m, s in ((a, "a"), (b, "b")))
    if one.join(two, ["fold", "id"], "full").where("y_a is null or y_b is null or y_a <> y_b").limit(1).count():
        raise ValueError(f"predictions of {a} and {b} do not align")


def paired_tests(predictions: DataFrame, folds: DataFrame, champion: str) -> DataFrame:
    """DeLong on out-of-fold scores and Wilcoxon on fold AUCs of each model against the champion, both with Bonferroni's adjustment."""
    areas = metrics.paired_areas(predictions)
    others = [m for m in areas.models if m != champion]
    aucs = {(r.model, r.fold): r.auc for r in folds.select("model", "fold", "auc").collect()}
    ks = sorted({f for _, f in aucs})
    rows = []
    for m in others:
        gap, z, p = areas.test(m, champion)
        w = wilcoxon_p([aucs[m, f] - aucs[champion, f] for f in ks])
        rows.append((m, gap, z, p, w, min(1.0, p * len(others)), min(1.0, w * len(others))))
    names = "auc_diff double, z double, delong_p double, wilcoxon_p double, delong_p_adjusted double, wilcoxon_p_adjusted double"
    return predictions.sparkSession.createDataFrame(rows, f"model string, {names}")
