"""Clustering of risk factors: distances on Spark, linkage on the matrix of columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lendframe.functions.special import is_numeric
from lendframe.operators import exact_trees


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> np.ndarray:
    ready = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(df)
    return Correlation.corr(ready, "__v", method).first()[0].toArray()


def x2y(df: DataFrame, columns: list[str], least: float = 0.1) -> DataFrame:
    """(x, y, x2y): for all ordered pairs, the share of the error of y that a tree on x alone removes, between 0 and 1.

    Numbers: mean absolute error against that of the mean; text columns: share of wrong classes against the most frequent one. A
    text column as x is coded by the order of its levels, of which too many are refused. Leaves hold ``least`` of the pair's rows
    and 30 or more. Rows with a NULL in one of the two don't count; NULL for under 30 pairs or a constant side. The trees of all
    pairs grow together, so that each level is one job, whatever the number of columns.
    """
    text = [c for c in columns if not is_numeric(df, c)]
    known = {c: exact_trees.levels(df, c) for c in text}
    coded = exact_trees.codes(df, columns)
    pairs = [(a, b) for a in columns for b in columns if a != b]
    # doubles without NULL, which is NaN here
    plain = df.select(*[F.coalesce(coded[c].cast("double"), F.lit(math.nan)).alias(f"x{i}") for i, c in enumerate(columns)])
    numbers = [(columns.index(a), columns.index(b)) for a, b in pairs]
    facts = dict(zip(pairs, _pair_facts(plain, numbers))) if pairs else {}
    middle = dict(zip(columns, df.agg(*[F.round(F.avg(coded[c]), 3) for c in columns]).first())) if pairs else {}
    usable = [p for p in pairs if facts[p].n >= 30 and facts[p].vary]
    # numbers about their mean; two classes need one column
    targets = {c: [(coded[c] == i).cast("long").cast("decimal(28,10)") for i in range(1 if len(known[c]) == 2 else 0, len(known[c]))] for c in text}
    targets |= {c: [(coded[c] - middle[c]).cast("decimal(28,10)")] for c in columns if c not in text and middle.get(c) is not None}
    sizes = [max(30, int(least * facts[p].n)) for p in usable]
    sums: dict = {}
    trees = exact_trees.grow(df, [targets[b] for _, b in usable], [{a: coded[a]} for a, _ in usable], sizes, leaves=sums) if usable else []
    share, guesses = {}, []
    for i, (a, b) in enumerate(usable):
        # from left to right, each (n, s0, ...)
        own = [sums[i, leaf] for leaf in trees[i].leaves()]
        if b in text:
            counts = [[n - s[0], s[0]] if len(known[b]) == 2 else s[: len(known[b])] for n, *s in own]
            share[a, b] = (facts[a, b].n - int(sum(max(c) for c in counts)), facts[a, b].n - int(max(map(sum, zip(*counts)))))
        else:
            cuts = sorted(c for _, c in trees[i].splits.values())
            guesses.append((i, columns.index(a), columns.index(b), facts[a, b].mean, cuts, [float(middle[b]) + float(s[0]) / n for n, *s in own]))
    share |= {usable[i]: found for i, found in _errors(plain, guesses).items()}
    out = [(a, b, (min(1.0, max(0.0, 1 - share[a, b][0] / share[a, b][1])) if share[a, b][1] else 0.0) if (a, b) in share else None) for a, b in pairs]
    return df.sparkSession.createDataFrame(out, "x string, y string, x2y double")


def _pair_facts(plain: DataFrame, pairs: list[tuple[int, int]]) -> list:
    """(n, vary, mean) of each pair of columns x0, x1, ...: rows with both, whether both vary among them, the mean of the second.

    An aggregate of so many columns would be one method too long to be compiled; each partition gives a row a pair.
    """

    def partial(batches):
        n, total, low, high = np.zeros(len(pairs)), np.zeros(len(pairs)), np.full((len(pairs), 2), np.inf), np.full((len(pairs), 2), -np.inf)
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            there = [~np.isnan(v) for v in x]
            for i, (a, b) in enumerate(pairs):
                both = there[a] & there[b]
                if both.any():
                    own, other = x[a][both], x[b][both]
                    n[i], total[i] = n[i] + len(own), total[i] + other.sum()
                    low[i] = np.minimum(low[i], (own.min(), other.min()))
                    high[i] = np.maximum(high[i], (own.max(), other.max()))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.arange(len(pairs)), n, total, low[:, 0], low[:, 1], high[:, 0], high[:, 1])], names=["pair", "n", "s", "la", "lb", "ha", "hb"])

    rows = plain.mapInArrow(partial, "pair long, n double, s double, la double, lb double, ha double, hb double").groupBy("pair").agg(
        F.sum("n").cast("long").alias("n"), ((F.min("la") < F.max("ha")) & (F.min("lb") < F.max("hb"))).alias("vary"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean")
    ).collect()  # pairs
    empty = Row(pair=-1, n=0, vary=False, mean=None)
    found = {r.pair: r for r in rows}
    return [found.get(i, empty) for i in range(len(pairs))]


def _errors(plain: DataFrame, guesses: list[tuple]) -> dict[int, tuple[float, float]]:
    """guesses: (key, x, y, mean of y, cuts of x, guesses between them). By key the sums of absolute errors, the mean's after them."""
    if not guesses:
        return {}

    def partial(batches):
        own, base = np.zeros(len(guesses)), np.zeros(len(guesses))
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for i, (_, a, b, mean, cuts, values) in enumerate(guesses):
                told = np.asarray(values)[np.searchsorted(cuts, x[a])]
                off = ~(np.isnan(x[a]) | np.isnan(x[b]))
                own[i] += np.abs(x[b] - told)[off].sum()
                base[i] += np.abs(x[b] - mean)[off].sum()
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in guesses]), pa.array(own), pa.array(base)], names=["key", "own", "base"])

    rows = plain.mapInArrow(partial, "key long, own double, base double").groupBy("key").agg(F.sum("own").alias("own"), F.sum("base").alias("base")).collect()  # pairs
    return {r.key: (r.own, r.base) for r in rows}


def distances(df: DataFrame, columns: list[str], metric: str = "common pearson") -> np.ndarray:
    """metric: raw, common, absolute or sqrt with pearson or spearman, or x2y."""
    if metric == "x2y":
        k = len(columns)
        out = np.zeros((k, k))
        told = {(r.x, r.y): r.x2y for r in x2y(df, columns).collect()}
        for i in range(k):
            for j in range(i):
                # the mean of the directions that could be told; pairs of which nothing is known are apart
                ways = [w for w in (told[columns[i], columns[j]], told[columns[j], columns[i]]) if w is not None]
                out[i, j] = out[j, i] = 1 - (sum(ways) / len(ways) if ways else 0.0)
        return out
    kind, method = metric.split()
    c = correlation_matrix(df, columns, method)
    return {"raw": (1 - c), "common": (1 - c) / 2, "absolute": 1 - np.abs(c), "sqrt": np.sqrt(np.maximum(1 - c * c, 0))}[kind]


def linkage(distance: np.ndarray) -> list[tuple[int, int]]:
    """Merges of centroid linkage by the Lance-Williams update on squared distances."""
    n = len(distance)
    d = {(i, j): distance[i, j] ** 2 for i in range(n) for j in range(i)}
    size, merges, live, fresh = dict.fromkeys(range(n), 1), [], list(range(n)), n
    get = lambda a, b: d[max(a, b), min(a, b)]
    while len(live) > 1:
        a, b = min(((x, y) for x in live for y in live if x > y), key=lambda p: (get(*p), p))
        for k in live:
            if k not in (a, b):
                na, nb = size[a], size[b]
                d[fresh, k] = (na * get(a, k) + nb * get(b, k)) / (na + nb) - na * nb * get(a, b) / (na + nb) ** 2
        size[fresh] = size[a] + size[b]
        merges.append((a, b))
        live = [x for x in live if x not in (a, b)] + [fresh]
        fresh += 1
    return merges


def cut_tree(merges: list[tuple[int, int]], n: int, k: int) -> list[int]:
    members = {i: [i] for i in range(n)}
    for step, (a, b) in enumerate(merges[: n - k]):
        members[n + step] = members.pop(a) + members.pop(b)
    label = [0] * n
    for c, group in enumerate(sorted(members.values(), key=min), 1):
        for i in group:
            label[i] = c
    return label


def rf_clustering(df: DataFrame, columns: list[str], metric: str = "common pearson", k: int | None = None) -> DataFrame:
    """(rf, cluster, distance to the own cluster); without ``k`` the elbow of the within-cluster sum decides."""
    d = distances(df, columns, metric)
    merges, n = linkage(d), len(columns)

    def within(labels: list[int]) -> float:
        return sum(d[i, j] ** 2 for i in range(n) for j in range(i) if labels[i] == labels[j])

    if k is None:
        w = [within(cut_tree(merges, n, c)) for c in range(1, n + 1)]
        far = [abs((w[-1] - w[0]) * (c - 1) - (n - 1) * (x - w[0])) / math.hypot(w[-1] - w[0], n - 1) for c, x in enumerate(w, 1)]
        k = 1 + int(np.argmax(far))
    labels = cut_tree(merges, n, k)
    rows = []
    for i, c in enumerate(columns):
        own = [j for j in range(n) if labels[j] == labels[i] and j != i]
        rows.append((c, labels[i], float(np.mean([d[i, j] for j in own])) if own else 0.0))
    return df.sparkSession.createDataFrame(rows, "rf string, cluster int, dist_to_cluster double")
