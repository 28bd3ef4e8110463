"""Scorecard trees, tree-leaf interactions and segment validation: one aggregate over all candidate cuts a level."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.functions.dist import phi, two_sided
from lendframe.functions.draws import uniform
from lendframe.functions.special import clean, is_numeric
from lendframe.operators import exact_trees
from lendframe.operators.quantiles import of_counts

DECILES = [i / 10 for i in range(1, 10)]
#: Cumulative chances of 0, 1, ... of a Poisson variable of mean 2 / 3.
DRAWS = [sum(math.exp(-2 / 3) * (2 / 3) ** j / math.factorial(j) for j in range(i + 1)) for i in range(6)]


def _z(g1: float, b1: float, g0: float, b0: float) -> float:
    n1, n0 = g1 + b1, g0 + b0
    pool = (b1 + b0) / (n1 + n0)
    spread = math.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0)) if 0 < pool < 1 else 0.0
    return (b1 / n1 - b0 / n0) / spread if spread else 0.0


def best_splits(df: DataFrame, node: Column, y: str, factors: list[str]) -> list:
    """(node, rf, cut, left goods, left bads, right goods, right bads) of all candidates: deciles, or one category."""
    rows = df.withColumn("__node", node).where(F.col(y).isNotNull())
    numeric = [c for c in factors if is_numeric(df, c)]
    rest = [c for c in factors if c not in numeric]
    out = []
    if numeric:
        long = rows.select("__node", F.col(y).alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("rf"), F.col(f"`{c}`").cast("double").alias("v")) for c in numeric]))).where("v is not null")
        counts = long.groupBy("__node", "rf", "v").agg(F.count(F.lit(1)).alias("n"))
        cuts = of_counts(counts, ["__node", "rf"], DECILES).select(F.col("__node").alias("n"), F.col("rf").alias("r"), F.array_distinct("q").alias("cuts"))
        # nodes by factors rows of nine cuts
        tried = long.join(F.broadcast(cuts), (F.col("__node") == F.col("n")) & (F.col("rf") == F.col("r"))).select("__node", "rf", "y", "v", F.explode("cuts").alias("cut"))
        left = F.col("v") <= F.col("cut")
        out += tried.groupBy("__node", "rf", F.col("cut").cast("string").alias("cut")).agg(
            F.count_if(left & (F.col("y") == 0)).alias("lg"), F.count_if(left & (F.col("y") == 1)).alias("lb"),
            F.count_if(~left & (F.col("y") == 0)).alias("rg"), F.count_if(~left & (F.col("y") == 1)).alias("rb"),
        ).collect()
    if rest:
        long = rows.select("__node", F.col(y).alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("rf"), F.col(f"`{c}`").cast("string").alias("v")) for c in rest]))).where("v is not null")
        counts = long.groupBy("__node", "rf", F.col("v").alias("cut")).agg(F.count_if(F.col("y") == 0).alias("lg"), F.count_if(F.col("y") == 1).alias("lb")).collect()
        totals: dict = {}
        for r in counts:
            g, b = totals.get((r["__node"], r.rf), (0, 0))
            totals[r["__node"], r.rf] = (g + r.lg, b + r.lb)
        from pyspark.sql import Row

        for r in counts:
            g, b = totals[r["__node"], r.rf]
            out.append(Row(__node=r["__node"], rf=r.rf, cut=r.cut, lg=r.lg, lb=r.lb, rg=g - r.lg, rb=b - r.lb))
    return out


def decision_tree(df: DataFrame, y: str, factors: list[str], min_pct_obs: float = 0.05, min_avg_rate: float = 0.01, p_value: float = 0.05, max_depth: int = 3, monotone: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Splits by the largest two-proportion z that is significant; leaf 0 holds rows with a NULL in a split variable.

    Returns the leaf summary with rules and the table with ``leaf``.
    """
    row = df.agg(F.count(y), F.count_if(F.col(y) == 1)).first()
    need, need_bad = max(30, math.ceil(row[0] * min_pct_obs)), max(1, math.ceil(row[1] * min_avg_rate))
    node: Column = F.lit(1)
    frontier, rules, following = [1], {1: ""}, 2
    for _ in range(max_depth):
        if not frontier:
            break
        fits: dict[int, tuple] = {}
        for r in best_splits(df.where(node.isin(frontier)), node, y, factors):
            if min(r.lg + r.lb, r.rg + r.rb) < need or min(r.lb, r.rb) < need_bad:
                continue
            z = _z(r.lg, r.lb, r.rg, r.rb)
            if two_sided(z) >= p_value or (monotone and r.rf in monotone and -z * monotone[r.rf] < 0):
                continue
            key = (-abs(z), r.rf, r.cut)
            if r["__node"] not in fits or key < fits[r["__node"]]:
                fits[r["__node"]] = key
        node_before, frontier_next = node, []
        for at in [n for n in frontier if n in fits]:
            _, rf, cut = fits[at]
            number = is_numeric(df, rf)
            v = F.col(f"`{rf}`").cast("double" if number else "string")
            left = v <= float(cut) if number else v == cut
            node = F.when(node_before == at, F.when(v.isNull(), 0).when(left, following).otherwise(following + 1)).otherwise(node)
            rules[following] = f"{rules[at]} & {rf} {'<=' if number else '='} {cut}".removeprefix(" & ")
            rules[following + 1] = f"{rules[at]} & {rf} {'>' if number else '<>'} {cut}".removeprefix(" & ")
            frontier_next += [following, following + 1]
            following += 2
        frontier = frontier_next
    out = df.withColumn("leaf", node)
    texts = F.create_map(*[F.lit(x) for k, v in ({0: "missing"} | rules).items() for x in (k, v)])
    summary = out.groupBy("leaf").agg(F.count(y).alias("no"), F.count_if(F.col(y) == 1).alias("nb"), F.avg(F.col(y).cast("double")).alias("dr")).withColumn("rule", texts[F.col("leaf")])
    return summary, out


def _leaf_table(df: DataFrame, rows: list[Column]) -> DataFrame:
    """rows: structs (tree, leaf, path, n, s). Counts and bads of each leaf."""
    return df.select(F.inline(F.array(*rows))).where("leaf is not null and n > 0 and s is not null").groupBy("tree", "leaf", "path").agg(
        F.sum("n").alias("no"), F.sum("s").alias("nb"), (F.sum("s") / F.sum("n")).alias("dr")
    )


def interaction_leaves(df: DataFrame, y: str, factors: list[str], min_pct_obs: float = 0.05, max_depth: int = 3, name: str = "interaction") -> tuple[DataFrame, DataFrame]:
    """Leaves of a Gini tree as a new factor L1, L2, ... from left to right; rows with a NULL in a factor get NULL.

    Text factors become 0/1 columns. Returns (leaf, no, nb, dr, path) and the table with the factor.
    """
    columns, target = exact_trees.dummies(df, factors), F.col(f"`{y}`").cast("long")
    # a text column of one level has no 0/1 column, and its NULLs still count as missing
    given = exact_trees.whole({c: clean(df, c) for c in factors})
    least = max(int(min_pct_obs * df.where(given & target.isNotNull()).count()), 30)
    (tree,) = exact_trees.grow(df.where(given), target, [columns], least, max_depth)
    labels = tree.labels()
    leaf = F.when(given, tree.place(columns, labels))
    path = F.when(given, tree.place(columns, {n: tree.rule(n) for n in labels}))
    info = _leaf_table(df, [F.struct(F.lit(1).alias("tree"), leaf.alias("leaf"), path.alias("path"), F.lit(1).alias("n"), target.alias("s"))]).drop("tree")
    return info, df.withColumn(name, leaf)


def interaction(df: DataFrame, y: str, factors: list[str], min_pct_obs: float = 0.05, max_depth: int = 3, name: str = "interaction") -> DataFrame:
    """The table with the leaf factor of ``interaction_leaves``."""
    return interaction_leaves(df, y, factors, min_pct_obs, max_depth, name)[1]


def forest_factors(factors: list[str], trees: int, per_tree: int | None, seed: int) -> list[list[str]]:
    """The factors drawn for each tree: the square root of their number unless said otherwise."""
    k = min(len(factors), per_tree or max(1, round(math.sqrt(len(factors)))))
    return [sorted(random.Random(seed + i).sample(factors, k)) for i in range(trees)]


def forest_leaves(
    df: DataFrame, y: str, factors: list[str], id_col: str | None = None, trees: int = 10, per_tree: int | None = None, max_depth: int = 2, seed: int = 991, min_pct_obs: float = 0.05
) -> tuple[DataFrame, DataFrame]:
    """Per tree a two-thirds bootstrap and a draw of factors; the leaves as columns tree_1, tree_2, ..., all trees grown together.

    How often a row is drawn is a Poisson variable by a hash of ``id_col``, without it of the row's values (equal rows are then
    drawn alike). Text factors are coded by the order of their levels. Returns (tree, leaf, no, nb, dr, path) over the samples
    and the table with the columns; a row with a NULL in a tree's factors gets NULL.
    """
    picked = forest_factors(factors, trees, per_tree, seed)
    coded, target = exact_trees.codes(df, factors), F.col(f"`{y}`").cast("long")
    parts = [F.col(f"`{id_col}`")] if id_col else [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    times = []
    for i in range(trees):
        u = uniform(F.lit(seed + i), *parts)
        times.append(sum((u >= c).cast("int") for c in DRAWS))
    columns = [{c: coded[c] for c in own} for own in picked]
    # one hash a row and tree, not one a cell
    drawn = df.withColumns({f"__times_{i}": t for i, t in enumerate(times)})
    weights = [F.col(f"__times_{i}") for i in range(trees)]
    least = max(1, round(min_pct_obs * round(2 / 3 * df.count())))
    grown = exact_trees.grow(drawn, target, columns, least, max_depth, weights)
    place = lambda i, names: F.when(exact_trees.whole(columns[i]), grown[i].place(columns[i], names))
    rules = [{n: t.rule(n) for n in t.leaves()} for t in grown]
    info = _leaf_table(drawn, [
        F.struct(F.lit(i + 1).alias("tree"), place(i, t.labels()).alias("leaf"), place(i, rules[i]).alias("path"), weights[i].alias("n"), (target * weights[i]).alias("s")) for i, t in enumerate(grown)
    ])
    return info, df.withColumns({f"tree_{i + 1}": place(i, t.labels()) for i, t in enumerate(grown)})


def forest_interactions(
    df: DataFrame, y: str, factors: list[str], id_col: str | None = None, trees: int = 10, per_tree: int | None = None, max_depth: int = 2, seed: int = 991, min_pct_obs: float = 0.05
) -> DataFrame:
    """The table with the columns of ``forest_leaves``."""
    return forest_leaves(df, y, factors, id_col, trees, per_tree, max_depth, seed, min_pct_obs)[1]


def segment_validation(df: DataFrame, y: str, pd_col: str, factors: list[str], min_leaf: float = 0.03, alpha: float = 0.05, max_depth: int | None = None) -> DataFrame:
    """A regression tree on residuals; per leaf its rule, mean residual, and observed against modelled rate.

    Residuals are taken to 12 digits. Text factors are coded by the order of their levels, NULL as -1; rows with a NULL in
    another factor, the target or ``pd_col`` are left out. ``p_val`` and ``test_res`` come from a one-sided z test with the spread
    of the observed rate, ``z``, ``p_value`` and ``res`` from one with that of the modelled rate. A tree without a split has no rows.
    """
    columns = exact_trees.codes(df, factors, missing=-1.0)
    rows = df.where(exact_trees.whole(columns) & F.col(f"`{y}`").isNotNull() & clean(df, pd_col).isNotNull())
    error = (F.col(f"`{y}`").cast("double") - F.col(f"`{pd_col}`").cast("double")).cast("decimal(18,12)")
    least = max(30, round(min_leaf * rows.count()))
    (tree,) = exact_trees.grow(rows, error, [columns], least, max_depth)
    names = tree.leaves()
    leaves = rows.groupBy(tree.place(columns).alias("leaf")).agg(
        F.count(F.lit(1)).alias("no"), F.sum(F.col(f"`{y}`").cast("long")).alias("nb"), F.sum(F.col(f"`{pd_col}`").cast("decimal(18,12)")).cast("double").alias("nb_mod"), F.sum(error).cast("double").alias("error")
    )
    out = []
    for r in leaves.collect() if tree.splits else []:  # at most 1 / min_leaf leaves
        odr, rate = r.nb / r.no, r.nb_mod / r.no
        spread = math.sqrt(rate * (1 - rate) / r.no) if 0 < rate < 1 else 0.0
        z = (odr - rate) / spread if spread else 0.0
        p = 1 - phi(abs(z))
        # rates of 0 and 1 leave room for a spread
        near = 0.00001 if round(odr, 5) == 0 else 0.99999 if round(odr, 5) == 1 else odr
        apart = (rate - near) / math.sqrt(near * (1 - near) / r.no)
        p_val = phi(apart) if r.nb_mod <= r.nb else 1 - phi(apart)
        verdict = "equal" if p_val >= alpha else "overestimate" if r.nb_mod > r.nb else "underestimate"
        out.append((names.index(r.leaf) + 1, tree.rule(r.leaf), r.error / r.no, r.no, odr, rate, z, p, "equal" if p >= alpha else "under" if z > 0 else "over", r.no - r.nb, r.no - r.nb_mod, r.nb, r.nb_mod, rate - odr, p_val, verdict))
    return df.sparkSession.createDataFrame(
        out, "segment int, rule string, avg double, no long, odr double, pd double, z double, p_value double, res string, ng_obs long, ng_mod double, nb_obs long, nb_mod double, dr_diff double, p_val double, test_res string"
    )
