"""Binning: one aggregate on Spark to levels or pre-bins, then merging on that bounded summary."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.special import FLOOR, MIN_AVG_RATE, MIN_PCT_OBS, SC_LABEL, clean, is_special
from lendframe.operators.metrics import cut, quantile_edges
from lendframe.operators.woe import MAPPED_LEVELS


def _woe(g: float, b: float, tg: float, tb: float) -> float:
    return math.log(max(g / tg if tg else 0.0, FLOOR) / max(b / tb if tb else 0.0, FLOOR))


def _iv(groups: list[list], tg: float, tb: float) -> float:
    return sum((max(g / tg, FLOOR) - max(b / tb, FLOOR)) * _woe(g, b, tg, tb) for _, g, b in groups)


def _merge(groups: list[list], i: int) -> None:
    """Join group i with the next, or with the one before if it is last."""
    j = i if i + 1 < len(groups) else i - 1
    groups[j] = [groups[j][0] + groups[j + 1][0], groups[j][1] + groups[j + 1][1], groups[j][2] + groups[j + 1][2]]
    del groups[j + 1]


#: Why a column can't be binned (fixed values).
CODES = {1: "y has one value among complete cases", 2: "x has one value among complete cases", 3: "y is not 0/1", 4: "no complete cases"}


def cat_bin_checks(df: DataFrame, x: str, y: str, codes: list[str] = ()) -> DataFrame:
    """One row (code, message) if ``cat_bin`` can't work, none if it can; from one aggregate."""
    value = clean(df, x).cast("string")
    whole = ~is_special(value, codes, numeric=False) & F.col(y).isNotNull()
    kept = lambda c: F.when(whole, c)
    row = df.agg(
        F.count(kept(F.lit(1))).alias("n"), (F.max(kept(F.col(y))) == F.min(kept(F.col(y)))).alias("one_y"), (F.max(kept(value)) == F.min(kept(value))).alias("one_x"),
        F.max(F.when(F.col(y).isNotNull() & ~F.col(y).isin(0, 1), 1)).alias("odd"),
    ).first()
    code = 4 if not row.n else 1 if row.one_y else 2 if row.one_x else 3 if row.odd else 0
    return df.sparkSession.createDataFrame([(code, CODES[code])] if code else [], "code int, message string")


def cat_bin(
    df: DataFrame, x: str, y: str, codes: list[str] = (), sc_merge: str = "none", min_pct_obs: float = MIN_PCT_OBS, min_avg_rate: float = MIN_AVG_RATE,
    max_groups: int | None = None, force_trend: str = "modalities",
) -> tuple[DataFrame, DataFrame]:
    """Merge categories until every group has enough rows and bads, then down to ``max_groups`` by least loss of IV.

    Special cases stay apart, or join the first, the last or the group of the closest rate. Returns the summary and the
    table with ``x_bin``; groups are numbered in merge order.
    """
    value = clean(df, x).cast("string")
    rows = df.where(F.col(y).isNotNull())
    counts = rows.groupBy(value.alias("v"), is_special(value, codes, numeric=False).alias("sc")).agg(F.count_if(F.col(y) == 0).alias("g"), F.count_if(F.col(y) == 1).alias("b")).limit(MAPPED_LEVELS + 1).collect()
    if len(counts) > MAPPED_LEVELS:
        raise ValueError(f"{x} has over {MAPPED_LEVELS} levels")
    n, bads = sum(r.g + r.b for r in counts), sum(r.b for r in counts)
    goods = n - bads
    key = (lambda r: r.v) if force_trend == "modalities" else (lambda r: (r.b / (r.g + r.b), r.v))
    groups = [[[r.v], r.g, r.b] for r in sorted((r for r in counts if not r.sc), key=key)]
    special = [r for r in counts if r.sc]
    if not groups or not goods or not bads:
        raise ValueError("cat_bin needs complete cases and both classes")
    need = math.ceil(max(30, n * min_pct_obs))
    while len(groups) > 1 and (low := [i for i, (_, g, b) in enumerate(groups) if g + b < need]):
        _merge(groups, low[0])
    need = math.ceil(max(1, bads * min_avg_rate))
    while len(groups) > 1 and (low := [i for i, (_, _, b) in enumerate(groups) if b < need]):
        _merge(groups, low[0])
    while max_groups and len(groups) > max_groups:
        def loss(i: int) -> float:
            joined = [groups[i][0], groups[i][1] + groups[i + 1][1], groups[i][2] + groups[i + 1][2]]
            return _iv([groups[i], groups[i + 1]], goods, bads) - _iv([joined], goods, bads)
        _merge(groups, min(range(len(groups) - 1), key=loss))
    own = []
    if special:
        sg, sb, names = sum(r.g for r in special), sum(r.b for r in special), [r.v for r in special]
        if sc_merge == "none":
            own = [[names, sg, sb]]
        else:
            rate = sb / (sg + sb) if sg + sb else 0.0
            at = {"first": 0, "last": len(groups) - 1}.get(sc_merge)
            at = min(range(len(groups)), key=lambda i: abs(groups[i][2] / (groups[i][1] + groups[i][2]) - rate)) if at is None else at
            groups[at] = [groups[at][0] + names, groups[at][1] + sg, groups[at][2] + sb]
    width = len(str(len(groups)))
    label = lambda i, names: f"{i + 1:0{max(2, width)}d} [{','.join(sorted('NULL' if v is None else v for v in names))}]"
    made = [(label(i, names), g + b, g, b, b / (g + b), _woe(g, b, goods, bads)) for i, (names, g, b) in enumerate(groups)]
    made += [(SC_LABEL, g + b, g, b, b / (g + b) if g + b else 0.0, _woe(g, b, goods, bads)) for _, g, b in own]
    mapping = {v: label(i, names) for i, (names, _, _) in enumerate(groups) for v in names} | {v: SC_LABEL for names, _, _ in own for v in names}
    pairs = [p for k, v in mapping.items() if k is not None for p in (F.lit(k), F.lit(v))]
    binned = df.withColumn("x_bin", F.coalesce(F.when(value.isNotNull(), F.try_element_at(F.create_map(*pairs), value)), F.lit(mapping.get(None))))
    return df.sparkSession.createDataFrame(made, "bin string, no long, ng long, nb long, dr double, woe double"), binned


#: Trend of the default rate over the bins: the direction before and after the turn; 0 is any.
TRENDS = {"ascending": (1,), "descending": (-1,), "peak": (1, -1), "valley": (-1, 1), "none": (0,)}


class _Parts:
    """Running counts of ordered cells, for the rate and IV of cells i to j - 1 together."""

    def __init__(self, counts: list[tuple[int, int]], tg: int, tb: int) -> None:
        self.g, self.b, self.tg, self.tb = [0], [0], tg, tb
        for g, b in counts:
            self.g.append(self.g[-1] + g)
            self.b.append(self.b[-1] + b)

    def counts(self, i: int, j: int) -> tuple[int, int]:
        return self.g[j] - self.g[i], self.b[j] - self.b[i]

    def rate(self, i: int, j: int) -> float:
        g, b = self.counts(i, j)
        return b / (g + b)

    def gain(self, i: int, j: int) -> float:
        g, b = self.counts(i, j)
        return (max(g / self.tg, FLOOR) - max(b / self.tb, FLOOR)) * _woe(g, b, self.tg, self.tb)


def _partition(parts: _Parts, need: float, max_bins: int, turns: tuple[int, ...]) -> tuple[float, list[int]]:
    """The largest IV, and the ends of its bins, among bins of ``need`` rows whose rates go the ways of ``turns`` one after the other.

    Dynamic programme over (last bin's start, end, number of bins, turns made); fewer bins win a tie.
    """
    m = len(parts.g) - 1
    table: dict[tuple[int, int, int, int], tuple[float, tuple]] = {}
    for j in range(1, m + 1):
        for i in range(j):
            if sum(parts.counts(i, j)) < need:
                continue
            rate, gain = parts.rate(i, j), parts.gain(i, j)
            if i == 0:
                table[0, j, 1, 0] = (gain, ())
            for (h, at, k, turn), (total, _) in [(s, table[s]) for h in range(i) for k in range(1, max_bins) for turn in range(len(turns)) if (s := (h, i, k, turn)) in table]:
                step = rate - parts.rate(h, at)
                for now in range(turn, len(turns)):
                    if (step * turns[now] > 0 or not turns[now]) and total + gain > table.get((i, j, k + 1, now), (-1.0, ()))[0]:
                        table[i, j, k + 1, now] = (total + gain, (h, at, k, turn))
    best: tuple[float, list[int]] = (-1.0, [])
    for state in sorted((s for s in table if s[1] == m), key=lambda s: s[2]):
        if table[state][0] > best[0] + 1e-12:
            cuts, at = [], state
            while at:
                cuts.append(at[1])
                at = table[at][1]
            best = (table[state][0], cuts[::-1])
    return best


def optimal_levels(df: DataFrame, x: str, y: str, codes: list[str] = (), min_share: float = 0.05, max_bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """The bins of largest IV of a text column, exact over its levels: levels stand in the order of their default rates (ties by
    level), so that every cut into neighbours has rising rates, the best trend there is.

    A bin holds ``min_share`` of the complete cases and both classes; without such bins all levels are one. NULL and ``codes``
    stay apart as Special. One aggregate over the levels, of which more than a bound are refused. Returns the summary and the
    table with ``x_bin``; a level that is new to the map has a NULL bin.
    """
    value = clean(df, x).cast("string")
    rows = df.where(F.col(y).isNotNull())
    counts = rows.groupBy(value.alias("v"), is_special(value, codes, numeric=False).alias("sc")).agg(F.count_if(F.col(y) == 0).alias("g"), F.count_if(F.col(y) == 1).alias("b")).limit(MAPPED_LEVELS + 1).collect()
    if len(counts) > MAPPED_LEVELS:
        raise ValueError(f"{x} has over {MAPPED_LEVELS} levels")
    kept = sorted((r for r in counts if not r.sc and r.g + r.b), key=lambda r: (r.b / (r.g + r.b), r.v))
    special = [r for r in counts if r.sc and r.g + r.b]
    tg, tb = sum(r.g for r in counts), sum(r.b for r in counts)
    if not kept or not tg or not tb:
        raise ValueError("optimal_levels needs complete cases and both classes")
    m = len(kept)
    g, b = (np.concatenate([[0], np.cumsum([getattr(r, c) for r in kept])]).astype(float) for c in "gb")
    # best[j]: the largest IV of the first j levels in k bins; all last bins' starts at once
    best, ways, found = np.full(m + 1, -np.inf), [], (-np.inf, 0)
    best[0] = 0.0
    for k in range(1, max_bins + 1):
        after, way = np.full(m + 1, -np.inf), np.zeros(m + 1, dtype=int)
        for j in range(1, m + 1):
            own_g, own_b = g[j] - g[:j], b[j] - b[:j]
            fits = (own_g > 0) & (own_b > 0) & (own_g + own_b >= min_share * (g[m] + b[m]))
            if fits.any():
                share_g, share_b = np.maximum(own_g / tg, FLOOR), np.maximum(own_b / tb, FLOOR)
                total = np.where(fits, best[:j] + (share_g - share_b) * np.log(share_g / share_b), -np.inf)
                way[j] = int(np.argmax(total))
                after[j] = total[way[j]]
        best = after
        ways.append(way)
        if best[m] > found[0] + 1e-12:
            found = (best[m], k)
    ends, at = [], m
    for k in range(found[1], 0, -1):
        ends.append(at)
        at = ways[k - 1][at]
    made, mapping, start = [], {}, 0
    for i, stop in enumerate(ends[::-1] or [m], 1):
        group = kept[start:stop]
        label = f"{i:02d} [{','.join(sorted(r.v for r in group))}]"
        mapping |= {r.v: label for r in group}
        gg, bb = sum(r.g for r in group), sum(r.b for r in group)
        made.append((label, gg + bb, gg, bb, bb / (gg + bb), _woe(gg, bb, tg, tb)))
        start = stop
    if special:
        gg, bb = sum(r.g for r in special), sum(r.b for r in special)
        made.append(("Special", gg + bb, gg, bb, bb / (gg + bb), _woe(gg, bb, tg, tb)))
    pairs = [F.lit(p) for pair in mapping.items() for p in pair]
    binned = df.withColumn("x_bin", F.when(is_special(value, codes, numeric=False), F.lit("Special")).otherwise(F.try_element_at(F.create_map(*pairs), value)))
    return df.sparkSession.createDataFrame(made, "bin string, no long, ng long, nb long, dr double, woe double"), binned


def optimal_bins(df: DataFrame, x: str, y: str, codes: list = (), prebins: int = 20, min_share: float = 0.05, max_bins: int = 10, trend: str = "monotone") -> DataFrame:
    """The contiguous bins of largest IV whose default rate follows ``trend``, exact over the pre-bins (quantiles).

    ``trend``: ascending, descending, peak or valley (one turn, at an end too), none, monotone (the better of the first two) or
    auto (the best of the first four; the first of them wins a tie).
    """
    if trend not in (*TRENDS, "monotone", "auto"):
        raise ValueError(f"no trend {trend}")
    value = clean(df, x)
    rows = df.where(F.col(y).isNotNull()).withColumn("__x", value).withColumn("__sc", is_special(value, codes))
    edges = quantile_edges(rows.where(~F.col("__sc")), "__x", prebins)
    counts = rows.groupBy("__sc", F.when(~F.col("__sc"), cut(F.col("__x"), edges)).alias("k")).agg(F.count_if(F.col(y) == 0).alias("g"), F.count_if(F.col(y) == 1).alias("b")).collect()
    cells = sorted((r.k, r.g, r.b) for r in counts if not r["__sc"])
    special = [(r.g, r.b) for r in counts if r["__sc"]]
    tg, tb = sum(r.g for r in counts), sum(r.b for r in counts)
    m = len(cells)
    if not m or not tg or not tb:
        raise ValueError("optimal_bins needs complete cases and both classes")
    parts = _Parts([(g, b) for _, g, b in cells], tg, tb)
    need = min_share * (parts.g[-1] + parts.b[-1])
    best: tuple[float, list[int]] = (-1.0, [])
    for name in {"monotone": ["ascending", "descending"], "auto": ["ascending", "descending", "peak", "valley"]}.get(trend, [trend]):
        tried = _partition(parts, need, max_bins, TRENDS[name])
        if tried[0] > best[0] + 1e-12:
            best = tried
    cg, cb = parts.g, parts.b
    out, start = [], 0
    # a pre-bin k ends at edge k
    for stop in best[1] or [m]:
        g, b = cg[stop] - cg[start], cb[stop] - cb[start]
        low = "-inf" if start == 0 else f"{edges[cells[start - 1][0]]:.2f}"
        high = "inf" if stop == m else f"{edges[cells[stop - 1][0]]:.2f}"
        out.append((f"({low}, {high}{')' if high == 'inf' else ']'}", g + b, g, b, b / (g + b), _woe(g, b, tg, tb)))
        start = stop
    out += [("Special", g + b, g, b, b / (g + b), _woe(g, b, tg, tb)) for g, b in special]
    return df.sparkSession.createDataFrame(out, "bin string, no long, ng long, nb long, dr double, woe double")


def ord_to_int(df: DataFrame, x: str, name: str) -> DataFrame:
    """Sorted levels to 1..k: the levels of a categorical column are few and go into the plan as a map."""
    known = [r[0] for r in df.select(x).where(F.col(x).isNotNull()).distinct().orderBy(x).limit(MAPPED_LEVELS + 1).collect()]
    if len(known) > MAPPED_LEVELS:
        raise ValueError(f"{x} has over {MAPPED_LEVELS} levels")
    return df.withColumn(name, F.when(F.col(x).isNotNull(), F.array_position(F.array(*[F.lit(v) for v in known]), F.col(x))).cast("int"))
