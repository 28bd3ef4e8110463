"""DuckDB SQL of logistic fits, for checking the selection and validation queries by another engine.

A fit is Newton's method in a recursive query over counted cells; each step solves the normal equations by eliminating the
rows of an augmented matrix, held as a list of lists. Fits of many groups, such as all subsets of the candidates, run side
by side.
"""

from __future__ import annotations

from lendframe.functions.dist import phi_sql


def newton(name: str, cells: str, p: int, rounds: int = 14) -> str:
    """CTEs ``name`` (g, b, var, dev) from ``cells`` (g, x, y, w, o): x is a list of p doubles, the first 1; one fit a group g.

    A column that is 0 throughout a group is left out of its fit and keeps the coefficient 0. To follow WITH RECURSIVE.
    """
    eta = " + ".join(f"b[{i}] * x[{i}]" for i in range(1, p + 1))
    sums = ", ".join(
        [f"sum(w * q * (1 - q) * x[{i}] * x[{j}]) as h{i}_{j}" for i in range(1, p + 1) for j in range(i, p + 1)] + [f"sum(w * (y - q) * x[{i}]) as g{i}" for i in range(1, p + 1)]
    )
    h = lambda i, j: f"h{min(i, j)}_{max(i, j)}"
    row = lambda i: "[" + ", ".join(
        [(f"{h(i, j)} + (({h(i, i)}) = 0)::int" if i == j else h(i, j)) for j in range(1, p + 1)] + [f"g{i}"] + [f"{int(i == j)}::double" for j in range(1, p + 1)]
    ) + "]"
    matrix = f"select g, it, b, dev, [{', '.join(map(row, range(1, p + 1)))}]::double[][] as a from sums"
    for k in range(1, p + 1):
        step = f"case when i = {k} then list_transform(r, lambda v: v / a[{k}][{k}]) else list_transform(r, lambda v, j: v - r[{k}] * a[{k}][j] / a[{k}][{k}]) end"
        matrix = f"select g, it, b, dev, list_transform(a, lambda r, i: {step}) as a from ({matrix})"
    return f"""{name}_fit(g, it, b, var, dev) as (
  select distinct g, 0, list_transform(range({p}), lambda i: 0.0::double), list_transform(range({p}), lambda i: 0.0::double), 0.0::double from {cells}
  union all
  select g, it + 1, list_transform(b, lambda v, i: v + greatest(least(a[i][{p + 1}], 20), -20)), list_transform(b, lambda v, i: a[i][{p + 1} + i]), dev from (
    with linear as (
      select c.g, f.it, f.b, c.x, c.y, c.w, greatest(least(1 / (1 + exp(-({eta} + c.o))), 1 - 1e-12), 1e-12) as q from {name}_fit f join {cells} c on c.g = f.g where f.it < {rounds}
    ), sums as (
      select g, it, b, {sums}, sum(-2 * w * case when y = 1 then ln(q) else ln(1 - q) end) as dev from linear group by g, it, b
    ) {matrix}
  )
), {name} as (select g, b, var, dev from {name}_fit where it = {rounds})"""


def p_value(b: str, var: str) -> str:
    z = f"abs({b} / sqrt({var}))"
    return f"(2 * (1 - ({phi_sql(z)})))"


def subset_cells(name: str, source: str, columns: list[str], y: str, offset: str = "0") -> str:
    """CTE ``name``: the counted rows of ``source`` once for each subset of the columns; g is the subset's bit mask."""
    x = ", ".join(f"case when g & {1 << i} > 0 then {c}::double else 0 end" for i, c in enumerate(columns))
    return f"""{name} as (
  select g, [1.0::double, {x}] as x, y, w, o
  from (select {', '.join(columns)}, {y} as y, {offset}::double as o, count(*)::double as w from {source} group by all), range(0, {1 << len(columns)}) m(g)
)"""


def forward(
    name: str, fits: str, columns: list[str], p_limit: float = 0.05, sign: int | dict[str, str] = -1, groups: dict[str, int] | None = None, by_aic: bool = False,
    start: list[str] = (), free: list[str] = (),
) -> str:
    """CTE ``name`` (step, rf, coefficient, p_value, aic, mask): greedy forward selection over the fits of all subsets.

    ``free`` columns may have any sign; ``start`` columns are in the model from the beginning. ``sign``: of all coefficients, or
    for each column an expression that has it.
    """
    signs = sign if isinstance(sign, dict) else dict.fromkeys(columns, sign)
    n, first = len(columns), sum(1 << columns.index(c) for c in start)
    ps = ", ".join(p_value(f"b[{i + 2}]", f"var[{i + 2}]") for i in range(n))
    ok = lambda i: f"p[{i + 1}] < {p_limit}" + (f" and {signs[columns[i]]} * b[{i + 2}] > 0" if signs[columns[i]] and columns[i] not in free else "")
    options = []
    for i, c in enumerate(columns):
        bit = 1 << i
        good = ok(i) if not by_aic else " and ".join(f"(s.g & {1 << j} = 0 or ({ok(j)}))" for j in range(n))
        rank = "s.aic" if by_aic else f"p[{i + 1}]"
        order = (groups or {}).get(c, 0)
        options.append(
            f"select t.step, t.mask, {order} as grp, {rank} as rank, '{c}' as rf, s.g, s.b[{i + 2}] as coefficient, p[{i + 1}] as p_value, s.aic from taken t join {name}_scored s on s.g = t.mask | {bit} "
            f"where t.mask & {bit} = 0 and t.grp <= {order} and {good}"
        )
    union = " union all ".join(options)
    return f"""{name}_scored as (
  select g, b, dev + 2 * (1 + bit_count(g)) as aic, [{ps}] as p from {fits}
), {name}_steps(step, mask, grp, rf, coefficient, p_value, aic) as (
  select 0, {first}, 0, null::varchar, null::double, null::double, null::double
  union all
  select step + 1, best.g, best.grp, best.rf, best.coefficient, best.p_value, best.aic from (
    with taken as (select step, mask, grp from {name}_steps), option as ({union})
    select step, arg_min({{'g': g, 'grp': grp, 'rf': rf, 'coefficient': coefficient, 'p_value': p_value, 'aic': aic}}, (grp, rank, rf)) as best from option group by step
  )
), {name} as (select step, rf, coefficient, p_value, aic, mask from {name}_steps where step > 0)"""
