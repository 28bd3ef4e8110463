"""SQL of exact-cut trees: a recursive query whose every step tries all cuts of all open nodes."""

from __future__ import annotations


def base(source: str, columns: dict[str, str], target: str, tree: int = 1, id_: str = "id", weight: str = "1") -> str:
    """The rows of one tree: ``columns`` are numeric expressions by name."""
    whole = " and ".join(f"({e}) is not null" for e in columns.values())
    return f"""select 0 as level, {tree} as tree, {id_} as id, '' as node, '' as rule, ({weight})::bigint as n, {target} as s, [{', '.join(f"({e})::double" for e in columns.values())}] as x,
      [{', '.join(f"'{c}'" for c in columns)}] as f from {source} where {whole}"""


def grown(name: str, rows: str, least: str, depth: int = 60, each: bool = False) -> str:
    """CTE ``name`` (tree, id, node, rule, n, s): the leaf of every row; ``rows`` is a union of ``base``, ``least`` a table with one number,
    or (tree, least) for each tree."""
    limits = f"join {least} using (tree)" if each else f", {least} k(least)"
    return f"""{name}_steps(level, tree, id, node, rule, n, s, x, f) as ({rows} union all (
    with l as (select tree, node, unnest(range(1, len(x) + 1)) as col, x, n, s from {name}_steps where n > 0 and s is not null),
      c as (select tree, node, col, x[col] as v, sum(n) as n, sum(s * n) as s from l group by all),
      w as (select tree, node, col, v, sum(n) over up as nl, sum(s) over up as sl, sum(n) over whole as na, sum(s) over whole as sa, lead(v) over (partition by tree, node, col order by v) as after
        from c window up as (partition by tree, node, col order by v), whole as (partition by tree, node, col)),
      g as (select tree, node, col, v, case when (v + after) / 2 >= after then v else (v + after) / 2 end as cut,
          sl::double * sl::double / nl::double + (sa - sl)::double * (sa - sl)::double / (na - nl)::double - sa::double * sa::double / na::double as gain
        from w {limits} where after is not null and nl >= least and na - nl >= least),
      b as (select tree, node, arg_max({{'col': col, 'cut': cut}}, {{'gain': gain, 'col': -col, 'v': -v}}) as best from g where gain > 1e-9 group by tree, node)
    select level + 1, tree, id, node || case when x[best.col] <= best.cut then '0' else '1' end,
      rule || case when rule = '' then '' else ' & ' end || f[best.col] || case when x[best.col] <= best.cut then ' <= ' else ' > ' end || printf('%.4f', best.cut), n, s, x, f
    from {name}_steps join b using (tree, node) where level < {depth})),
  {name}_last as (select tree, id, arg_max(node, level) as node, arg_max(rule, level) as rule, any_value(n) as n, any_value(s) as s from {name}_steps group by tree, id),
  {name} as (select tree, id, dense_rank() over (partition by tree order by node) as place, case when rule = '' then 'root' else rule end as rule, n, s from {name}_last)"""
