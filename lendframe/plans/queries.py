"""Registered queries of the operators over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.functions.dist import chi2_ppf, phi_sql
from lendframe.functions.draws import normal, normal_sql, uniform_sql
from lendframe.operators import binning, cluster, glm, metrics, profile, resample, scorecard, selection, trees, validation, woe
from lendframe.plans import benchmark, logit_sql, tree_sql, tuning
from lendframe.plans import scorecard as pipeline
from lendframe.sources import loans
from lendframe.streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PORTFOLIO = """
select o_orderkey as id, cast(o_orderstatus = 'F' as int) as y_a, cast((o_totalprice > 351000) <> (o_orderkey % 7 = 0) as int) as y_b,
       o_orderpriority, nullif(o_orderpriority, '4-NOT SPECIFIED') as priority_na, c_mktsegment, n_name, r_name, o_totalprice, c_acctbal,
       case when o_orderkey % 11 = 0 then null else c_acctbal end as acctbal_na,
       case when o_orderkey % 13 = 0 then cast(-1 as double) else o_totalprice end as price_sc,
       1 / (1 + exp(-(o_totalprice - 250000) / 100000)) as pd
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
"""
WITH = "with portfolio as (" + PORTFOLIO.format(orders="orders", customer="customer", nation="nation", region="region") + ")"
RECURSIVE = WITH.replace("with ", "with recursive ", 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PORTFOLIO, **{t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")})


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return register


def r(name: str, digits: int = 6):
    return F.round(F.col(name).cast("double"), digits).alias(name)


def woe_sql(bin_expr: str, y: str, source: str = "portfolio") -> str:
    """Rows (bin, no, ng, nb, dr, woe, iv_b) of one column."""
    return f"""
select bin, no, ng, nb, nb / no as dr, ln(greatest(ng / sg, 1e-10) / greatest(nb / sb, 1e-10)) as woe,
       (ng / sg - nb / sb) * ln(greatest(ng / sg, 1e-10) / greatest(nb / sb, 1e-10)) as iv_b
from (select *, sum(ng) over () as sg, sum(nb) over () as sb from (
  select {bin_expr} as bin, count({y})::double as no, count(*) filter ({y} = 0)::double as ng, count(*) filter ({y} = 1)::double as nb
  from {source} group by 1))
"""


def out_woe(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "bin", "no", "ng", "nb", r("dr"), r("woe"), r("iv_b"))


SHOW = "bin, no::bigint as no, ng::bigint as ng, nb::bigint as nb, round(dr, 6) as dr, round(woe, 6) as woe, round(iv_b, 6) as iv_b"


@query(f"select 'o_orderpriority' as rf, {SHOW} from ({woe_sql('o_orderpriority', 'y', '(select *, cast(o_orderstatus = ' + chr(39) + 'F' + chr(39) + ' as int) as y from orders)')})")
def woe_iv_orders(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return out_woe(woe.woe_table(rows, ["o_orderpriority"], "y"), "rf")


FACTORS = ["priority_na", "c_mktsegment", "r_name"]


@query(WITH + " union all ".join(f"select '{c}' as rf, {SHOW} from ({woe_sql(c, 'y_b')})" for c in FACTORS))
def woe_multi(spark, sf):
    return out_woe(woe.woe_table(portfolio(spark, sf), FACTORS, "y_b"), "rf")


def auc_bins_sql(c: str, y: str) -> str:
    return f"""(select sum(b * (gb + g / 2)) / (sum(g) * sum(b)) from (select g, b, coalesce(sum(g) over (order by dr rows between unbounded preceding and 1 preceding), 0) as gb
      from (select dr, sum(ng) as g, sum(nb) as b from ({woe_sql(c, y)}) where bin is not null group by dr)))"""


@query(WITH + " union all ".join(f"select '{c}' as rf, {SHOW}, round({auc_bins_sql(c, 'y_b')}, 6) as auc from ({woe_sql(c, 'y_b')})" for c in FACTORS))
def bivariate_orders(spark, sf):
    got, _ = woe.bivariate(portfolio(spark, sf), "y_b", [*FACTORS, "n_name", "o_totalprice"])
    return got.select("rf", "bin", "no", "ng", "nb", r("dr"), r("woe"), r("iv_b"), r("auc"))


@query(WITH + ", w as (" + woe_sql("priority_na", "y_b") + ") select id, round(w.woe, 6) as priority_na, o_totalprice from portfolio p join w on p.priority_na is not distinct from w.bin")
def replace_woe_orders(spark, sf):
    got, _ = woe.replace_woe(portfolio(spark, sf).select("id", "y_b", "priority_na", "o_totalprice"), "y_b", ["priority_na", "o_totalprice"])
    return got.select("id", r("priority_na"), "o_totalprice")


@query(WITH + " select id, case priority_na when '1-URGENT' then 0.5 when '2-HIGH' then -0.2 else 0.1 end::double as priority_na_woe from portfolio")
def encode_woe_map(spark, sf):
    return woe.encode_woe(portfolio(spark, sf), "priority_na", {"1-URGENT": 0.5, "2-HIGH": -0.2, None: 0.1}).select("id", "priority_na_woe")


@query(WITH + """ select slice, count(*) as n from (select case when acctbal_na is null then 'SC' when acctbal_na >= 5000 then '03 [5000,inf)'
  when acctbal_na >= 0 then '02 [0,5000)' else '01 (-inf,0)' end as slice from portfolio) group by 1""")
def num_slice_acctbal(spark, sf):
    s = woe.num_slice(F.col("acctbal_na"), [(-1000, 0), (0, 5000), (5000, 10000)])
    return portfolio(spark, sf).select(s.alias("slice")).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + """ select slice, count(*) as n from (select case when priority_na is null then 'SC' when priority_na in ('1-URGENT', '2-HIGH') then 'high' else 'low' end as slice from portfolio) group by 1""")
def cat_slice_priority(spark, sf):
    got = woe.cat_slice(portfolio(spark, sf), "priority_na", {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "low", "5-LOW": "low"})
    return got.groupBy(F.col("priority_na_slice").alias("slice")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH + """ select sum((priority_na >= '2-HIGH')::int)::bigint as l2, sum((priority_na >= '3-MEDIUM')::int)::bigint as l3, sum((priority_na >= '5-LOW')::int)::bigint as l5, count(*) filter (priority_na is null) as gone from portfolio""")
def partitions_priority(spark, sf):
    got, _ = woe.create_partitions(portfolio(spark, sf), ["priority_na", "n_name"])
    c = "priority_na"
    return got.agg(
        F.sum(f"{c}_2-HIGH").alias("l2"), F.sum(f"{c}_3-MEDIUM").alias("l3"), F.sum(f"{c}_5-LOW").alias("l5"), F.count_if(F.col(f"{c}_2-HIGH").isNull()).alias("gone")
    )


BANDS = "cast(floor(o_totalprice / 100000) as int)"


@query(WITH + ", t as (" + " union all ".join(f"select '{c}' as rf, sum(iv_b) as iv from ({woe_sql(e, 'y_b')})" for c, e in (("band", BANDS), ("c_mktsegment", "c_mktsegment"), ("r_name", "r_name")))
       + "), n as (select count(*) filter (iv >= 0.1) as n from t) select rf, round(iv, 6) as iv from t, n where iv >= case when n < 5 then 0.05 when n > 15 then 0.15 else 0.1 end")
def iv_shortlist(spark, sf):
    rows = portfolio(spark, sf).withColumn("band", F.floor(F.col("o_totalprice") / 100000).cast("string"))
    return woe.shortlist(woe.woe_table(rows, ["band", "c_mktsegment", "r_name"], "y_b")).select("rf", r("iv"))


def uni_sql(c: str, source: str, special: str) -> str:
    q = lambda p: f"quantile_cont({c}::double, {p}) filter (not sc)"
    return f"""select '{c}' as rf, case when sc then 'special cases' else 'complete cases' end as bin_type, count(*) as cnt, round(count(*) / sum(count(*)) over (), 6) as pct,
      count(distinct {c}) as cnt_unique, round(min({c}) filter (not sc), 6)::double as min, {', '.join(f'round({q(p)}, 6) as p{int(p * 100)}' for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))},
      round(avg({c}) filter (not sc), 4) as avg, round(stddev_samp({c}) filter (not sc) / sqrt(count(*)), 6) as avg_se, round(max({c}) filter (not sc), 6)::double as max,
      count(*) filter (not sc and {c} < 0) as neg, count(*) filter (not sc and {c} > 0) as pos,
      case when not sc then count(*) filter ({c} < q.a - 1.5 * (q.b - q.a) or {c} > q.b + 1.5 * (q.b - q.a)) end as cnt_outliers,
      (sum(case when sc then count(*) else 0 end) over () / sum(count(*)) over () > 0.2)::int as sc_ind
      from (select *, ({special}) as sc from {source}), (select quantile_cont({c}::double, 0.25) as a, quantile_cont({c}::double, 0.75) as b from {source} where not ({special})) q group by sc, q.a, q.b"""


UNI = ["cnt_unique", "min", "p1", "p5", "p25", "p50", "p75", "p95", "p99", "avg", "avg_se", "max"]


def out_uni(df: DataFrame) -> DataFrame:
    return df.select("rf", "bin_type", "cnt", r("pct"), "cnt_unique", *[r(c, 4 if c == "avg" else 6) for c in UNI[1:]], "neg", "pos", "cnt_outliers", "sc_ind")


@query(" union all ".join(f"({uni_sql(c, 'lineitem', 'false')})" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def univariate_lineitem(spark, sf):
    return out_uni(profile.univariate(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query(WITH + f"({uni_sql('acctbal_na', 'portfolio', 'acctbal_na is null or acctbal_na = -1')}) union all ({uni_sql('price_sc', 'portfolio', 'price_sc is null or price_sc = -1')})")
def univariate_special_codes(spark, sf):
    return out_uni(profile.univariate(portfolio(spark, sf), ["acctbal_na", "price_sc"], [-1.0]))


@query(WITH + """ select 'priority_na' as rf, case when priority_na is null then 'special cases' else 'complete cases' end as bin_type, count(*) as cnt, count(distinct priority_na) as cnt_unique,
  round(count(*) / sum(count(*)) over (), 6) as pct from portfolio group by priority_na is null""")
def univariate_categorical(spark, sf):
    return profile.univariate_categorical(portfolio(spark, sf), ["priority_na"]).select("rf", "bin_type", "cnt", "cnt_unique", r("pct"))


def nzv_sql(c: str) -> str:
    return f"""select '{c}' as rf, (select count(*) from portfolio where {c} is null)::bigint as sc_num, sum(n)::bigint as cc_num, count(*) as cc_unique,
      max(v) filter (k = 1) as mfq_value, max(v) filter (k = 2) as smfq_value, max(n) filter (k = 1) as mfq, max(n) filter (k = 2) as smfq, round(max(n) filter (k = 1) / max(n) filter (k = 2), 6) as ratio,
      (sum(n) / (select count(*) from portfolio) < 0.1 and max(n) filter (k = 1) / max(n) filter (k = 2) > 19)::int as ind
      from (select *, row_number() over (order by n desc, v) as k from (select {c} as v, count(*) as n from portfolio where {c} is not null group by 1))"""


@query(WITH + " union all ".join(f"({nzv_sql(c)})" for c in FACTORS))
def nzv_orders(spark, sf):
    return profile.nzv(portfolio(spark, sf), FACTORS).select("rf", "sc_num", "cc_num", "cc_unique", "mfq_value", "smfq_value", "mfq", "smfq", r("ratio"), "ind")


@query(WITH + " union all ".join(f"select '{c}' as rf, count(*) filter ({c} is null) as n_missing, round(avg(({c} is null)::int), 6) as pct_missing from portfolio" for c in ("priority_na", "acctbal_na", "price_sc")))
def missing_profile(spark, sf):
    return profile.missing_rates(portfolio(spark, sf), ["priority_na", "acctbal_na", "price_sc"]).select("rf", "n_missing", r("pct_missing"))


@query(WITH + " select id, round(coalesce(acctbal_na, (select quantile_cont(acctbal_na, 0.5) from portfolio)), 6) as acctbal_na from portfolio")
def impute_median(spark, sf):
    return profile.impute(portfolio(spark, sf), ["acctbal_na"], method="median")[0].select("id", r("acctbal_na"))


@query(WITH + " select id, round(case when price_sc = -1 then (select avg(price_sc) from portfolio where price_sc <> -1) else price_sc end, 4) as price_sc from portfolio")
def impute_mean_code(spark, sf):
    return profile.impute(portfolio(spark, sf), ["price_sc"], [-1.0], method="mean")[0].select("id", r("price_sc", 4))


@query(WITH + " select id, coalesce(priority_na, (select priority_na from portfolio where priority_na is not null group by 1 order by count(*) desc, priority_na limit 1)) as priority_na from portfolio")
def impute_mode(spark, sf):
    return profile.impute(portfolio(spark, sf), ["priority_na"])[0].select("id", "priority_na")


def capped_sql(low: str, high: str) -> str:
    return f"""with q as (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b, quantile_cont(l_extendedprice, 0.05) as c, quantile_cont(l_extendedprice, 0.95) as d from lineitem)
      select l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, {low}), {high}), 6) as l_extendedprice from lineitem, q"""


@query(capped_sql("a - 1.5 * (b - a)", "b + 1.5 * (b - a)"))
def winsorise_iqr(spark, sf):
    return profile.winsorise(table(spark, sf, "lineitem"), ["l_extendedprice"])[0].select("l_orderkey", "l_linenumber", r("l_extendedprice"))


@query(capped_sql("c", "d"))
def winsorise_pct(spark, sf):
    return profile.winsorise(table(spark, sf, "lineitem"), ["l_extendedprice"], method="pct")[0].select("l_orderkey", "l_linenumber", r("l_extendedprice"))


COR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(f"select '{a}' as rf1, '{b}' as rf2, round(corr({a}, {b}), 6) as corr from lineitem" for i, a in enumerate(COR) for b in COR[i + 1 :]))
def corr_pairs(spark, sf):
    return profile.correlation_pairs(table(spark, sf, "lineitem"), COR, -1.0).select("rf1", "rf2", r("corr"))


SCORE = WITH + """, s as (select o_totalprice as s, count(*) filter (y_b = 0)::double as g, count(*) filter (y_b = 1)::double as b from portfolio group by 1),
 c as (select *, coalesce(sum(g) over (order by s rows between unbounded preceding and 1 preceding), 0) as gb, coalesce(sum(b) over (order by s rows between unbounded preceding and 1 preceding), 0) as bb, sum(g) over () as tg, sum(b) over () as tb from s)
"""


@query(SCORE + " select round(sum(b * (gb + g / 2)) / max(tg * tb), 6) as auc, round(2 * sum(b * (gb + g / 2)) / max(tg * tb) - 1, 6) as gini, round(greatest(max((tb - bb) / tb - (tg - gb) / tg), 0), 6) as ks from c")
def auc_ks_gini(spark, sf):
    return metrics.auc(portfolio(spark, sf), "o_totalprice", "y_b").select(r("auc"), r("gini"), r("ks"))


@query(WITH + " select round(avg((pd - y_b) * (pd - y_b)), 6) as brier, round(avg(-case when y_b = 1 then ln(pd) else ln(1 - pd) end), 6) as logloss from portfolio")
def brier_logloss(spark, sf):
    return metrics.losses(portfolio(spark, sf), "pd", "y_b").select(r("brier"), r("logloss"))


@query(WITH + """, m as (select count(*) filter (pd <= 0.7 and y_b = 0)::double as tn, count(*) filter (pd > 0.7 and y_b = 0)::double as fp, count(*) filter (pd <= 0.7 and y_b = 1)::double as fn, count(*) filter (pd > 0.7 and y_b = 1)::double as tp from portfolio)
  select unnest(['TN', 'FP', 'FN', 'TP', 'accuracy', 'error_rate', 'sensitivity', 'specificity', 'precision', 'f1_score', 'false_positive', 'false_discovery']) as metric,
  unnest([tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6), round((fp + fn) / (tn + fp + fn + tp), 6), round(tp / (tp + fn), 6), round(tn / (tn + fp), 6), round(tp / (tp + fp), 6), round(2 * tp / (2 * tp + fp + fn), 6), round(fp / (fp + tn), 6), round(fp / (fp + tp), 6)]) as value from m""")
def confusion_cutoff(spark, sf):
    return metrics.confusion(portfolio(spark, sf), "pd", "y_b", 0.7).select("metric", r("value"))


@query(SCORE + " select s as threshold, round((tb - bb) / tb, 6) as tpr, round((tg - gb) / tg, 6) as fpr from c")
def roc_points(spark, sf):
    return metrics.roc_points(portfolio(spark, sf), "o_totalprice", "y_b").select("threshold", r("tpr"), r("fpr"))


def edges_sql(c: str, k: int, source: str = "portfolio", where: str = "true") -> str:
    return f"e as (select quantile_cont({c}, [{', '.join(f'{i}/{k}.0' for i in range(1, k))}]) as e from {source} where {where})"


@query(WITH + ", " + edges_sql("pd", 10) + " select 1 + len(list_filter(e, lambda x: pd > x))::int as bin, count(*) as n, round(avg(pd), 6) as mean_predicted, round(avg(y_b), 6) as observed from portfolio, e group by 1")
def reliability_bins(spark, sf):
    return metrics.reliability(portfolio(spark, sf), "pd", "y_b").select("bin", "n", r("mean_predicted"), r("observed"))


def placements_sql(c: str, n: str) -> str:
    return f"""{n} as (select s, (coalesce(sum(g) over (order by s rows between unbounded preceding and 1 preceding), 0) + g / 2) / sum(g) over () as p1,
      1 - (coalesce(sum(b) over (order by s rows between unbounded preceding and 1 preceding), 0) + b / 2) / sum(b) over () as p0
      from (select {c} as s, count(*) filter (y_b = 0)::double as g, count(*) filter (y_b = 1)::double as b from portfolio group by 1))"""


@query(WITH + ", " + placements_sql("o_totalprice", "pa") + ", " + placements_sql("c_acctbal", "pb") + """, v as (select y_b, case when y_b = 1 then pa.p1 else pa.p0 end as a, case when y_b = 1 then pb.p1 else pb.p0 end as b
  from portfolio join pa on o_totalprice = pa.s join pb on c_acctbal = pb.s), g as (select y_b, count(*) as n, avg(a) as a, avg(b) as b, var_samp(a - b) as d from v group by 1)
  select round(max(a) filter (y_b = 1), 6) as auc_a, round(max(b) filter (y_b = 1), 6) as auc_b, round(max(a - b) filter (y_b = 1) / sqrt(sum(d / n)), 4) as z from g""")
def delong_z(spark, sf):
    got = metrics.delong(portfolio(spark, sf).cache(), "o_totalprice", "c_acctbal", "y_b")
    return spark.createDataFrame([(got["auc_a"], got["auc_b"], got["z"])], "auc_a double, auc_b double, z double").select(r("auc_a"), r("auc_b"), r("z", 4))


@query(WITH + " select id % 10 as fold, round(least(avg(y_b) * 7, 1), 6) as p from portfolio group by 1")
def bonferroni(spark, sf):
    return portfolio(spark, sf).groupBy((F.col("id") % 10).alias("fold")).agg(F.avg(F.col("y_b").cast("double")).alias("p")).select("fold", F.round(metrics.bonferroni(F.col("p"), 7), 6).alias("p"))


@query(WITH + ", f as (select r_name as model, id % 10 as fold, avg(y_b) as auc from portfolio group by 1, 2) select model, round(avg(auc), 6) as auc_mean, round(stddev_samp(auc), 6) as auc_sd from f group by 1")
def fold_metric_summary(spark, sf):
    rows = portfolio(spark, sf).groupBy(F.col("r_name").alias("model"), (F.col("id") % 10).alias("fold")).agg(F.avg(F.col("y_b").cast("double")).alias("auc"))
    return metrics.fold_summary(rows, ["auc"]).select("model", r("auc_mean"), r("auc_sd"))


POINTS = "(600 - 20 / ln(2) * ln(50) + 20 / ln(2) * ln((1 - pd) / pd))"


@query(WITH + f" select id, round({POINTS}, 6) as score, round(pd, 6) as pd from portfolio")
def scaled_score_roundtrip(spark, sf):
    rows = portfolio(spark, sf).withColumn("score", scorecard.scaled_score(F.col("pd")))
    return rows.select("id", r("score"), F.round(scorecard.score_to_prob(F.col("score")), 6).alias("pd"))


@query(WITH + ", " + edges_sql("o_totalprice", 10) + """, d as (select 1 + len(list_filter(e, lambda x: o_totalprice > x))::int as decile, count(*) as n, avg(y_b) as dr from portfolio, e group by 1)
  select decile, n, round(dr, 6) as dr, coalesce(dr > lag(dr) over (order by decile), false)::int as reversal from d""")
def score_deciles(spark, sf):
    return scorecard.deciles(portfolio(spark, sf), "o_totalprice", "y_b").select("decile", "n", r("dr"), "reversal")


GRADED = WITH + ", " + edges_sql("-o_totalprice", 8) + ", graded as (select *, ['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H'][(8 - len(list_filter(e, lambda x: -o_totalprice > x)))::int] as grade from portfolio, e)"


def graded(spark, sf):
    return scorecard.grades(portfolio(spark, sf).withColumn("score", -F.col("o_totalprice")), "score")


@query(GRADED + " select grade as rating, count(*) as no, sum(y_b)::bigint as nb, round(avg(y_b), 6) as dr, round(avg(pd), 6) as pdc from graded group by 1")
def grade_scale(spark, sf):
    return scorecard.rating_scale(graded(spark, sf), "grade", "y_b", "pd").select("rating", "no", "nb", r("dr"), r("pdc"))


@query(GRADED + ", s as (select grade as rating, count(*) as no, avg(y_b) as dr from graded group by 1) select rating, round(dr * 0.3 * sum(no) over () / sum(dr * no) over (), 6) as pd_calib from s")
def calibrate_scaling(spark, sf):
    scale = scorecard.rating_scale(graded(spark, sf), "grade", "y_b", "pd")
    return scorecard.calibrate(scale, 0.3)[0].select("rating", r("pd_calib"))


def logit_scale_sql() -> str:
    """Grades with their log odds; bisection for one parameter, Gauss-Newton steps for two."""
    expit = lambda e: f"(1 / (1 + exp(-({e}))))"
    mean = lambda e: f"(sum(({e}) * no) / sum(no))"
    p = expit("a + b * x")
    return f""", s as (select grade as rating, count(*)::double as no, avg(y_b)::double as dr from graded group by 1), l as (select *, ln(greatest(least(dr, 1 - 1e-10), 1e-10) / (1 - greatest(least(dr, 1 - 1e-10), 1e-10))) as x from s),
  one(it, low, high) as (select 0, -10.0::double, 10.0::double union all select it + 1, case when m < 0.3 then (low + high) / 2 else low end, case when m < 0.3 then high else (low + high) / 2 end
    from (select it, low, high, {mean(expit('(low + high) / 2 + x'))} as m from one, l where it < 60 group by it, low, high)),
  two(it, a, b) as (select 0, 0.0::double, 1.0::double union all select it + 1, a - ((db * db + 0.001) * miss * da - da * db * (miss * db + 0.001 * (b - 1))) / det, b - ((da * da + 1e-12) * (miss * db + 0.001 * (b - 1)) - da * db * miss * da) / det
    from (select *, (da * da + 1e-12) * (db * db + 0.001) - da * db * da * db as det from (
      select it, a, b, {mean(p)} - 0.3 as miss, {mean(p + ' * (1 - ' + p + ')')} as da, {mean(p + ' * (1 - ' + p + ') * x')} as db from two, l where it < 300 group by it, a, b)))
  select 'a' as method, rating, round({expit('low + x')}, 6) as pd_calib from one, l where it = 60 union all select 'ab', rating, round({p}, 6) from two, l where it = 300"""


@query(GRADED.replace("with ", "with recursive ", 1) + logit_scale_sql())
def calibrate_log_odds(spark, sf):
    scale = scorecard.rating_scale(graded(spark, sf), "grade", "y_b", "pd")
    one, _ = scorecard.calibrate(scale, 0.3, method="log_odds_a")
    two, _ = scorecard.calibrate(scale, 0.3, method="log_odds_ab")
    return one.select(F.lit("a").alias("method"), "rating", r("pd_calib")).unionByName(two.select(F.lit("ab").alias("method"), "rating", r("pd_calib")))


@query(GRADED + ", s as (select grade, count(*) as no, avg(pd) as pdc from graded group by 1) select round(sum(least(pdc + 0.01, 1) * no) / sum(no), 6) as stressed_ct from s")
def stress_shift(spark, sf):
    return scorecard.stress(scorecard.rating_scale(graded(spark, sf), "grade", "y_b", "pd"), 0.01, "pdc", "no").select(r("stressed_ct"))


@query("select round(sum(n::double * n) / (sum(n)::double * sum(n)), 6) as hhi from (select count(*) as n from customer group by c_mktsegment)")
def hhi_segment(spark, sf):
    return scorecard.hhi(table(spark, sf, "customer").groupBy("c_mktsegment").count(), "count").select(r("hhi"))


def z_sql(b1: str, n1: str, b2: str, n2: str) -> str:
    pool = f"(({b1} + {b2}) / ({n1} + {n2}))"
    return f"(({b1} / {n1} - {b2} / {n2}) / sqrt({pool} * (1 - {pool}) * (1 / {n1} + 1 / {n2})))"


@query(GRADED + f""", s as (select grade as rating, count(*)::double as no, sum(y_b)::double as nb from graded group by 1), l as (select *, lag(nb) over (order by rating) as b0, lag(no) over (order by rating) as n0 from s),
  z as (select *, {z_sql('nb', 'no', 'b0', 'n0')} as z from l), d as (select corr(ascii(grade), y_b) > 0 as greater from graded)
  select rating, no::bigint as no, nb::bigint as nb, round(nb / no, 6) as dr, round(z, 6) as z, round(case when z is null then null when greater then 1 - ({phi_sql('z')}) else {phi_sql('z')} end, 6) as p_value from z, d""")
def heterogeneity_z(spark, sf):
    return validation.heterogeneity(graded(spark, sf), "y_b", "grade").select("rating", "no", "nb", r("dr"), r("z"), r("p_value"))


@query(GRADED + f""", s as (select grade as rating, c_mktsegment as segment, count(*)::double as no, sum(y_b)::double as nb from graded group by 1, 2),
  l as (select *, sum(no) over (partition by rating) - no as n0, sum(nb) over (partition by rating) - nb as b0 from s), z as (select *, case when no >= 30 and n0 >= 30 and nb + b0 > 0 and nb + b0 < no + n0 then {z_sql('nb', 'no', 'b0', 'n0')} end as z from l)
  select rating, segment, no::bigint as no, nb::bigint as nb, round(z, 6) as z, round(2 * (1 - ({phi_sql('abs(z)')})), 6) as p_value from z""")
def homogeneity_z(spark, sf):
    return validation.homogeneity(graded(spark, sf), "y_b", "grade", "c_mktsegment").select("rating", "segment", "no", "nb", r("z"), r("p_value"))


@query(GRADED + """, b as (select min(c_acctbal) as low, (max(c_acctbal) - min(c_acctbal)) / 4 as w from graded)
  select grade as rating, greatest(least(ceil((c_acctbal - low) / w), 4), 1)::int::varchar as segment, count(*) as no, sum(y_b)::bigint as nb from graded, b group by 1, 2""")
def homogeneity_numeric(spark, sf):
    return validation.homogeneity(graded(spark, sf), "y_b", "grade", "c_acctbal", numeric=True).select("rating", "segment", "no", "nb")


@query(GRADED + """, s as (select grade as rating, count(*) as no, sum(y_b)::bigint as nb, avg(pd) as pdc from graded group by 1), t as (select sum((nb - no * pdc) * (nb - no * pdc) / (no * pdc * (1 - pdc))) as hl from s)
  select rating, no, nb, round(pdc, 6) as pdc, round((nb / no - pdc) / sqrt(pdc * (1 - pdc) / no), 5) as z, round(hl, 4) as hl from s, t""")
def pp_zscore_hl(spark, sf):
    scale = scorecard.rating_scale(graded(spark, sf), "grade", "y_b", "pd")
    return validation.predictive_power(scale).select("rating", "no", "nb", r("pdc"), r("z", 5), r("hl", 4))


SCALE_PD = ", scale as (select grade as rating, count(*)::double as no, sum(y_b)::double as nb, avg(pd)::double as pdc from graded group by 1)"


def binomial_sql(k: str, n: str, p: str) -> str:
    return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


def beta_sql(x: str, a: str, b: str, terms: str) -> str:
    """The incomplete beta function by its series of positive terms; ``terms``: a list of 0, 1, ..."""
    before = f"{a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - lgamma({a}) - lgamma({b})"
    return f"list_sum(list_transform({terms}, lambda i: exp({before} + lgamma({a} + {b} + i) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({x}))))"


def chi2_sf_sql(x: str, df: str) -> str:
    """For even degrees of freedom: a finite sum."""
    return f"list_sum(list_transform(range(({df} / 2)::bigint), lambda i: exp(-{x} / 2 + i * ln({x} / 2) - lgamma(i + 1))))"


@query(GRADED + SCALE_PD + f""", tail as (select rating, sum({binomial_sql('k', 'no', 'pdc')}) as binomial_p from (select *, unnest(range(nb::bigint, no::bigint + 1))::double as k from scale) group by 1),
  hl as (select sum((nb - no * pdc) * (nb - no * pdc) / (no * pdc * (1 - pdc))) as hl, count(*) as df from scale), z as (select *, (nb / no - pdc) / sqrt(pdc * (1 - pdc) / no) as z from scale)
  select z.rating, round(binomial_p, 6) as binomial_p, round({beta_sql('pdc', '(nb + 0.5)', '(no - nb + 0.5)', 'range(20000)')}, 6) as jeffreys_p, round(1 - ({phi_sql('z')}), 6) as zscore_p, round({chi2_sf_sql('hl', 'df')}, 6) as hl_p
  from z join tail using (rating), hl""")
def pp_binomial_jeffreys(spark, sf):
    scale = scorecard.rating_scale(graded(spark, sf), "grade", "y_b", "pd")
    return validation.predictive_power(scale).select("rating", r("binomial_p"), r("jeffreys_p"), r("zscore_p"), r("hl_p"))


@query(GRADED + f""", scale as (select grade as rating, count(*)::double as no, sum(y_a)::double as nb, avg(y_a)::double - 0.01 as pdc from graded group by 1),
  chance as (select *, unnest(range(no::bigint + 1))::double as k from scale), mass as (select *, {binomial_sql('k', 'no', '(nb / no)')} as mass, {binomial_sql('k', 'no', 'pdc')} as null_mass from chance),
  tail as (select *, sum(null_mass) over (partition by rating order by k desc) as binomial_p from mass),
  tried as (select *, (k / no - pdc) / sqrt(pdc * (1 - pdc) / no) as z from tail where mass > 1e-12),
  tests as (select *, 1 - ({phi_sql('z')}) as zscore_p, {beta_sql('pdc', '(k + 0.5)', '(no - k + 0.5)', 'range(6000)')} as jeffreys_p from tried)
  select rating, unnest(['binomial', 'jeffreys', 'zscore']) as test, round(unnest([sum(mass) filter (binomial_p < 0.05), sum(mass) filter (jeffreys_p < 0.05), sum(mass) filter (zscore_p < 0.05)]), 6) as power from tests group by rating""")
def power_exact_tests(spark, sf):
    scale = scorecard.rating_scale(graded(spark, sf), "grade", "y_a", "pd").withColumn("pdc", F.col("dr") - 0.01)
    return validation.power(scale).select("rating", "test", r("power"))


_LIMITS = ", ".join(f"{chi2_ppf(0.95, k)}::double" for k in range(1, 13))
HL_SQL = """, hl_terms as (select rating, k, mass, (k - no * pdc) ** 2 / (no * pdc * (1 - pdc)) as term from mass where mass > 1e-15),
  hl_step as (select ([""" + _LIMITS + """])[count(*)] / 4096 as step, count(*) as grades from scale),
  hl_cells as (select kind, dense_rank() over (order by rating) as num, case kind when 'low' then floor(term / step) else ceil(term / step) end::bigint as cell, sum(mass) as p
    from hl_terms, hl_step, (values ('low'), ('high')) v(kind) where term / step <= 4097 group by kind, rating, cell),
  hl(kind, num, cell, p) as (select kind, 0::bigint, 0::bigint, 1.0::double from (values ('low'), ('high')) v(kind)
    union all select h.kind, h.num + 1, h.cell + c.cell, sum(h.p * c.p) from hl h join hl_cells c on c.kind = h.kind and c.num = h.num + 1 where h.cell + c.cell <= 4096 group by 1, 2, 3),
  hl_power as (select avg(power) as power from (select kind, 1 - sum(p) as power from hl, hl_step where num = grades group by kind))"""


@query(
    ORACLE_SQL["power_exact_tests"].replace("with ", "with recursive ", 1).replace("\n  select rating, unnest(", HL_SQL + "\n  select rating, unnest(", 1)
    + " union all select null, 'hosmer_lemeshow', round(power, 6) from hl_power"
)
def power_of_tests(spark, sf):
    scale = scorecard.rating_scale(graded(spark, sf), "grade", "y_a", "pd").withColumn("pdc", F.col("dr") - 0.01)
    whole = [(None, "hosmer_lemeshow", validation.power_hl(scale))]
    tests = validation.power(scale).unionByName(spark.createDataFrame(whole, "rating string, test string, power double"))
    return tests.select("rating", "test", r("power"))


@query(WITH + f""", d as (select id % 12 as period, avg(y_b) - avg(pd) as d from portfolio group by 1), t as (select count(*) as n, sum(d) as s, var_samp(d) as se from d), z as (select *, s / sqrt(n * se) as z from t)
  select n, round(s, 6) as estimate, round(se, 8) as se, round(z, 5) as z, round(1 - ({phi_sql('z')}), 6) as p_value from z""")
def normal_test(spark, sf):
    rows = portfolio(spark, sf).groupBy((F.col("id") % 12).alias("period")).agg(F.avg(F.col("y_b").cast("double")).alias("odr"), F.avg("pd").alias("pdc"))
    return validation.normal_test(rows, "pdc", "odr").select("n", r("estimate"), r("se", 8), r("z", 5), r("p_value"))


@query(SCORE + """, a as (select sum(b * (gb + g / 2)) / max(tg * tb) as auc, max(tg) as n0, max(tb) as n1 from c)
  select round(auc, 6) as auc, round((auc - 0.7) / sqrt((auc * (1 - auc) + (n1 - 1) * (auc / (2 - auc) - auc * auc) + (n0 - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n0 * n1)), 4) as z from a""")
def dp_hanley(spark, sf):
    rows = portfolio(spark, sf).cache()
    area = metrics.auc(rows, "o_totalprice", "y_b").first().auc
    n = rows.agg(F.count_if(F.col("y_b") == 0), F.count_if(F.col("y_b") == 1)).first()
    got = validation.dp_testing(area, n[0], n[1], 0.7)
    return spark.createDataFrame([(got["auc"], got["z"])], "auc double, z double").select(r("auc"), r("z", 4))


def psi_sql(bin_base: str, bin_target: str, prefix: str, kind: str) -> str:
    return f"""{prefix} b as (select {bin_base} as bin, count(*) as base_no from base group by 1), t as (select {bin_target} as bin, count(*) as target_no from target group by 1),
      j as (select coalesce(b.bin, t.bin) as bin, coalesce(base_no, 0) as base_no, coalesce(target_no, 0) as target_no from b {kind} join t on b.bin = t.bin),
      s as (select *, base_no / sum(base_no) over () as p, target_no / sum(target_no) over () as q from j)
      select bin, base_no, target_no, round((q - p) * ln(greatest(q, 1e-10) / greatest(p, 1e-10)), 8) as psi from s"""


HALVES = "with base as (select * from orders where o_orderkey % 2 = 0), target as (select * from orders where o_orderkey % 2 = 1), "


def halves(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")


PSI_BIN = "(1 + len(list_filter((select e from e), lambda x: o_totalprice >= x)))::varchar"


@query(psi_sql(PSI_BIN, PSI_BIN, HALVES + edges_sql("o_totalprice", 10, "base") + ",", "left"))
def psi_numeric(spark, sf):
    return validation.psi(*halves(spark, sf), "o_totalprice").select("bin", "base_no", "target_no", r("psi", 8))


@query(psi_sql("o_orderpriority", "o_orderpriority", HALVES, "full"))
def psi_categorical(spark, sf):
    return validation.psi(*halves(spark, sf), "o_orderpriority", numeric=False).select("bin", "base_no", "target_no", r("psi", 8))


FEW = "(dense_rank() over (order by v))::varchar"


@query("""with base as (select l_tax as v, count(*) as base_no from lineitem where l_orderkey % 2 = 0 group by 1), target as (select l_tax as v, count(*) as target_no from lineitem where l_orderkey % 2 = 1 group by 1),
  s as (select (row_number() over (order by base.v))::varchar as bin, base_no, coalesce(target_no, 0) as target_no from base left join target on base.v = target.v), p as (select *, base_no / sum(base_no) over () as p, target_no / sum(target_no) over () as q from s)
  select bin, base_no, target_no, round((q - p) * ln(greatest(q, 1e-10) / greatest(p, 1e-10)), 8) as psi from p""")
def psi_few_values(spark, sf):
    rows = table(spark, sf, "lineitem")
    return validation.psi(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), "l_tax").select("bin", "base_no", "target_no", r("psi", 8))


def chi_sql(outcome: str, sensitive: str, stratum: str = "0") -> str:
    return f"""c as (select {stratum} as k, {outcome} as o, {sensitive} as s, count(*)::double as n from portfolio group by 1, 2, 3),
      f as (select *, sum(n) over (partition by k, o) * sum(n) over (partition by k, s) / sum(n) over (partition by k) as e from c),
      d as (select k, (count(distinct o) - 1) * (count(distinct s) - 1) as df, max(0) as z from c group by k),
      x as (select f.k, sum((case when df = 1 then greatest(abs(n - e) - 0.5, 0) else abs(n - e) end) ** 2 / e) + max(0) + sum(n) - sum(e) as chi2, max(df) as df from f join d on f.k = d.k group by f.k)
      select round(sum(chi2), 5) as chi2, sum(df)::bigint as df from x"""


@query(WITH + ", " + chi_sql("cast(o_totalprice > 300000 as int)", "c_mktsegment"))
def fairness_parity(spark, sf):
    rows = portfolio(spark, sf).withColumn("out", (F.col("o_totalprice") > 300000).cast("int"))
    return validation.fairness_discrete(rows, "c_mktsegment", "out").select(r("chi2", 5), "df")


@query(WITH + ", " + chi_sql("cast(o_totalprice > 300000 as int)", "c_acctbal < 0"))
def fairness_two_by_two(spark, sf):
    rows = portfolio(spark, sf).withColumns({"out": (F.col("o_totalprice") > 300000).cast("int"), "poor": F.col("c_acctbal") < 0})
    return validation.fairness_discrete(rows, "poor", "out").select(r("chi2", 5), "df")


@query(WITH + ", " + chi_sql("cast(o_totalprice > 300000 as int)", "c_mktsegment", "r_name"))
def fairness_conditional(spark, sf):
    rows = portfolio(spark, sf).withColumn("out", (F.col("o_totalprice") > 300000).cast("int"))
    return validation.fairness_discrete(rows, "c_mktsegment", "out", "r_name").select(r("chi2", 5), "df")


@query(WITH + """, g as (select c_mktsegment, count(*) as n, avg(o_totalprice) as m, var_pop(o_totalprice) * count(*) as w from portfolio group by 1), t as (select avg(o_totalprice) as gm from portfolio)
  select count(*) - 1 as df1, (sum(n) - count(*))::bigint as df2, round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 5) as f from g, t""")
def fairness_anova(spark, sf):
    return validation.fairness_continuous(portfolio(spark, sf), "c_mktsegment", "o_totalprice").select("df1", "df2", r("f", 5))


def parity_sql(name: str, source: str, stratum: str = "0") -> str:
    """One row (chi2, df) of the chi-squared of out by segment, summed over strata."""
    return f"""{name} as (with c as (select {stratum} as k, o_totalprice > 300000 as o, c_mktsegment as s, count(*)::double as n from {source} group by 1, 2, 3),
    f as (select *, sum(n) over (partition by k, o) * sum(n) over (partition by k, s) / sum(n) over (partition by k) as e from c),
    x as (select k, sum((n - e) * (n - e) / e) + sum(n) - sum(e) as chi2, (count(distinct o) - 1) * (count(distinct s) - 1) as df from f group by k) select sum(chi2) as chi2, sum(df) as df from x)"""


@query(WITH + f""", {parity_sql('p1', 'portfolio')}, {parity_sql('p2', 'portfolio', 'r_name')}, {parity_sql('p3', '(select * from portfolio where y_b = 1)')},
  t as (select 'statistical parity' as test, * from p1 union all select 'conditional parity', * from p2 union all select 'equal opportunity', * from p3)
  select test, round(chi2, 5) as statistic, round({chi2_sf_sql('chi2', 'df')}, 6) as p_value from t""")
def fairness_all(spark, sf):
    rows = portfolio(spark, sf).withColumn("out", (F.col("o_totalprice") > 300000).cast("int"))
    return validation.fairness_vld(rows, "c_mktsegment", "y_b", "out", "r_name").select("test", r("statistic", 5), r("p_value"))


@query(SCORE.split(", s as")[0] + """, s as (select id % 2 as half, o_totalprice as s, count(*) filter (y_b = 0)::double as g, count(*) filter (y_b = 1)::double as b from portfolio group by 1, 2),
  c as (select *, coalesce(sum(g) over (partition by half order by s rows between unbounded preceding and 1 preceding), 0) as gb from s) select half, round(sum(b * (gb + g / 2)) / (sum(g) * sum(b)), 6) as auc from c group by 1""")
def half_split_auc(spark, sf):
    return validation.half_split_auc(portfolio(spark, sf), "o_totalprice", "y_b", F.col("id") % 2).select("half", r("auc"))


@query("""with v as (select sum(l_quantity * l_quantity) as a, sum(l_quantity * l_extendedprice) as b, sum(l_extendedprice * l_extendedprice) as c from lineitem)
  select 'l_quantity' as rf, round(a * c / (a * c - b * b), 6) as vif from v union all select 'l_extendedprice', round(a * c / (a * c - b * b), 6) from v""")
def vif_two(spark, sf):
    got = validation.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame(list(got.items()), "rf string, vif double").select("rf", r("vif"))


@query(WITH + " select id, round(1.02 / (1 - pd * 0.45) - 1 - 0.02, 8) as spread from portfolio")
def evrs_spread(spark, sf):
    return portfolio(spark, sf).select("id", F.round(validation.spread(F.col("pd")), 8).alias("spread"))


EVRS_ODDS = f"ln(p / (1 - p)) + 0.5 * {normal_sql('991', 'id', 'sim', 'model')}"


@query(WITH + f""", d as (select id, y_b, sim, model, case when model = 'estimated' then pd else 0.3 end as p from portfolio, range(1, 501) s(sim), (values ('estimated'), ('benchmark')) m(model)),
  s as (select *, 1.02 / (1 - least(0.45 / (1 + exp(-({EVRS_ODDS}))), 0.999)) - 1.02 as own, 1.02 / (1 - 0.45 * 0.3) - 1.02 as fair from d),
  g as (select sim, model, avg(case when y_b = 1 then -0.45 else own end) filter (1 - exp(-5 * greatest(own - fair, 0)) < 0.5) as gain from s group by 1, 2)
  select sim::int as sim, model, round(coalesce(gain, 0), 6) as portfolio_return from g""")
def evrs_returns(spark, sf):
    rows = portfolio(spark, sf).withColumn("pd_bm", F.lit(0.3))
    return validation.evrs(rows, "y_b", "pd", "pd_bm", "id", sims=500).select("sim", "model", r("portfolio_return"))


ORDER_KEY = "((id + 2191) * 2654435761 % 4294967296)"


@query(WITH + f" select fold, y_b, count(*) as n from (select y_b, floor((row_number() over (partition by y_b order by {ORDER_KEY}, id) - 1) * 10 / count(*) over (partition by y_b))::int as fold from portfolio) group by 1, 2")
def stratified_folds(spark, sf):
    return resample.folds(portfolio(spark, sf), "id", "y_b").groupBy("fold", "y_b").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + " union all ".join(f"select {f} as fold, 'o_totalprice' as rf, round(quantile_cont(o_totalprice, 0.75) + 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)), 6) as upper_cap from portfolio where id % 5 <> {f}" for f in range(5)))
def fold_safe_caps(spark, sf):
    rows = portfolio(spark, sf).withColumn("fold", (F.col("id") % 5).cast("int"))
    return profile.fold_safe_caps(rows, "fold", ["o_totalprice"], list(range(5))).select("fold", "rf", r("upper_cap"))


SMALL = "(select * from supplier where s_nationkey < 5)"


@query(f"""with m as {SMALL}, s as (select max(s_acctbal) - min(s_acctbal) as span from m), p as (select a.s_suppkey as id, b.s_suppkey as neighbour, sqrt(((a.s_acctbal - b.s_acctbal) / span) ** 2 + (a.s_nationkey <> b.s_nationkey)::int) as distance
  from m a, m b, s where a.s_suppkey <> b.s_suppkey), k as (select *, row_number() over (partition by id order by distance, neighbour) as rank from p) select id, neighbour, round(distance, 6) as distance, rank::int as rank from k where rank <= 5""")
def smote_knn(spark, sf):
    rows = table(spark, sf, "supplier").where("s_nationkey < 5")
    return resample.heom_neighbours(rows, "s_suppkey", ["s_acctbal"], ["s_nationkey"]).select("id", "neighbour", r("distance"), "rank")


def smote_sql(osr: float) -> str:
    draw = lambda what: uniform_sql("81000", "id", "c", f"'{what}'")
    return f"""with m as {SMALL}, s as (select max(s_acctbal) - min(s_acctbal) as span from supplier), p as (select a.s_suppkey as id, b.s_suppkey as neighbour, sqrt(((a.s_acctbal - b.s_acctbal) / span) ** 2 + (a.s_nationkey <> b.s_nationkey)::int) as distance
  from m a, m b, s where a.s_suppkey <> b.s_suppkey), k as (select *, row_number() over (partition by id order by distance, neighbour) as rank from p), near as (select * from k where rank <= 5), held as (select id, max(rank) as held from near group by id),
  n as (select count(*) as n, round_even(count(*) * {osr}::double, 0)::bigint as total from m), placed as (select s_suppkey as id, row_number() over (order by (s_suppkey + 81000) * 2654435761 % 4294967296, s_suppkey) - 1 as place from m),
  copied as (select id, unnest(range(1, 1 + total // n + (place < total % n)::int)) as c from placed, n), drawn as (select id, c, 1 + floor({draw('neighbour')} * held)::bigint as rank, {draw('factor')} as factor from copied join held using (id)),
  made as (select b.s_nationkey, a.s_acctbal + factor * (b.s_acctbal - a.s_acctbal) as s_acctbal from drawn join near using (id, rank) join m a on a.s_suppkey = id join m b on b.s_suppkey = neighbour)
  select s_suppkey, s_nationkey, round(s_acctbal::double, 6) as s_acctbal, (s_nationkey < 5)::int as y, 0 as smote from supplier union all select null, s_nationkey, round(s_acctbal::double, 6), 1, 1 from made"""


def _smote(spark, sf, osr: float) -> DataFrame:
    rows = table(spark, sf, "supplier").withColumn("y", (F.col("s_nationkey") < 5).cast("int"))
    return resample.smote(rows, "y", 1, osr, "s_suppkey", ["s_acctbal"], ["s_nationkey"]).select("s_suppkey", "s_nationkey", r("s_acctbal"), "y", "smote")


@query(smote_sql(1.0))
def smote_rows(spark, sf):
    return _smote(spark, sf, 1.0)


@query(smote_sql(0.2))
def smote_a_fifth(spark, sf):
    return _smote(spark, sf, 0.2)


@query(smote_sql(2.5))
def smote_two_and_a_half(spark, sf):
    return _smote(spark, sf, 2.5)


@query(WITH + """, l as (select priority_na as v, count(*) filter (y_b = 0)::double as g, count(*) filter (y_b = 1)::double as b from portfolio group by 1), t as (select sum(g) as tg, sum(b) as tb from l),
  o as (select *, row_number() over (order by v) as i from l where v is not null),
  p as (select a.i, (a.g / tg - a.b / tb) * ln((a.g / tg) / (a.b / tb)) + (c.g / tg - c.b / tb) * ln((c.g / tg) / (c.b / tb)) - ((a.g + c.g) / tg - (a.b + c.b) / tb) * ln(((a.g + c.g) / tg) / ((a.b + c.b) / tb)) as loss
    from o a join o c on c.i = a.i + 1, t), m as (select arg_min(i, (loss, i)) as place from p),
  k as (select case when i > place then i - 1 else i end as k, v, g, b from o, m), grouped as (select printf('%02d', k) || ' [' || string_agg(v, ',' order by v) || ']' as bin, sum(g) as g, sum(b) as b from k group by k union all select 'SC', g, b from l where v is null)
  select bin, (g + b)::bigint as no, g::bigint as ng, b::bigint as nb, round(b / (g + b), 6) as dr, round(ln((g / tg) / (b / tb)), 6) as woe from grouped, t""")
def cat_bin_summary(spark, sf):
    return binning.cat_bin(portfolio(spark, sf), "priority_na", "y_b", max_groups=3)[0].select("bin", "no", "ng", "nb", r("dr"), r("woe"))


@query(WITH.replace("with ", "with recursive ", 1) + ", " + edges_sql("price_sc", 20, where="price_sc <> -1") + """, k as (select case when price_sc = -1 then null else 1 + len(list_filter(e, lambda x: price_sc > x)) end as k, y_b from portfolio, e),
  c as (select k, count(*) filter (y_b = 0)::double as g, count(*) filter (y_b = 1)::double as b from k group by 1), t as (select sum(g) as tg, sum(b) as tb, sum(g + b) filter (k is not null) as n, max(k) as m from c),
  u as (select k, sum(g) over (order by k) as cg, sum(b) over (order by k) as cb from c where k is not null union all select 0, 0, 0),
  part as (select a.k as i, z.k as j, z.cg - a.cg as g, z.cb - a.cb as b, (z.cb - a.cb) / (z.cg - a.cg + z.cb - a.cb) as rate, ((z.cg - a.cg) / tg - (z.cb - a.cb) / tb) * ln(((z.cg - a.cg) / tg) / ((z.cb - a.cb) / tb)) as gain
    from u a join u z on z.k > a.k, t where z.cg - a.cg + z.cb - a.cb >= 0.05 * n),
  way(sign, j, rate, total, path) as (select sign, j, rate, gain, [j] from part, (values (1), (-1)) s(sign) where i = 0 union all
    select sign, p.j, p.rate, total + gain, list_append(path, p.j) from way join part p on p.i = way.j where (p.rate - way.rate) * sign > 0 and len(path) < 10),
  best as (select arg_max(path, (total, -len(path))) as path from way, t where j = m), cut as (select unnest(path) as j, unnest([0] || path[: len(path) - 1]) as i from best),
  named as (select '(' || case when i = 0 then '-inf' else printf('%.2f', e[i]) end || ', ' || case when j = m then 'inf)' else printf('%.2f', e[j]) || ']' end as bin, g, b from cut join part using (i, j), e, t union all select 'Special', g, b from c where k is null)
  select bin, (g + b)::bigint as no, g::bigint as ng, b::bigint as nb, round(b / (g + b), 6) as dr, round(ln((g / tg) / (b / tb)), 6) as woe from named, t""")
def optimal_bin_summary(spark, sf):
    return binning.optimal_bins(portfolio(spark, sf), "price_sc", "y_b", [-1.0]).select("bin", "no", "ng", "nb", r("dr"), r("woe"))


@query(RECURSIVE + """, l as (select n_name as v, count(*) filter (y_b = 0)::double as g, count(*) filter (y_b = 1)::double as b from portfolio where n_name <> 'NATION_7' group by 1), t as (select count(*) filter (y_b = 0)::double as tg, count(*) filter (y_b = 1)::double as tb from portfolio),
  o as (select *, row_number() over (order by b / (g + b), v) as k from l), u as (select k, sum(g) over (order by k) as cg, sum(b) over (order by k) as cb, count(*) over () as m, sum(g + b) over () as n from o union all select 0, 0, 0, count(*), sum(g + b) from o),
  part as (select a.k as i, z.k as j, z.cg - a.cg as g, z.cb - a.cb as b from u a join u z on z.k > a.k where z.cg > a.cg and z.cb > a.cb and z.cg - a.cg + z.cb - a.cb >= 0.05::double * z.n),
  way(j, total, path) as (select j, (g / tg - b / tb) * ln((g / tg) / (b / tb)), [j] from part, t where i = 0 union all
    (with step as (select p.j, way.total + (g / tg - b / tb) * ln((g / tg) / (b / tb)) as total, list_append(path, p.j) as path from way join part p on p.i = way.j, t where len(path) < 10) select j, max(total), arg_max(path, total) from step group by j)),
  best as (select arg_max(path, (round(total, 12), -len(path))) as path from way where j = (select max(m) from u)), cut as (select unnest(path) as j, unnest([0] || path[: len(path) - 1]) as i, unnest(range(1, len(path) + 1)) as place from best),
  named as (select printf('%02d', place) || ' [' || string_agg(v, ',' order by v) || ']' as bin, sum(g) as g, sum(b) as b from cut join o on k > i and k <= j group by place
    union all select 'Special', count(*) filter (y_b = 0)::double, count(*) filter (y_b = 1)::double from portfolio where n_name = 'NATION_7' having count(*) > 0)
  select bin, (g + b)::bigint as no, g::bigint as ng, b::bigint as nb, round(b / (g + b), 6) as dr, round(ln((g / tg) / (b / tb)), 6) as woe from named, t""")
def optimal_level_summary(spark, sf):
    """Nations in at most ten bins of largest IV; one is a special code."""
    return binning.optimal_levels(portfolio(spark, sf), "n_name", "y_b", ["NATION_7"])[0].select("bin", "no", "ng", "nb", r("dr"), r("woe"))


@query(RECURSIVE + ", " + edges_sql("pd", 20) + """, k as (select 1 + len(list_filter(e, lambda x: pd > x)) as k, ((c_acctbal > 5000) <> (o_totalprice between 150000 and 300000 and id % 3 > 0))::int as y from portfolio, e),
  c as (select k, count(*) filter (y = 0)::double as g, count(*) filter (y = 1)::double as b from k group by 1), t as (select sum(g) as tg, sum(b) as tb, sum(g + b) as n, max(k) as m from c),
  u as (select k, sum(g) over (order by k) as cg, sum(b) over (order by k) as cb from c union all select 0, 0, 0),
  part as (select a.k as i, z.k as j, z.cg - a.cg as g, z.cb - a.cb as b, (z.cb - a.cb) / (z.cg - a.cg + z.cb - a.cb) as rate, ((z.cg - a.cg) / tg - (z.cb - a.cb) / tb) * ln(((z.cg - a.cg) / tg) / ((z.cb - a.cb) / tb)) as gain
    from u a join u z on z.k > a.k, t where z.cg - a.cg + z.cb - a.cb >= 0.05::double * n),
  way(turn, turned, i, j, rate, total, path) as (select turn, 0, i, j, rate, gain, [j] from part, (values (1), (-1)) s(turn) where i = 0 union all
    (with step as (select turn, s.turned, p.i, p.j, p.rate, way.total + gain as total, list_append(path, p.j) as path from way join part p on p.i = way.j, (values (0), (1)) s(turned)
      where s.turned >= way.turned and (p.rate - way.rate) * turn * (1 - 2 * s.turned) > 0 and len(path) < 10)
    select turn, turned, i, j, any_value(rate), max(total), arg_max(path, total) from step group by turn, turned, i, j)),
  best as (select arg_max(path, (round(total, 12), -len(path))) as path from way, t where j = m), cut as (select unnest(path) as j, unnest([0] || path[: len(path) - 1]) as i from best),
  named as (select '(' || case when i = 0 then '-inf' else printf('%.2f', e[i]) end || ', ' || case when j = m then 'inf)' else printf('%.2f', e[j]) || ']' end as bin, g, b from cut join part using (i, j), e, t)
  select bin, (g + b)::bigint as no, g::bigint as ng, b::bigint as nb, round(b / (g + b), 6) as dr, round(ln((g / tg) / (b / tb)), 6) as woe from named, t""")
def optimal_bins_of_any_trend(spark, sf):
    rows = portfolio(spark, sf).withColumn("y", ((F.col("c_acctbal") > 5000) != (F.col("o_totalprice").between(150000, 300000) & (F.col("id") % 3 > 0))).cast("int"))
    return binning.optimal_bins(rows, "pd", "y", trend="auto").select("bin", "no", "ng", "nb", r("dr"), r("woe"))


@query(WITH + " select r_name, dense_rank() over (order by r_name)::int as code, count(*) as n from portfolio group by 1")
def ord_to_int(spark, sf):
    return binning.ord_to_int(portfolio(spark, sf), "r_name", "code").groupBy("r_name", "code").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + ", p as (select avg(y_b) as p from portfolio)" + " union all ".join(
    f"select '{c}' as rf, round(sum((ng / sg - nb / sb) * ln(greatest(ng / sg, 1e-10) / greatest(nb / sb, 1e-10))), 6) as miv, round(sum(case when ng > 0 then 2 * ng * ln(ng / (no * (1 - p))) else 0 end + case when nb > 0 then 2 * nb * ln(nb / (no * p)) else 0 end), 4) as g_stat, count(*) - 1 as df from (select *, sum(ng) over () as sg, sum(nb) over () as sb from ({woe_sql(c, 'y_b')})), p" for c in FACTORS))
def miv_first_iteration(spark, sf):
    rows = portfolio(spark, sf)
    rate = rows.agg(F.avg(F.col("y_b").cast("double"))).first()[0]
    return selection.miv_table(rows.withColumn("p", F.lit(rate)), "y_b", FACTORS, "p").select("rf", r("miv"), r("g_stat", 4), "df")


CODED = ["band", "seventh", *FACTORS]


def coded(spark, sf) -> tuple[DataFrame, list[str]]:
    """The portfolio with five WoE-coded factors, two of them with signal."""
    return woe.replace_woe(factored(spark, sf), "y_b", CODED)[0].cache(), CODED


def factored(spark, sf) -> DataFrame:
    rows = portfolio(spark, sf).withColumns({"band": F.floor(F.col("o_totalprice") / 100000).cast("string"), "seventh": (F.col("id") % 7).cast("string")})
    return rows.select("id", "y_b", *CODED)


CODED_SQL = (
    WITH.replace("with ", "with recursive ", 1) + ", factored as (select *, floor(o_totalprice / 100000)::bigint::varchar as band, (id % 7)::varchar as seventh from portfolio), "
    + ", ".join(f"w_{c} as ({woe_sql(c, 'y_b', 'factored')})" for c in CODED)
    + ", coded as (select id, y_b, " + ", ".join(f"w_{c}.woe as {c}, f.{c} as of_{c}" for c in CODED) + " from factored f " + " ".join(f"join w_{c} on f.{c} is not distinct from w_{c}.bin" for c in CODED) + ")"
)
SUBSETS = CODED_SQL + ", " + logit_sql.subset_cells("cell", "coded", CODED, "y_b") + ", " + logit_sql.newton("fit", "cell", 6)


def steps_sql(**how) -> str:
    return SUBSETS + ", " + logit_sql.forward("fwd", "fit", CODED, **how) + " select step, rf, round(coefficient, 4) as coefficient, round(p_value, 5) as p_value, round(aic, 3) as aic from fwd"


def miv_steps_sql() -> str:
    """MIV and G of each candidate for the model of each subset, then the greedy steps over subsets."""
    p = "1 / (1 + exp(-(b[1] + " + " + ".join(f"b[{i + 2}] * {c}" for i, c in enumerate(CODED)) + ")))"
    cells = " union all ".join(
        f"select g, {i} as i, '{c}' as rf, of_{c} as bin, sum(w) filter (y_b = 0) as og, sum(w) filter (y_b = 1) as ob, sum(w * (1 - p)) as eg, sum(w * p) as eb from prob group by g, of_{c}" for i, c in enumerate(CODED)
    )
    woe_ = lambda g, b: f"ln(greatest({g}, 1e-10) / greatest({b}, 1e-10))"
    return SUBSETS + f""", small as (select {', '.join(f'{c}, of_{c}' for c in CODED)}, y_b, count(*)::double as w from coded group by all), prob as (select f.g, small.*, {p} as p from fit f, small), bins as ({cells}),
  shares as (select *, coalesce(og, 0) / sum(og) over s as dg, coalesce(ob, 0) / sum(ob) over s as db, eg / sum(eg) over s as xg, eb / sum(eb) over s as xb from bins window s as (partition by g, i)),
  scored as (select g, i, rf, sum((dg - db) * ({woe_('dg', 'db')} - {woe_('xg', 'xb')})) as miv, sum(coalesce(2 * og * ln(og / eg), 0) + coalesce(2 * ob * ln(ob / eb), 0)) as g_stat, count(*) - 1 as df from shares group by 1, 2, 3),
  steps(step, mask, rf, miv, g_stat, df) as (select 0, 0, null::varchar, null::double, null::double, null::bigint union all
    select step + 1, (mask | (1 << best.i))::int, best.rf, best.miv, best.g_stat, best.df from (
      select step, mask, arg_max({{'i': s.i, 'rf': s.rf, 'miv': s.miv, 'g_stat': s.g_stat, 'df': s.df}}, s.miv) as best from steps t join scored s on s.g = t.mask and t.mask & (1 << s.i) = 0 group by step, mask)
      where best.miv > 0.02 and {chi2_tail_sql('best.g_stat', 'best.df')} < 0.05)
  select step, rf, round(miv, 6) as miv, round(g_stat, 4) as g_stat, round({chi2_tail_sql('g_stat', 'df')}, 5) as p_value from steps where step > 0"""


def chi2_tail_sql(x: str, df: str) -> str:
    """The upper tail for any degrees of freedom: 1 less the series of the incomplete gamma function."""
    term = f"exp(i * ln({x} / 2) - {x} / 2 + ({df} / 2) * ln({x} / 2) - lgamma({df} / 2 + i + 1))"
    return f"(1 - list_sum(list_transform(range(0, 40 + (2 * least({x}, 4000))::bigint), lambda i: {term})))"


@query(miv_steps_sql())
def step_miv_steps(spark, sf):
    return selection.step_miv(factored(spark, sf), "y_b", CODED).steps.select("step", "rf", r("miv"), r("g_stat", 4), r("p_value", 5))


def out_steps(df: DataFrame) -> DataFrame:
    return df.select("step", "rf", r("coefficient", 4), r("p_value", 5), r("aic", 3))


@query(steps_sql())
def step_fwd_steps(spark, sf):
    rows, names = coded(spark, sf)
    return out_steps(selection.step_fwd(rows, "y_b", names).steps)


@query(steps_sql())
def step_fwd_coding(spark, sf):
    return out_steps(selection.step_fwd(factored(spark, sf), "y_b", CODED, coding="WoE", start="y_b ~ 1").steps)


@query(steps_sql(by_aic=True))
def step_fwdr_steps(spark, sf):
    rows, names = coded(spark, sf)
    return out_steps(selection.step_fwdr(rows, "y_b", names, sign=-1).steps)


@query(steps_sql(sign=0))
def step_fwd_any_sign(spark, sf):
    """No candidate has the sign asked for, so the fallback takes any."""
    rows, names = coded(spark, sf)
    return out_steps(selection.forward_or_any(rows, "y_b", names, sign=1).steps)


_TERMS = ["(Intercept)", *CODED]


@query(
    SUBSETS + ", whole as (select b, var, dev from fit where g = (1 << " + str(len(CODED)) + ") - 1), base as (select -2 * (sum(w * y) * ln(sum(w * y) / sum(w)) + sum(w * (1 - y)) * ln(1 - sum(w * y) / sum(w))) as null_dev from cell where g = 0), terms as ("
    + " union all ".join(f"select '{c}' as term, b[{i + 1}] as b, sqrt(var[{i + 1}]) as se, dev from whole" for i, c in enumerate(_TERMS))
    + ") select term, round(b, 4) as estimate, round(b - 1.959963984540054 * se, 4) as low, round(b + 1.959963984540054 * se, 4) as high, round(null_dev - dev, 3) as likelihood_ratio from terms, base"
)
def final_refit(spark, sf):
    """Estimates of all terms with their intervals, and the likelihood-ratio statistic of the model."""
    rows, names = coded(spark, sf)
    fit = glm.fit_logit(rows, "y_b", names)
    stat, _ = fit.likelihood_ratio()
    out = [(t, fit.intercept if t == "(Intercept)" else fit.coefficients[t], *fit.interval(t), stat) for t in ["(Intercept)", *names]]
    return spark.createDataFrame(out, "term string, estimate double, low double, high double, likelihood_ratio double").select("term", r("estimate", 4), r("low", 4), r("high", 4), r("likelihood_ratio", 3))


TRENDED = {
    "price": "round(o_totalprice / 50000)", "balance": "round(c_acctbal / 1000)", "seventh": "cast(id % 7 = 0 as int)", "noise": "id % 5",
    "mirror": "id % 3 - round(o_totalprice / 50000)",
}
TREND_GROUPS = {"price": 2, "balance": 2, "seventh": 1, "noise": 1, "mirror": 1}


def trend_sql(**how) -> str:
    """Factors of mixed signs: each coefficient must have the sign of the factor's rank correlation with the target."""
    made = ", ".join(f"{e} as {c}" for c, e in TRENDED.items())
    ranked = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as {c}" for c in TRENDED)
    signs = ", ".join(f"sign(corr({c}, y_b)) as {c}" for c in TRENDED)
    return (
        WITH.replace("with ", "with recursive ", 1) + f", trended as (select {made}, y_b from portfolio), signs as (select {signs} from (select {ranked}, y_b from trended)), "
        + logit_sql.subset_cells("tcells", "trended", list(TRENDED), "y_b") + ", " + logit_sql.newton("tfit", "tcells", len(TRENDED) + 1)
        + ", " + logit_sql.forward("fwd", "tfit", list(TRENDED), sign={c: f"(select {c} from signs)" for c in TRENDED}, by_aic=True, **how)
        + " select step, rf, round(coefficient, 4) as coefficient, round(p_value, 5) as p_value, round(aic, 3) as aic from fwd"
    )


def trended(spark, sf) -> DataFrame:
    return portfolio(spark, sf).selectExpr("y_b", *[f"{e} as {c}" for c, e in TRENDED.items()])


@query(trend_sql())
def step_fwdr_trend(spark, sf):
    return out_steps(selection.step_fwdr(trended(spark, sf), "y_b", list(TRENDED)).steps)


@query(trend_sql(groups=TREND_GROUPS))
def step_rpcr_trend(spark, sf):
    return out_steps(selection.step_rpcr(trended(spark, sf), "y_b", TREND_GROUPS).steps)


_TREND_RATES = " union all ".join(
    f"select '{c}' as rf, sum(b * (coalesce(below, 0) + g / 2.0::double)) / (sum(b) * sum(g)) - 0.5 as concordance from (select *, sum(g) over (order by v rows between unbounded preceding and 1 preceding) as below "
    f"from (select {c} as v, count(*) filter (y_b = 0) as g, count(*) filter (y_b = 1) as b from trended group by 1))" for c in TRENDED
)


@query(WITH + ", trended as (select " + ", ".join(f"{e} as {c}" for c, e in TRENDED.items()) + f", y_b from portfolio) select rf, round(concordance, 6) as concordance from ({_TREND_RATES})")
def rank_concordance(spark, sf):
    found = selection.concordance(trended(spark, sf), "y_b", list(TRENDED))
    return spark.createDataFrame(sorted(found.items()), "rf string, concordance double").select("rf", r("concordance"))


PROFILE = {c: 1 + (i > 0) for i, c in enumerate(CODED)}


@query(steps_sql(groups=PROFILE))
def step_rpc_steps(spark, sf):
    return out_steps(selection.step_rpc(coded(spark, sf)[0], "y_b", PROFILE).steps)


@query(steps_sql(groups=PROFILE, by_aic=True))
def step_rpcr_steps(spark, sf):
    return out_steps(selection.step_rpcr(coded(spark, sf)[0], "y_b", PROFILE).steps)


@query(steps_sql(start=["priority_na"]))
def step_fwd_start(spark, sf):
    return out_steps(selection.step_fwd(coded(spark, sf)[0], "y_b", CODED, start="y_b ~ priority_na").steps)


def dummy_terms() -> dict[str, list[str]]:
    return {"r_name": ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "seventh": [str(i) for i in range(1, 7)]}


def dummy_sql() -> str:
    """Joint Wald tests of dummies: the statistic by solving the block of the covariance, here the fit without the other term."""
    xs = [f"({c} = '{v}')::int" for c, vs in dummy_terms().items() for v in vs]
    cells = f", cell as (select 0 as g, [1.0::double, {', '.join(f'({x})::double' for x in xs)}] as x, y_b as y, count(*)::double as w, 0.0::double as o from factored group by all)"
    return CODED_SQL + cells + ", " + logit_sql.newton("fit", "cell", len(xs) + 1) + """ select i::int as term, round(b[i], 4) as coefficient, round(sqrt(var[i]), 5) as se from fit, range(1, 12) t(i)"""


@query(dummy_sql())
def dummy_coded_logit(spark, sf):
    rows, terms = selection.coded(factored(spark, sf), "y_b", ["r_name", "seventh"], "dummy")
    fit = selection.Fitter(rows, "y_b", terms)(["r_name", "seventh"])
    made = [(i + 1, b, se) for i, (_, b, se, _) in enumerate(fit.table())]
    return spark.createDataFrame(made, "term int, coefficient double, se double").select("term", r("coefficient", 4), r("se", 5))


def chosen_sql(name: str, fits: str, columns: list[str], source: str, offset: str = "0", **how) -> str:
    """CTEs: forward selection, and ``name`` (id and what else ``source`` has) with the linear predictor lin_{name}."""
    line = " + ".join(["b[1]", *(f"b[{i + 2}] * {c}" for i, c in enumerate(columns))])
    return f"""{logit_sql.subset_cells(f'{name}_cell', source, columns, 'y_b', offset)}, {logit_sql.newton(fits, f'{name}_cell', len(columns) + 1)}, {logit_sql.forward(f'{name}_fwd', fits, columns, **how)},
  {name} as (select s.*, {line} + {offset} as lin_{name} from {source} s, {fits} f where f.g = (select coalesce(max_by(mask, step), 0) from {name}_fwd))"""


EXPIT = "round(1 / (1 + exp(-({}))), 5) as prediction"
BLOCKS_SQL = {
    "staged": f"{CODED_SQL}, {chosen_sql('b1', 'f1', CODED[:1], 'coded')}, {chosen_sql('b2', 'f2', CODED[1:], 'b1', 'lin_b1')} select id, {EXPIT.format('lin_b2')} from b2",
    "embedded": f"{CODED_SQL}, {chosen_sql('b1', 'f1', CODED[:1], 'coded')}, b1p as (select *, 1 / (1 + exp(-lin_b1)) as pred_b1 from b1), {chosen_sql('b2', 'f2', [*CODED[1:], 'pred_b1'], 'b1p', free=['pred_b1'])} select id, {EXPIT.format('lin_b2')} from b2",
    "ensemble": f"{CODED_SQL}, {chosen_sql('b1', 'f1', CODED[:1], 'coded')}, {chosen_sql('b2', 'f2', CODED[1:], 'b1')}, {logit_sql.subset_cells('duo_cell', 'b2', ['lin_b1', 'lin_b2'], 'y_b')}, {logit_sql.newton('duo', 'duo_cell', 3)}"
    f" select id, {EXPIT.format('b[1] + b[2] * lin_b1 + b[3] * lin_b2')} from b2, duo where g = 3",
}


def _blocks(kind: str):
    def run(spark, sf):
        rows, names = coded(spark, sf)
        scored, _ = selection.blocks(rows, "y_b", {c: "b1" if i < 1 else "b2" for i, c in enumerate(names)}, kind)
        return scored.select("id", r("prediction", 5))
    run.__name__ = f"{kind}_blocks"
    return query(BLOCKS_SQL[kind])(run)


for _kind in ("staged", "embedded", "ensemble"):
    _blocks(_kind)


# the bound on band holds (its free coefficient is -1), the one on seventh doesn't
@query(CODED_SQL + ", " + logit_sql.subset_cells("cell", "coded", ["seventh"], "y_b", "(-0.5 * band)") + ", " + logit_sql.newton("fit", "cell", 2) + " select id, round(b[1] + b[2] * seventh - 0.5 * band, 4) as linear_predictor from coded, fit where g = 1")
def constrained_logit(spark, sf):
    rows, _ = coded(spark, sf)
    return glm.constrained_logit(rows, "y_b", ["band", "seventh"], {"band": -0.5}, {"seventh": 0.0}).select("id", r("linear_predictor", 4))


@query(WITH + """, b as (select min(o_totalprice) as low, max(o_totalprice) as high from portfolio) select id, round(case when o_totalprice < 250000 then (250000 - o_totalprice) / (250000 - low) else 0 end, 6) as left,
  round(case when o_totalprice > 250000 then (o_totalprice - 250000) / (high - 250000) else 0 end, 6) as right from portfolio, b""".replace(" as left", ' as "left"').replace(" as right", ' as "right"'))
def u_shape_basis(spark, sf):
    rows = portfolio(spark, sf)
    low, high = rows.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return glm.u_basis(rows, "o_totalprice", 250000.0, low, high).select("id", r("left"), r("right"))


@query(WITH.replace("with ", "with recursive ", 1) + f""", e as (select unnest(list_distinct(quantile_cont(o_totalprice, [{', '.join(repr(0.05 + 0.9 * i / 19) for i in range(20))}]))) as knot from portfolio), b as (select min(o_totalprice) as low, max(o_totalprice) as high from portfolio),
  cell as (select knot as g, [1.0::double, greatest(knot - o_totalprice, 0) / (knot - low), greatest(o_totalprice - knot, 0) / (high - knot)] as x, y_a as y, 1.0::double as w, 0.0::double as o from portfolio, e, b), {logit_sql.newton('fit', 'cell', 3)}
  select round(g, 4) as knot, round(b[2], 4) as "left", round(b[3], 4) as "right", round(dev, 3) as deviance, b[2] > 0 and b[3] > 0 and greatest({logit_sql.p_value('b[2]', 'var[2]')}, {logit_sql.p_value('b[3]', 'var[3]')}) < 0.05 as detected from fit""")
def u_shape_test(spark, sf):
    return glm.u_shape(portfolio(spark, sf), "o_totalprice", "y_a", knots=20).select(r("knot", 4), r("left", 4), r("right", 4), r("deviance", 3), "detected")


@query(WITH + ", e as (select unnest(list_distinct(quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) as cut from portfolio) select round(cut, 4) as cut, count(*) filter (o_totalprice <= cut and y_b = 0) as lg, count(*) filter (o_totalprice <= cut and y_b = 1) as lb, count(*) filter (o_totalprice > cut and y_b = 0) as rg, count(*) filter (o_totalprice > cut and y_b = 1) as rb from portfolio, e group by cut")
def tree_first_split(spark, sf):
    got = trees.best_splits(portfolio(spark, sf), F.lit(1), "y_b", ["o_totalprice"])
    rows = [(float(x.cut), x.lg, x.lb, x.rg, x.rb) for x in got]
    return spark.createDataFrame(rows, "cut double, lg long, lb long, rg long, rb long").select(r("cut", 4), "lg", "lb", "rg", "rb")


def split_sql(name: str, source: str) -> str:
    """CTE ``name`` (rf, cut): the best split of a node by deciles of two numbers or one category; one row, NULL if there is none."""
    counts = lambda left: f"count(*) filter ({left} and y_b = 0)::double as lg, count(*) filter ({left} and y_b = 1)::double as lb, count(*) filter (not ({left}) and y_b = 0)::double as rg, count(*) filter (not ({left}) and y_b = 1)::double as rb"
    deciles = "[" + ", ".join(str(i / 10) for i in range(1, 10)) + "]"
    numbers = " union all ".join(
        f"select '{c}' as rf, cut::varchar as cut, {counts(f'{c} <= cut')} from {source}, (select unnest(list_distinct(quantile_cont({c}::double, {deciles}))) as cut from {source}) group by cut" for c in ("o_totalprice", "c_acctbal")
    )
    return f"""{name} as (with tried as ({numbers} union all select 'r_name', l, {counts('r_name = l')} from {source}, (select distinct r_name as l from {source}) group by l),
    tested as (select *, {z_sql('lb', '(lg + lb)', 'rb', '(rg + rb)')} as z from tried, need where least(lg + lb, rg + rb) >= rows and least(lb, rb) >= bads)
    select best.rf as rf, best.cut as cut from (select arg_min({{'rf': rf, 'cut': cut}}, (-abs(z), rf, cut)) as best from tested where 2 * (1 - ({phi_sql('abs(z)')})) < 0.05))"""


def left_sql(split: str) -> str:
    return f"(case {split}.rf when 'r_name' then r_name = {split}.cut when 'o_totalprice' then o_totalprice <= try_cast({split}.cut as double) else c_acctbal <= try_cast({split}.cut as double) end)"


def rule_sql(split: str, side: str) -> str:
    signs = {"left": ("=", "<="), "right": ("<>", ">")}[side]
    return f"({split}.rf || ' ' || case when {split}.rf = 'r_name' then '{signs[0]}' else '{signs[1]}' end || ' ' || {split}.cut)"


@query(WITH + f""", need as (select greatest(30, ceil(count(*) * 0.05)) as rows, greatest(1, ceil(sum(y_b) * 0.01)) as bads from portfolio), {split_sql('s1', 'portfolio')},
  one as (select p.*, {left_sql('s1')} as l1 from portfolio p, s1), a as (select * from one where l1), b as (select * from one where not l1), {split_sql('s2', 'a')}, {split_sql('s3', 'b')},
  placed as (select y_b, case when l1 then case when s2.rf is null then 2 when {left_sql('s2')} then 4 else 5 end when s3.rf is null then 3 else 4 + 2 * (s2.rf is not null)::int + (not {left_sql('s3')})::int end as leaf,
    case when l1 then {rule_sql('s1', 'left')} || case when s2.rf is null then '' when {left_sql('s2')} then ' & ' || {rule_sql('s2', 'left')} else ' & ' || {rule_sql('s2', 'right')} end
    else {rule_sql('s1', 'right')} || case when s3.rf is null then '' when {left_sql('s3')} then ' & ' || {rule_sql('s3', 'left')} else ' & ' || {rule_sql('s3', 'right')} end end as rule from one, s1, s2, s3)
  select leaf::int as leaf, count(*) as no, sum(y_b)::bigint as nb, round(avg(y_b), 6) as dr, rule from placed group by leaf, rule""")
def tree_leaves(spark, sf):
    return trees.decision_tree(portfolio(spark, sf), "y_b", ["o_totalprice", "c_acctbal", "r_name"], max_depth=2)[0].select("leaf", "no", "nb", r("dr"), "rule")


PAIR = {"o_totalprice": "o_totalprice", "acctbal_na": "acctbal_na"}


def leaf_share(source: str, share: float, floor: int) -> str:
    return f"(select greatest(floor({share}::double * count(*)), {floor}) as least from {source})"


@query(RECURSIVE + ", " + tree_sql.grown("t", tree_sql.base("portfolio", PAIR, "y_b"), leaf_share("portfolio where acctbal_na is not null", 0.05, 30), 3)
       + " select 'L' || place as interaction, count(*) as n from t group by 1 union all select null, count(*) from portfolio where acctbal_na is null having count(*) > 0")
def interaction_leaves(spark, sf):
    return trees.interaction(portfolio(spark, sf), "y_b", ["o_totalprice", "acctbal_na"]).groupBy("interaction").agg(F.count(F.lit(1)).alias("n"))


MIXED = {"c_acctbal": "c_acctbal", "band": BANDS} | {f"r_name_{v}": f"(r_name = '{v}')::int" for v in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}


@query(RECURSIVE + ", " + tree_sql.grown("t", tree_sql.base("portfolio", MIXED, "y_a"), leaf_share("portfolio", 0.05, 30), 3)
       + " select 'L' || place as leaf, count(*) as no, sum(s)::bigint as nb, round(avg(s), 6) as dr, rule as path from t group by place, rule")
def interaction_rules(spark, sf):
    rows = portfolio(spark, sf).withColumn("band", F.floor(F.col("o_totalprice") / 100000).cast("int"))
    return trees.interaction_leaves(rows, "y_a", ["c_acctbal", "band", "r_name"])[0].select("leaf", "no", "nb", r("dr"), "path")


FOREST = ["o_totalprice", "c_acctbal", "price_sc"]


def forest_sql(per_tree: int, depth: int, seed: int = 991) -> str:
    """CTE ``t`` of ten trees on Poisson bootstraps of two thirds."""
    drawn = lambda i: " + ".join(f"({uniform_sql(str(seed + i), 'id')} >= {c!r}::double)::int" for c in trees.DRAWS)
    picked = trees.forest_factors(FOREST, 10, per_tree, seed)
    rows = " union all ".join(tree_sql.base("portfolio", {c: c for c in own}, "y_b", i + 1, "id", drawn(i)) for i, own in enumerate(picked))
    least = "(select greatest(1, round_even(0.05::double * round_even(2.0::double / 3 * count(*), 0), 0)) as least from portfolio)"
    return tree_sql.grown("t", rows, least, depth)


@query(RECURSIVE + ", " + forest_sql(2, 2) + ", wide as (select id, " + ", ".join(f"max('L' || place) filter (tree = {i}) as tree_{i}" for i in range(1, 11)) + " from t group by id) select "
       + ", ".join(f"tree_{i}" for i in range(1, 11)) + ", count(*) as n from wide group by all")
def forest_leaves(spark, sf):
    return trees.forest_interactions(portfolio(spark, sf), "y_b", FOREST, "id", trees=10).groupBy(*[f"tree_{i}" for i in range(1, 11)]).agg(F.count(F.lit(1)).alias("n"))


@query(RECURSIVE + ", " + forest_sql(3, 3) + " select tree::int as tree, 'L' || place as leaf, sum(n)::bigint as no, sum(n * s)::bigint as nb, round(sum(n * s) / sum(n), 6) as dr, rule as path from t where n > 0 group by tree, place, rule")
def forest_rules(spark, sf):
    return trees.forest_leaves(portfolio(spark, sf), "y_b", FOREST, "id", trees=10, per_tree=3, max_depth=3)[0].select("tree", "leaf", "no", "nb", r("dr"), "path")


@query(RECURSIVE + ", p as (select * replace ((y_b - pd)::decimal(18, 12) as pd), pd as rate from portfolio where c_acctbal is not null and o_totalprice is not null), "
       + tree_sql.grown("t", tree_sql.base("p", {"c_acctbal": "c_acctbal", "o_totalprice": "o_totalprice"}, "pd"), "(select greatest(30, round_even(0.03::double * count(*), 0)) as least from p)")
       + f""", l as (select place, rule, count(*) as no, sum(s)::double / count(*) as avg, sum(y_b)::double as nb, sum(rate::decimal(18, 12))::double as nm from t join p using (id) group by place, rule),
  m as (select *, nb / no as odr, nm / no as pd, case when round(nb / no, 5) = 0 then 0.00001 when round(nb / no, 5) = 1 then 0.99999 else nb / no end::double as near from l),
  z as (select *, (odr - pd) / sqrt(pd * (1 - pd) / no) as z, (pd - near) / sqrt(near * (1 - near) / no) as apart from m),
  q as (select *, 1 - ({phi_sql('abs(z)')}) as p, case when nm <= nb then {phi_sql('apart')} else 1 - ({phi_sql('apart')}) end as p_val from z)
  select place::int as segment, rule, no, round(avg, 6) as avg, round(odr, 6) as odr, round(pd, 6) as pd, round(z, 4) as z, round(p, 6) as p_value, case when p >= 0.05 then 'equal' when z > 0 then 'under' else 'over' end as res,
    nb::bigint as nb_obs, round(nm, 6) as nb_mod, round(p_val, 6) as p_val, case when p_val >= 0.05 then 'equal' when nm > nb then 'overestimate' else 'underestimate' end as test_res from q where (select count(*) from l) > 1""")
def segment_leaves(spark, sf):
    got = trees.segment_validation(portfolio(spark, sf), "y_b", "pd", ["c_acctbal", "o_totalprice"])
    return got.select("segment", "rule", "no", r("avg"), r("odr"), r("pd"), r("z", 4), r("p_value"), "res", "nb_obs", r("nb_mod"), r("p_val"), "test_res")


@query(" union all ".join(f"select '{a}' as rf1, '{b}' as rf2, round((1 - corr({a}, {b})) / 2, 6) as distance from lineitem" for i, a in enumerate(COR) for b in COR[:i]))
def corr_distance(spark, sf):
    d = cluster.distances(table(spark, sf, "lineitem"), COR)
    rows = [(a, b, float(d[i, j])) for i, a in enumerate(COR) for j, b in enumerate(COR[:i])]
    return spark.createDataFrame(rows, "rf1 string, rf2 string, distance double").select("rf1", "rf2", r("distance"))


@query()
def rf_clusters(spark, sf):
    return cluster.rf_clustering(table(spark, sf, "lineitem"), COR, k=2).select("rf", "cluster", r("dist_to_cluster"))


def held_out_sql(cells: str, more: str = "") -> str:
    """AUC, KS and squared error of the fits' groups on ``cells`` (g, the columns, y, n): rows that each fit left out."""
    p = "1 / (1 + exp(-(b[1] + " + " + ".join(f"b[{i + 2}] * {c}" for i, c in enumerate(CODED)) + ")))"
    return f""", tested as (select c.g, y, n, {p} as p from {cells} c join fit f on f.g = c.g), level as (select g, p, sum(n) filter (y = 0) as good, sum(n) filter (y = 1) as bad from tested group by 1, 2),
  ranked as (select g, coalesce(good, 0) as good, coalesce(bad, 0) as bad, coalesce(sum(good) over (partition by g order by p rows between unbounded preceding and 1 preceding), 0) as below from level),
  area as (select g, sum(bad * (below + good / 2)) / (sum(good) * sum(bad)) as auc from ranked group by g), error as (select g, sum(n * (y - p) * (y - p)) / sum(n) as amse from tested group by g)"""


EACH = ", ".join(CODED)
LISTED = f"[1.0::double, {', '.join(f'{c}::double' for c in CODED)}]"


@query(CODED_SQL + f""", folded as (select *, floor((row_number() over (order by (id + 1984) * 2654435761 % 4294967296, id) - 1) * 10 / count(*) over ())::int as fold from coded),
  small as (select fold, {EACH}, y_b as y, count(*)::double as n from folded group by all), cell as (select g, {LISTED} as x, y, n as w, 0.0::double as o from small, range(0, 10) f(g) where fold <> g), {logit_sql.newton('fit', 'cell', 6)}"""
       + held_out_sql("(select fold as g, * from small)") + " select g::int as fold, round(auc, 6) as auc, round(amse, 6) as amse, round(sqrt(amse), 6) as rmse from area join error using (g)")
def kfold_validation(spark, sf):
    rows, names = coded(spark, sf)
    return resample.kfold_validation(rows, "y_b", names, "id", 10).select("fold", r("auc"), r("amse"), r("rmse"))


POISSON_SQL = " + ".join(f"(u >= {c})::int" for c in resample.POISSON)


@query(CODED_SQL + f""", keyed as (select *, ('0x' || substr(md5(concat_ws('|', 1122, id)), 1, 8))::bigint as start from coded), moved as (select k.*, g, (start + g * 2654435761) % 4294967296 as mixed from keyed k, range(0, 1000) d(g)),
  drawn as (select g, {EACH}, y_b as y, (xor(mixed, mixed >> 15) * 739982445) % 4294967296 / 4294967296.0::double as u from moved),
  small as (select g, {EACH}, y, sum({POISSON_SQL})::double as w, count(*) filter (u < {resample.POISSON[0]})::double as n from drawn group by all), cell as (select g, {LISTED} as x, y, w, 0.0::double as o from small), {logit_sql.newton('fit', 'cell', 6, 9)}"""
       + held_out_sql("small") + " select g::int as draw, round(auc, 6) as auc from area")
def bootstrap_validation(spark, sf):
    rows, names = coded(spark, sf)
    return resample.bootstrap_validation(rows, "y_b", names, "id", 1000).select("draw", r("auc"))


@query()
def scorecard_pipeline(spark, sf):
    made = pipeline.build(portfolio(spark, sf), "y_b", "id", ["o_totalprice", "c_acctbal"], FACTORS)
    return made.scale.select("rating", "no", "nb", r("dr"), r("pdc"), r("pd_calib"))


@query()
def cv_benchmark(spark, sf):
    rows = portfolio(spark, sf).select("id", "y_b", "o_totalprice", "c_acctbal", "r_name")
    models = benchmark.default_models(rows.count())
    _, scored = benchmark.run(rows, "y_b", "id", ["o_totalprice", "c_acctbal"], ["r_name"], models, k=10)
    return metrics.fold_summary(scored, ["auc", "ks", "brier"])


@query()
def tuned_logit(spark, sf):
    """Fifty trials of the logit's penalty over five inner folds, as many as the tuning of a learner makes."""
    rows = portfolio(spark, sf).select("id", "y_b", "o_totalprice", "c_acctbal", "r_name")
    return tuning.tune(rows, "y_b", "id", ["o_totalprice", "c_acctbal"], ["r_name"], "logit").select("trial", r("c", 8), r("auc"))


# ---- further operators, each with its SQL


def ols_sql(name: str, source: str, xs: list[str], y: str) -> str:
    """CTE ``name`` (rss): the residual sum of squares of a linear model, by eliminating the normal equations."""
    p = len(xs)
    sums = ", ".join([f"sum(({a})::double * ({b})::double) as h{i}_{j}" for i, a in enumerate(xs) for j, b in enumerate(xs) if j >= i] + [f"sum(({a})::double * {y}) as g{i}" for i, a in enumerate(xs)])
    rows = ", ".join("[" + ", ".join([f"h{min(i, j)}_{max(i, j)}" for j in range(p)] + [f"g{i}"]) + "]" for i in range(p))
    gains = ", ".join(f"g{i}" for i in range(p))
    matrix = f"select yy, [{gains}] as g, [{rows}]::double[][] as a from (select {sums}, sum({y} * {y}) as yy from {source})"
    for k in range(1, p + 1):
        matrix = f"select yy, g, list_transform(a, lambda r, i: case when i = {k} then list_transform(r, lambda v: v / a[{k}][{k}]) else list_transform(r, lambda v, j: v - r[{k}] * a[{k}][j] / a[{k}][{k}]) end) as a from ({matrix})"
    return f"{name} as (select yy - list_sum(list_transform(g, lambda v, i: v * a[i][{p + 1}])) as rss from ({matrix}))"


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_STRATA = ["1", *(f"(r_name = '{v}')::int" for v in REGIONS[1:])]
_GROUPS = [f"(c_mktsegment = '{v}')::int" for v in SEGMENTS[1:]]


@query(WITH + ", scaled as (select *, o_totalprice / 1000 as price from portfolio), " + ols_sql("less", "scaled", _STRATA, "price") + ", " + ols_sql("whole", "scaled", _STRATA + _GROUPS, "price")
       + " select round(((less.rss - whole.rss) / 4) / (whole.rss / (select count(*) - 9 from portfolio)), 4) as f, 4 as df1, (select count(*) - 9 from portfolio)::int as df2 from less, whole")
def fairness_anova_conditional(spark, sf):
    made = validation.fairness_continuous_conditional(portfolio(spark, sf), "c_mktsegment", "o_totalprice", "r_name")
    return spark.createDataFrame([made], "f double, df1 int, df2 int").select(r("f", 4), "df1", "df2")


# 1.6448536 and 16.9189776: the 95 % points of the normal and of chi-squared with 9 degrees of freedom
@query(psi_sql(PSI_BIN, PSI_BIN, HALVES + edges_sql("o_totalprice", 10, "base") + ",", "left").rsplit("select bin", 1)[0]
       + """, n as (select count(*)::double as b, 1 / sum(base_no) + 1 / sum(target_no) as f from s) select round(sum((q - p) * ln(q / p)), 8) as psi, round(max(f * (b - 1) + 1.6448536269514722 * f * sqrt(2 * (b - 1))), 8) as cv_zscore,
  round(sum((p - q) * (p - q) / p), 8) as psi_star, round(max(16.918977604620448 * f), 8) as cv_chisq, 0.95::double as ci from s, n""")
def psi_summary(spark, sf):
    return validation.psi_summary(validation.psi(*halves(spark, sf), "o_totalprice")).select(r("psi", 8), r("cv_zscore", 8), r("psi_star", 8), r("cv_chisq", 8), r("ci"))


@query(ORACLE_SQL["evrs_returns"].rsplit("select sim::int", 1)[0] + "select model, round(avg(coalesce(gain, 0)), 6) as mean_return, round(stddev_pop(coalesce(gain, 0)), 6) as std_return, round(min(coalesce(gain, 0)), 6) as min_return, round(max(coalesce(gain, 0)), 6) as max_return from g group by 1")
def evrs_summary(spark, sf):
    rows = portfolio(spark, sf).withColumn("pd_bm", F.lit(0.3))
    made = validation.evrs_summary(validation.evrs(rows, "y_b", "pd", "pd_bm", "id", sims=500))
    return made.select("model", *[r(f"{c}_return") for c in ("mean", "std", "min", "max")])


RARE = "(id % 3000 = 0)::int"


@query(WITH + f", t as (select id, {RARE} as y from portfolio), k as (select least(10, sum(y)) as k from t) select fold, y, count(*) as n from (select y, floor((row_number() over (partition by y order by {ORDER_KEY}, id) - 1) * (select k from k) / count(*) over (partition by y))::int as fold from t) group by 1, 2")
def kfold_rare_class(spark, sf):
    rows = portfolio(spark, sf).select("id", (F.col("id") % 3000 == 0).cast("int").alias("y"))
    return resample.kfold_indices(rows, "id", "y").groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))


CUTS = {"band": "floor(o_totalprice / 100000)::bigint::varchar", "half": "floor(o_totalprice / 50000)::bigint::varchar", "c_mktsegment": "c_mktsegment"}


@query(WITH + ", cut as (select y_b, " + ", ".join(f"{e} as {c}" for c, e in CUTS.items()) + " from portfolio), " + ", ".join(f"w_{c} as ({woe_sql(c, 'y_b', 'cut')})" for c in CUTS)
       + ", iv as (" + " union all ".join(f"select '{c}' as rf, sum(iv_b) as iv from w_{c}" for c in CUTS) + "), pair as (select corr(a.woe, b.woe) as corr from cut join w_band a on cut.band = a.bin join w_half b on cut.half = b.bin)"
       + ", top as (select arg_max(rf, iv) as rf from iv where rf <> 'c_mktsegment') select rf, round(iv, 6) as iv from iv, pair where iv >= 0.0001 and (rf = 'c_mktsegment' or corr <= 0.7 or rf = (select rf from top))")
def iv_shortlist_uncorrelated(spark, sf):
    rows = portfolio(spark, sf).select("y_b", F.floor(F.col("o_totalprice") / 100000).cast("string").alias("band"), F.floor(F.col("o_totalprice") / 50000).cast("string").alias("half"), "c_mktsegment")
    names = list(CUTS)
    pairs = profile.correlation_pairs(woe.with_woe(rows, "y_b", names), [f"{c}_woe" for c in names], -1.0)
    pairs = pairs.select(F.regexp_replace("rf1", "_woe$", "").alias("rf1"), F.regexp_replace("rf2", "_woe$", "").alias("rf2"), "corr")
    return woe.shortlist(woe.woe_table(rows, names, "y_b"), iv=0.0001, low=0.0001, pairs=pairs).select("rf", r("iv"))


@query(SCORE.replace("o_totalprice as s", "-o_totalprice as s") + " select round(greatest(sum(b * (gb + g / 2)) / max(tg * tb), 1 - sum(b * (gb + g / 2)) / max(tg * tb)), 6) as auc from c")
def auc_oriented(spark, sf):
    rows = portfolio(spark, sf).withColumn("s", -F.col("o_totalprice"))
    return metrics.auc(rows, "s", "y_b").select(F.round(woe.oriented(F.col("auc")), 6).alias("auc"))


CATEGORIES = [("band", "behaviour"), ("c_mktsegment", "application"), ("r_name", "application")]


@query(f"""with book as (select * from (values {', '.join(map(str, CATEGORIES))}) t(rf, category)), listed as (select rf from ({ORACLE_SQL['iv_shortlist']}) where iv > 0.2)
  select category, count(*) as n, count(l.rf) as n_listed, count(l.rf) > 0 as covered from book b left join listed l on l.rf = b.rf group by category""")
def category_coverage(spark, sf):
    book = spark.createDataFrame(CATEGORIES, "rf string, category string")
    return woe.coverage(book, iv_shortlist(spark, sf).where("iv > 0.2"))


_MAP = {"1-URGENT": 0.4, "2-HIGH": 0.1, "3-MEDIUM": -0.2, "5-LOW": -0.3, None: 0.05}


@query(WITH + " select id, round(1 / (1 + exp(-(-0.5 - 1.2 * case priority_na when '1-URGENT' then 0.4 when '2-HIGH' then 0.1 when '3-MEDIUM' then -0.2 when '5-LOW' then -0.3 else 0.05 end))), 8) as pd from portfolio")
def score_from_parameters(spark, sf):
    stored = scorecard.parameters(glm.Logit(["priority_na"], {"priority_na": -1.2}, -0.5, None, 0.0, 0.0, 0, True), {"priority_na": _MAP}, "manual")
    return scorecard.score_from_parameters(portfolio(spark, sf), *scorecard.read_parameters(stored)).select("id", r("pd", 8))


MODELS = [("miv", 0.81, 0.62, 0.50, 0.8060, 1.0, 8, 1.0), ("boosted", 0.80, 0.60, 0.52, 0.7700, 1.0, 5, 0.0), ("forward", 0.79, 0.58, 0.47, 0.7890, 0.0, 13, 1.0)]
_NORM = "({0} - min({0}) over ()) / (max({0}) over () - min({0}) over ())"


@query("with m as (select * from (values " + ", ".join(map(str, MODELS)) + ") t(model, auc, gini, ks, cv, sign, n, monotonicity)) select model, round((0.25 * " + _NORM.format("auc") + " + 0.15 * " + _NORM.format("gini") + " + 0.1 * " + _NORM.format("ks")
       + " + 0.2 * greatest(0, least(1, 1 - abs(auc - cv) / 0.03)) + 0.15 * sign + 0.1 * greatest(0, least(1, 1 - (n - 4) / 8)) + 0.05 * monotonicity)::double, 6) as composite from m")
def composite_models(spark, sf):
    rows = [(m, a, g, k, scorecard.stability(a, cv), s, scorecard.parsimony(n), mono) for m, a, g, k, cv, s, n, mono in MODELS]
    return scorecard.composite(spark.createDataFrame(rows, "model string, auc double, gini double, ks double, stability double, sign double, parsimony double, monotonicity double")).select("model", r("composite"))


SCORES = {"price": "o_totalprice", "coarse": "round(o_totalprice / 40000)", "balance": "c_acctbal", "mixed": "o_totalprice / 100000 + c_acctbal / 20000"}
_PLACED = ", ".join(f"({e})::double as s_{m}" for m, e in SCORES.items())
#: For each row the share of the other class that its score beats, ties one half, from ranks over all rows and inside the class.
_OVER = lambda m, part: f"rank() over ({part} order by s_{m}) + (count(*) over (partition by {'y_b, ' if part else ''}s_{m}) - 1) / 2.0::double"
_SHARE = lambda m: f"case when y_b = 1 then ({_OVER(m, '')} - ({_OVER(m, 'partition by y_b')})) / n0 else 1 - ({_OVER(m, '')} - ({_OVER(m, 'partition by y_b')})) / n1 end as v_{m}"
AREAS_SQL = (
    WITH + f", scored as (select y_b, {_PLACED}, count(*) filter (y_b = 1) over () as n1, count(*) filter (y_b = 0) over () as n0 from portfolio), placed as (select y_b, {', '.join(map(_SHARE, SCORES))} from scored), areas as ("
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, avg(v_{a}) filter (y_b = 1) as auc_a, avg(v_{b}) filter (y_b = 1) as auc_b, "
        f"var_samp(v_{a} - v_{b}) filter (y_b = 1) / count(*) filter (y_b = 1) + var_samp(v_{a} - v_{b}) filter (y_b = 0) / count(*) filter (y_b = 0) as variance from placed"
        for a in SCORES for b in SCORES if a != b
    ) + "), tested as (select *, (auc_a - auc_b) / sqrt(variance) as z from areas)"
)


def predicted(spark, sf) -> DataFrame:
    cells = ", ".join(f"struct('{m}' as model, cast({e} as double) as proba)" for m, e in SCORES.items())
    return portfolio(spark, sf).selectExpr("id", "y_b as y", f"inline(array({cells}))")


@query(AREAS_SQL + f" select a, b, round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b, round(z, 4) as z, round(2 * (1 - ({phi_sql('abs(z)')})), 5) as p_value from tested where a < b")
def paired_areas(spark, sf):
    """DeLong's tests of all pairs of models from one covariance matrix."""
    areas = metrics.paired_areas(predicted(spark, sf))
    rows = [(a, b, float(areas.auc[i]), float(areas.auc[areas.models.index(b)]), *areas.test(a, b)[1:]) for i, a in enumerate(areas.models) for b in areas.models[i + 1 :]]
    return spark.createDataFrame(rows, "a string, b string, auc_a double, auc_b double, z double, p_value double").select("a", "b", r("auc_a"), r("auc_b"), r("z", 4), r("p_value", 5))


@query(AREAS_SQL + f""" select a as model, round(auc_a - auc_b, 6) as difference, round(auc_a - auc_b - 1.96 * abs((auc_a - auc_b) / z), 6) as low, round(auc_a - auc_b + 1.96 * abs((auc_a - auc_b) / z), 6) as high,
  round(2 * (1 - ({phi_sql('abs(z)')})), 5) as p_value from tested where b = 'price'""")
def forest_table(spark, sf):
    return metrics.forest(predicted(spark, sf), "price").select("model", r("difference"), r("low"), r("high"), r("p_value", 5))


@query("""with b as (select year(o_orderdate) as w, 1 + (o_totalprice >= 100000)::int + (o_totalprice >= 200000)::int + (o_totalprice >= 300000)::int as bin, count(*) as n from orders group by 1, 2),
  s as (select *, n / sum(n) over (partition by w) as share, case bin when 1 then 0.3 when 2 then 0.3 when 3 then 0.2 else 0.2 end::double as base from b) select w::int as w, round(sum((share - base) * ln(share / base)), 6) as psi, sum(n)::bigint as n from s group by 1""")
def window_psi(spark, sf):
    rows = table(spark, sf, "orders").withColumn("bin", metrics.cut(F.col("o_totalprice"), [0.0, 100000.0, 200000.0, 300000.0, 1e9], right=False))
    counts = rows.groupBy(F.year("o_orderdate").alias("window_start"), "bin").agg(F.count(F.lit(1)).alias("n"))
    return monitor.window_psi(counts, {1: 0.3, 2: 0.3, 3: 0.2, 4: 0.2}).select(F.col("window_start").cast("int").alias("w"), r("psi"), "n")


@query("select n_nationkey, case n_regionkey when 0 then 'south' when 1 then 'west' when 2 then 'east' else n_regionkey::varchar end as n_regionkey from nation")
def dictionary_decode(spark, sf):
    return loans.decode(table(spark, sf, "nation"), "n_regionkey", loans.parse_codes("0 = south, 1 = west; 2 = east")).select("n_nationkey", "n_regionkey")


BOUNDS = [("A", 300000.0, 600000.0), ("B", 200000.0, 290000.0), ("C", 100000.0, 195000.5), ("D", 5000.0, 100000.0)]


@query(WITH + " select grade, count(*) as n from (select case when o_totalprice >= 300000 then 'A' when o_totalprice >= 200000 then 'B' when o_totalprice >= 100000 then 'C' else 'D' end as grade from portfolio) group by 1")
def grades_with_gaps(spark, sf):
    return portfolio(spark, sf).groupBy(scorecard.fixed_grades(F.col("o_totalprice"), BOUNDS).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


_CASES = {"x": ("'a'", "y_b"), "gone": ("null::varchar", "y_b"), "y": ("r_name", "1"), "odd": ("r_name", "(id % 3)::int")}


@query(WITH + ", cases as (" + " union all ".join(f"select '{name}' as case_, {x} as x, {y} as y from portfolio" for name, (x, y) in _CASES.items()) + """), seen as (
  select case_, count(*) filter (x is not null and y is not null) as n, count(distinct x) filter (y is not null) as nx, count(distinct y) filter (x is not null) as ny,
         count(*) filter (x is not null and y is not null and y not in (0, 1)) as odd from cases group by case_
), coded as (select case_, case when n = 0 then 4 when ny = 1 then 1 when nx = 1 then 2 when odd > 0 then 3 else 0 end as code from seen)
select case_, code, case code when 4 then 'no complete cases' when 1 then 'y has one value among complete cases' when 2 then 'x has one value among complete cases' when 3 then 'y is not 0/1' end as message from coded""")
def cat_bin_codes(spark, sf):
    rows = portfolio(spark, sf).withColumns({"one": F.lit("a"), "gone": F.lit(None).cast("string"), "flat": F.lit(1), "odd": (F.col("id") % 3).cast("int")})
    cases = {"x": ("one", "y_b"), "gone": ("gone", "y_b"), "y": ("r_name", "flat"), "odd": ("r_name", "odd")}
    out = [binning.cat_bin_checks(rows, x, y).select(F.lit(name).alias("case_"), "code", "message") for name, (x, y) in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(WITH + f""", d as (select {normal_sql('7', 'id')} as v from portfolio), m as (select avg(v) as m, stddev_pop(v) as s, count(*) as n, ceil(2 * count(*) ** 0.4)::int as k from d), c as (select least(floor(({phi_sql('((v - m) / s)')}) * k), k - 1) as c, count(*) as n from d, m group by 1),
  x as (select sum(c.n * c.n)::double * max(k) / max(m.n) - max(m.n) as stat, max(k) - 3 as df from c, m) select round({chi2_tail_sql('stat', 'df')}, 3) as p from x""")
def normality_of_draws(spark, sf):
    rows = portfolio(spark, sf).select(normal(F.lit(7), F.col("id")).alias("v"))
    return spark.createDataFrame([(profile.normality_p(rows, ["v"])["v"],)], "p double").select(r("p", 3))


@query(WITH + f", d as (select id, case when id % 9 = 0 then null else {normal_sql('7', 'id')} end as v from portfolio) select id, round(coalesce(v, (select avg(v) from d)), 6) as v, round(case when id % 9 = 0 then (select quantile_cont(c_acctbal, 0.5) from portfolio where id % 9 <> 0) else c_acctbal end, 6) as w from d join portfolio using (id)")
def impute_automatic(spark, sf):
    gone = F.col("id") % 9 == 0
    rows = portfolio(spark, sf).select("id", F.when(~gone, normal(F.lit(7), F.col("id"))).alias("v"), F.when(~gone, F.col("c_acctbal")).alias("w"))
    return profile.impute(rows, ["v", "w"])[0].select("id", r("v"), r("w"))


def loans_sql(n: int, seed: int) -> str:
    u, z = (lambda what: uniform_sql(str(seed), "id", f"'{what}'")), (lambda what: normal_sql(str(seed), "id", f"'{what}'"))
    pick = lambda values, what: f"({values!r})[(1 + floor({u(what)} * {len(values)}))::int]"
    return f"""with d as (select id, floor({u('age')} * 50 + 20)::int as age, exp({z('income')} * 0.5 + 10.8) as income, floor({u('job')} * 20)::int as emp_length, exp({z('amount')} * 0.6 + 9.3) as loan_amount, {u('rate')} * 18 + 5 as interest_rate, {u('dti')} * 40 as dti,
  least(greatest(round_even({z('score')} * 60 + 680, 0), 300), 850)::int as credit_score, {pick(loans.OWNERSHIP, 'home')} as home_ownership, {pick(loans.PURPOSES, 'purpose')} as purpose, {pick(loans.GRADES, 'grade')} as grade, {u('default')} as u from range({n}) t(id))
  select id, age, round(income, 4) as income, emp_length, round(loan_amount, 4) as loan_amount, round(interest_rate, 6) as interest_rate, round(dti, 6) as dti, credit_score, home_ownership, purpose, grade,
  (u < 1 / (1 + exp(-(-2.0 + 0.08 * (interest_rate - 14) + 0.03 * (dti - 20) - 0.01 * (credit_score - 680)))))::int as "default" from d"""


@query(loans_sql(3000, 2191))
def synthetic_loans(spark, sf):
    made = loans.load_loans(spark)
    return made.select("id", "age", r("income", 4), "emp_length", r("loan_amount", 4), r("interest_rate"), r("dti"), "credit_score", "home_ownership", "purpose", "grade", "default")


@query()
def boosted_selection(spark, sf):
    rows, names = coded(spark, sf)
    return out_steps(selection.boosted_selection(rows, "y_b", names).steps)


def x2y_sql(numbers: list[str], classes: dict[str, str]) -> str:
    """CTE ``told`` (x, y, x2y) of all ordered pairs; ``classes`` are 0/1 expressions by column."""
    columns = {c: f"{c}::double" for c in numbers} | classes
    pairs = [(a, b) for a in columns for b in columns if a != b]
    goal = lambda b: f"{b}::decimal(28, 10)" if b in classes else f"({b} - (select round(avg({b}), 3) from li))::decimal(28, 10)"
    rows = " union all ".join(tree_sql.base("li", {a: a}, goal(b), i) for i, (a, b) in enumerate(pairs))
    least = " union all ".join(f"select {i} as tree, greatest(30, floor(0.1::double * count(*))) as least from li where {a} is not null and {b} is not null" for i, (a, b) in enumerate(pairs))
    names = ", ".join(f"({i}, '{a}', '{b}', {str(b in classes).lower()})" for i, (a, b) in enumerate(pairs))
    return f"""li as materialized (select row_number() over () as id, {', '.join(f'{e} as {c}' for c, e in columns.items())} from lineitem), least as materialized ({least}), {tree_sql.grown('t', rows, 'least', each=True)},
  c as (select *, s::double as y, avg(s::double) over (partition by tree, place) as guess, avg(s::double) over (partition by tree) as middle from t where s is not null),
  l as (select tree, place, sum(abs(y - guess)) as e, sum(abs(y - middle)) as b, count(*) as n, sum(y) as ones from c group by tree, place),
  h as (select tree, sum(e) as e, sum(b) as b, sum(n) as n, sum(greatest(ones, n - ones)) as hits, greatest(sum(ones), sum(n - ones)) as most from l group by tree),
  told as (select x, y, greatest(0, case when class then 1 - (n - hits) / (n - most) else 1 - e / b end) as x2y from h join (values {names}) p(tree, x, y, class) using (tree))"""


@query("with recursive " + x2y_sql(COR, {}) + " union all ".join(f" select '{a}' as rf1, '{b}' as rf2, round(1 - avg(x2y), 6) as distance from told where (x = '{a}' and y = '{b}') or (x = '{b}' and y = '{a}')" for i, a in enumerate(COR) for b in COR[:i]))
def x2y_distances(spark, sf):
    d = cluster.distances(table(spark, sf, "lineitem"), COR, "x2y")
    rows = [(a, b, float(d[i, j])) for i, a in enumerate(COR) for j, b in enumerate(COR[:i])]
    return spark.createDataFrame(rows, "rf1 string, rf2 string, distance double").select("rf1", "rf2", r("distance"))


@query("with recursive " + x2y_sql(["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"], {"l_linestatus": "(l_linestatus = 'O')::int", "late": "(l_shipdate >= timestamp '1995-06-17')::int"}) + " select x, y, round(x2y, 6) as x2y from told")
def x2y_pairs(spark, sf):
    """How well each of six columns, two of them texts, tells each other one."""
    rows = table(spark, sf, "lineitem").withColumn("late", F.when(F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp"), "late").otherwise("early"))
    return cluster.x2y(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_linestatus", "late"]).select("x", "y", r("x2y"))
