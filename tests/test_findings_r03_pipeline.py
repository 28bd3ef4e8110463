"""The scorecard pipeline on counted rows (F18): rows are read for the bins, the folds and the counts, then no more."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from lendframe.operators import boosting, metrics, profile, resample, scorecard, selection, validation, woe
from lendframe.plans import scorecard as pipeline


@pytest.fixture(scope="module")
def book(spark):
    made = spark.range(3000).selectExpr(
        "id", "cast(id * 37 % 50 as double) as x", "case when id % 7 = 0 then null else cast(id % 3 as string) end as c", "cast(id % 4 as string) as d", "id * 7919 % 100 as u"
    )
    return made.withColumn("y", F.expr("case when id % 401 = 0 then null else cast(u < x + 10 * (id % 3) + 3 * (id % 4) as int) end")).drop("u").cache()


def test_builders_read_each_distinct_row_once(spark, book, monkeypatch):
    seen = {}

    def watched(name, run):
        def inner(df, *rest, **more):
            seen[name] = df.count()
            return run(df, *rest, **more)
        return inner

    for name, run in (("step_miv", selection.step_miv), ("step_fwd", selection.step_fwd), ("boosted_selection", partial(selection.boosted_selection, trees=2))):
        monkeypatch.setattr(selection, name, watched(name, run))
    got = pipeline.build(book.drop("d"), "y", "id", ["x"], ["c"])
    # bins of x by levels of c by y (NULL too) by folds by halves
    assert len(seen) == 3 and max(seen.values()) <= 5 * 4 * 3 * 5 * 2
    scale = {r.rating: (r.no, r.nb, r.pdc) for r in got.scale.collect()}
    rows = {r.grade: r for r in got.scored.groupBy("grade").agg(F.count("y").alias("no"), F.sum("y").alias("nb"), F.avg("pd").alias("pdc")).collect()}
    assert sum(no for no, _, _ in scale.values()) == book.where("y is not null").count()
    assert {g: (r.no, r.nb, pytest.approx(r.pdc)) for g, r in rows.items()} == scale


def test_counted_rows_give_the_figures_of_the_rows(book):
    counts = book.groupBy("x", "c", "d", "y").agg(F.count(F.lit(1)).alias("n"))
    same = lambda a, b, key: {r[key]: tuple(r) for r in a.collect()} == {r[key]: tuple(v if not isinstance(v, float) else pytest.approx(v, abs=1e-9) for v in r) for r in b.collect()}
    assert same(woe.woe_table(book.where("c is not null"), ["c"], "y"), woe.woe_table(counts.where("c is not null"), ["c"], "y", "n"), "bin")
    for run in (selection.step_miv, partial(selection.step_fwd, coding="WoE")):
        plain, counted = run(book, "y", ["c", "d"]), run(counts, "y", ["c", "d"], times="n")
        assert plain.selected == counted.selected and same(plain.steps, counted.steps, "rf")
        assert plain.model.coefficients == pytest.approx(counted.model.coefficients) and plain.model.n == counted.model.n
    wide, wide_counts = selection.with_woe(book, "y", ["c", "d"]), selection.with_woe(counts, "y", ["c", "d"], "n")
    columns = ["c_woe", "d_woe", "x"]
    assert same(profile.correlation_pairs(wide, columns, -1.0).withColumn("k", F.concat("rf1", "rf2")), profile.correlation_pairs(wide_counts, columns, -1.0, "n").withColumn("k", F.concat("rf1", "rf2")), "k")
    assert metrics.auc(book, "x", "y").first() == pytest.approx(metrics.auc(counts, "x", "y", times="n").first())
    assert same(scorecard.deciles(book, "x", "y"), scorecard.deciles(counts, "x", "y", times="n"), "decile")
    graded, graded_counts = scorecard.grades(book, "x"), scorecard.grades(counts, "x", times="n")
    assert same(scorecard.rating_scale(graded, "grade", "y", "x"), scorecard.rating_scale(graded_counts, "grade", "y", "x", "n"), "rating")
    assert same(validation.heterogeneity(graded, "y", "grade"), validation.heterogeneity(graded_counts, "y", "grade", times="n"), "rating")


def test_counted_folds(book, monkeypatch):
    for k in (5, 7):
        made = resample.folds(book.withColumn("own", resample.fold_of(book, "id", k, 1984)), "id", None, k, 1984)
        assert made.where("own <> fold or own is null").count() == 0
    few = book.limit(2).select("id").unionByName(book.sparkSession.createDataFrame([(None,)], "id long"))
    assert sorted((r.own for r in few.withColumn("own", resample.fold_of(few, "id", 5, 1984)).collect()), key=lambda v: (v is None, v)) == [0, 2, None]
    own = book.withColumn("own", resample.fold_of(book, "id", 3, 1984))
    counts = own.groupBy("own", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    plain = resample.kfold_validation(book, "y", ["x"], "id", 3).orderBy("fold").collect()
    for hidden in (False, True):
        if hidden:  # too many distinct rows for the driver
            monkeypatch.setattr(resample, "compress", lambda *_: None)
        counted = resample.kfold_validation(counts, "y", ["x"], "id", 3, fold="own", times="n").orderBy("fold").collect()
        assert [tuple(r) for r in plain] == [pytest.approx(tuple(r)) for r in counted]


def test_rounds_of_one_partition_are_one_stage(spark):
    rows = spark.range(2000).selectExpr("id", "cast(id % 8 as double) as x", "cast(id % 8 > 4 or id % 31 = 0 as int) as y")
    tracker = spark.sparkContext.statusTracker()

    def work(trees):
        spark.sparkContext.setJobGroup(f"boost-{trees}", "")
        boosting.fit_boosted(rows, "y", "id", ["x"], [], [boosting.Params(trees=trees, leaves=4, depth=2)])
        jobs = tracker.getJobIdsForGroup(f"boost-{trees}")
        return len(jobs), sum(len(tracker.getJobInfo(j).stageIds) for j in jobs)

    (jobs, stages), (more_jobs, more_stages) = work(2), work(5)
    assert more_jobs > jobs and more_stages - stages == more_jobs - jobs
