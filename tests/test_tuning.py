"""Parzen tuning: the sampler on a known function, and trials against fits one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.plans import benchmark, tuning
from lendframe.plans.tuning import Parzen, Range


def test_density_is_one_over_the_range():
    x = (np.arange(20000) + 0.5) / 20000
    assert Parzen.density(np.array([0.02, 0.5, 0.55]), x).mean() == pytest.approx(1, abs=1e-3)


def test_sampler_finds_the_top_sooner_than_chance():
    space = {"a": Range(1e-3, 10, log=True), "b": Range(2, 9, whole=True), "c": Range(0, 1)}
    goal = lambda p: -((np.log10(p["a"]) - 0.3) ** 2) - ((p["b"] - 6) / 4) ** 2 - (p["c"] - 0.8) ** 2
    found, chance = [], []
    for seed in range(24):
        sampler, random = Parzen(space, seed), np.random.default_rng(seed + 100)
        for _ in range(5):
            sampler.tell([goal(p) for p in sampler.propose(10)])
        found.append(max(sampler.scores))
        chance.append(max(goal({n: r.of_unit(random.random()) for n, r in space.items()}) for _ in range(50)))
    # fifty trials in batches of ten come at least twice as near to the top as fifty random ones
    assert np.mean(found) > np.mean(chance) / 2
    for r, v in ((space["a"], 0.7), (space["b"], 5), (space["c"], 0.25)):
        assert r.of_unit(r.to_unit(v)) == pytest.approx(v)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    made = [(i, float(x), str(rng.choice(list("abc"))), int(rng.random() < 1 / (1 + np.exp(-x)))) for i, x in enumerate(rng.standard_normal(600))]
    return spark.createDataFrame(made, "id long, x double, c string, y int")


def test_trials_equal_fits_of_their_own(rows):
    """A batch of trials in shared aggregates, against each trial's model run alone over the same inner folds."""
    tuned = tuning.tune(rows, "y", "id", ["x"], ["c"], trials=3, batch=3, k=3)
    got = tuned.orderBy("trial").collect()
    for r in got[:2]:
        _, scored = benchmark.run(rows, "y", "id", ["x"], ["c"], [benchmark.PlainLogit(c=r.c)], k=3, seed=42)
        assert r.auc == pytest.approx(scored.agg(F.avg("auc")).first()[0], abs=1e-9)
    again = tuning.tune(rows, "y", "id", ["x"], ["c"], trials=3, batch=3, k=3).orderBy("trial").collect()
    assert again == got and tuning.best(tuned)["c"] == max(got, key=lambda r: (r.auc, -r.trial)).c


def test_boosted_trials(rows):
    space = tuning.LEAFWISE | {"trees": Range(2, 4, whole=True)}
    tuned = tuning.tune(rows, "y", "id", ["x"], ["c"], "leafwise", trials=3, batch=2, k=2, space=space)
    assert tuned.count() == 3 and tuned.agg(F.min("auc")).first()[0] > 0.55
    assert set(tuning.best(tuned)) == set(space)
