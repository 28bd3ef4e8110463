"""Trend checks of the AIC steppers against rank correlations and default rates taken in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.operators import selection
from lendframe.operators.glm import Logit


@pytest.fixture(scope="module")
def book(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(4000):
        x, g, w = rng.normal(), str(rng.choice(["a", "b", "c"])), float(rng.integers(0, 4))
        level = {"a": 0.0, "b": 0.8, "c": 1.6}[g]
        y = int(rng.random() < 1 / (1 + np.exp(1.0 - 0.9 * x - level + 0.4 * w)))
        odd = None if i % 31 == 0 else float("nan") if i % 37 == 0 else float("inf") if i % 41 == 0 else x
        # double holds what x and its noise share: with x in the model its coefficient turns
        rows.append((i, y, x, odd, 0.7 * x + 0.3 * rng.normal() - 0.25 * y, w, g))
    return spark.createDataFrame(rows, "id long, y int, x double, odd double, double double, w double, g string")


def test_concordance_equals_ranks(book):
    columns = ["x", "odd", "w"]
    table = book.toPandas()
    got = selection.concordance(book, "y", columns)
    for c in columns:
        own = table[np.isfinite(table[c])] if c != "odd" else table[~table[c].isna()]
        bad, good = own.loc[own.y == 1, c].to_numpy(), own.loc[own.y == 0, c].to_numpy()
        won = (bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2 - 0.5
        assert got[c] == pytest.approx(won, abs=1e-12)
    assert np.sign(got["x"]) == np.sign(table["x"].corr(table["y"], method="pearson"))
    assert selection.concordance(book.where("y = 1"), "y", ["x"]) == {}


def test_terms_go_with_the_data(book):
    """A factor whose coefficient turns against its rank correlation is refused, and any sign takes it."""
    free = selection.step_fwdr(book, "y", ["x", "double", "w"], trend=False)
    held = selection.step_fwdr(book, "y", ["x", "double", "w"])
    assert "double" in free.selected and free.model.coefficients["double"] < 0 < selection.concordance(book, "y", ["double"])["double"]
    assert set(held.selected) == {"x", "w"} and held.model.coefficients["x"] > 0 > held.model.coefficients["w"]
    grouped = selection.step_rpcr(book, "y", {"w": 1, "double": 2, "x": 1})
    assert set(grouped.selected) == {"x", "w"}


def test_dummies_keep_the_order_of_rates(book):
    got = selection.step_fwdr(book, "y", ["x", "g"], coding="mixed")
    assert set(got.selected) == {"x", "g"}
    rates = {r.g: r.dr for r in book.groupBy("g").agg(F.avg("y").alias("dr")).collect()}
    assert (rates["a"] < rates["b"] < rates["c"]) and 0 < got.model.coefficients["g__b"] < got.model.coefficients["g__c"]


@pytest.mark.parametrize(("slopes", "ok"), [((0.2, 0.9), True), ((0.9, 0.2), False), ((-0.2, 0.9), False), ((0.5, 0.5), False)])
def test_order_agreement(slopes, ok):
    fit = Logit(["g__b", "g__c"], dict(zip(["g__b", "g__c"], slopes)), 0.0, np.eye(3), 1.0, 2.0, 10, True)
    assert selection.consistent(fit, ["g__b", "g__c"], {"g__b": 0.1, "g__c": 0.3}) is ok
    assert selection.consistent(fit, ["g__b", "g__c"], None)


def test_start_terms_are_checked_unless_told_not_to(book):
    broken = selection.step_fwdr(book, "y", ["w"], start=["x", "double"])
    assert broken.selected == ["x", "double"]  # nothing can be added to a model that fails its checks
    assert "w" in selection.step_fwdr(book, "y", ["w"], start=["x", "double"], check_start=False).selected


def test_wrong_signs_are_swapped_for_the_next_in_rank(book):
    fit = selection.Fitter(book, "y", {c: [c] for c in ["x", "double", "w"]})
    names, model, said = selection.swap_search(fit, ["x", "double", "w"], ["x", "double"], 0.05, 1)
    assert names == ["x"] and said[0] == "double: wrong sign, swapped for w"
    names, model, said = selection.swap_search(fit, ["x", "w", "double"], ["x", "w"], 0.05, 0)
    assert names == ["x", "w"] and said == []
