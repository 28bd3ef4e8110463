"""The power of the Hosmer-Lemeshow test against sums over all outcomes, and against draws."""

import itertools
import math

import numpy as np
import pytest

from lendframe.functions.dist import chi2_ppf
from lendframe.operators import validation

SCHEMA = "rating string, no long, nb long, pdc double"


def every_outcome(rows):
    limit, total = chi2_ppf(0.95, len(rows)), 0.0
    chance = lambda n, p, d: math.comb(n, d) * p**d * (1 - p) ** (n - d)
    for counts in itertools.product(*(range(n + 1) for _, n, _, _ in rows)):
        stat = sum((d - n * p) ** 2 / (n * p * (1 - p)) for d, (_, n, _, p) in zip(counts, rows))
        if stat > limit:
            total += math.prod(chance(n, nb / n, d) for d, (_, n, nb, _) in zip(counts, rows))
    return total


@pytest.mark.parametrize("rows", [[("a", 30, 9, 0.2)], [("a", 20, 5, 0.1), ("b", 15, 6, 0.3), ("c", 12, 3, 0.25)]])
def test_bounds_hold_the_exact_power(spark, rows):
    low, high = validation.power_hl_bounds(spark.createDataFrame(rows, SCHEMA))
    exact = every_outcome(rows)
    assert low - 1e-9 <= exact <= high + 1e-9 and high - low < 0.01
    assert validation.power_hl(spark.createDataFrame(rows, SCHEMA)) == pytest.approx(exact, abs=(high - low) / 2 + 1e-9)


def test_large_grades_agree_with_draws(spark):
    rows = [("a", 200_000, 4300, 0.021), ("b", 50_000, 2600, 0.051), ("c", 900, 99, 0.1)]
    low, high = validation.power_hl_bounds(spark.createDataFrame(rows, SCHEMA))
    rng = np.random.default_rng(1)
    stat = sum((rng.binomial(n, nb / n, 200_000) - n * p) ** 2 / (n * p * (1 - p)) for _, n, nb, p in rows)
    assert low - 0.005 < (stat > chi2_ppf(0.95, 3)).mean() < high + 0.005 and high - low < 0.005


def test_no_power_below_the_pd(spark):
    assert validation.power_hl(spark.createDataFrame([("a", 100, 5, 0.2)], SCHEMA)) is None
    assert validation.power_hl(spark.createDataFrame([("a", 100, 100, 0.2), ("b", 0, 0, 0.1)], SCHEMA)) == pytest.approx(1.0)
