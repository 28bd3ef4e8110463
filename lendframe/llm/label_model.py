"""Weak supervision: from votes of rules that may abstain to a posterior probability, by expectation-maximisation."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 100


def pattern(votes: Sequence[Column]) -> Column:
    """One number for a row of votes (-1 bad, 0 abstains, 1 good): base 3, first rule leading."""
    out = F.lit(0)
    for vote in votes:
        out = out * 3 + (vote + 1)
    return out.cast("int")


def unpacked(number: int, rules: int) -> list[int]:
    digits = []
    for _ in range(rules):
        number, digit = divmod(number, 3)
        digits.append(digit - 1)
    return digits[::-1]


#: What is believed of any rule before the data: chances of the votes bad, none, good of a bad and of a good row, and
#: the share of all rows that this belief weighs.
BELIEF = ((0.35, 0.55, 0.10), (0.02, 0.53, 0.45))
BELIEF_SHARE = 0.05


def fit(counts: dict[int, int], rules: int, prior: float = 0.85) -> dict[int, float]:
    """The posterior probability of good for each pattern that occurs.

    counts: how many rows have each pattern, at most 3**rules of them. A rule has its own chance of each vote for
    good and for bad rows; rules are taken as independent given the class. A weak belief that a vote is more often
    right than wrong tells the two classes apart and keeps other divisions of the corpus, such as by length, out.
    """
    rows = [(unpacked(p, rules), p, n) for p, n in sorted(counts.items())]
    weight = BELIEF_SHARE * sum(counts.values()) + 1
    chances = [[list(BELIEF[side]) for _ in range(rules)] for side in range(2)]
    share, good = prior, {}
    for _ in range(ROUNDS):
        logs = [[[math.log(x) for x in votes] for votes in side] for side in chances]
        lean, moved = math.log(share / (1 - share)), 0.0
        for votes, p, _ in rows:
            odds = lean + sum(logs[1][r][v + 1] - logs[0][r][v + 1] for r, v in enumerate(votes))
            now = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            moved = max(moved, abs(now - good.get(p, -1.0)))
            good[p] = now
        if moved < 1e-7:
            break
        mass = [weight, weight]
        tally = [[[weight * x for x in BELIEF[side]] for _ in range(rules)] for side in range(2)]
        for votes, p, n in rows:
            for side, part in ((1, good[p] * n), (0, (1 - good[p]) * n)):
                mass[side] += part
                for rule, vote in enumerate(votes):
                    tally[side][rule][vote + 1] += part
        chances = [[[x / mass[side] for x in votes] for votes in tally[side]] for side in range(2)]
        good_mass, bad_mass = mass[1] - weight + weight * prior, mass[0] - weight + weight * (1 - prior)
        share = good_mass / (good_mass + bad_mass)
    return good


def pattern_counts(votes: DataFrame, column: str) -> dict[int, int]:
    """At most 3**rules rows come to the driver, whatever the size of the table."""
    return {row[0]: row[1] for row in votes.groupBy(column).count().collect()}


def table(spark: SparkSession, posterior: dict[int, float]) -> DataFrame:
    """(pattern, posterior) of what ``fit`` returned: a literal in the plan."""
    rows = json.dumps([{"pattern": p, "posterior": q} for p, q in sorted(posterior.items())])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<pattern:int,posterior:double>>")))
