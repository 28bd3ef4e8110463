"""A quality classifier trained without labels.

Overlapping heuristic labellers vote on every document; expectation-maximisation over the counts of their vote
patterns, taken from all documents, estimates how accurate each labeller is and gives every document a posterior
probability. The posteriors of a bounded sample train a linear scorer over hashed words and word shapes, and the
scorer decides on every document. Scoring reads a whole text; a document's score is the mean of its words' weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lendframe.llm import label_model
from lendframe.llm.common import merged, release, ship, stored, unused
from lendframe.llm.quality_rules import measures, votes

SLOTS = 1 << 16
#: The scorer is fitted on about so many documents at most, drawn by a hash over all of them.
SAMPLE = 8_000
KEPT_WORDS = 300_000
STEPS, RATE, PENALTY = 150, 0.3, 1e-4
SCALE = 8.0
_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)


def slots(word: bytes) -> tuple[int, int]:
    """The two features of a word: itself in lower case, and its shape with runs of one kind shortened."""
    shape = word.translate(_SHAPE)
    short = bytes(c for i, c in enumerate(shape) if i < 2 or not c == shape[i - 1] == shape[i - 2])
    return zlib.crc32(b"w" + word.lower()) % (SLOTS // 2), SLOTS // 2 + zlib.crc32(b"s" + short) % (SLOTS // 2)


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Share of each feature among a text's words."""
    words = Counter((text or "").encode("utf-8", "surrogatepass").split())
    total = sum(words.values())
    out: Counter = Counter()
    for word, n in words.items():
        for slot in slots(word):
            out[slot] += n
    keys = sorted(out)
    return keys, [out[k] / total for k in keys]


def train(lengths: np.ndarray, slot: np.ndarray, share: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch adaptive steps; deterministic.

    lengths: features of each row; slot and share: those of all rows, one after another.
    """
    rows = len(lengths)
    at = np.repeat(np.arange(rows, dtype=np.int32), lengths)
    used, column = np.unique(slot, return_inverse=True)
    column, value = column.astype(np.int32), share * np.float32(SCALE)
    weights, bias = np.zeros(len(used)), 0.0
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    # both classes weigh the same, so that a rare class isn't ignored
    part = min(max(target.mean(), 0.01), 0.99)
    balance = target * (0.5 / part) + (1 - target) * (0.5 / (1 - part))
    for step in range(1, STEPS + 1):
        score = np.bincount(at, weights[column] * value, rows) + bias
        error = (1 / (1 + np.exp(-score)) - target) * balance / rows
        gradient = np.append(np.bincount(column, error[at] * value, len(used)) + PENALTY * weights, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8) * (1 - step / (STEPS + 1))
        weights, bias = weights - move[:-1], bias - move[-1]
    full = np.zeros(SLOTS)
    full[used] = weights * SCALE
    return full, float(bias)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[bytes, float] = {}

    def __call__(self, text: str | None) -> float:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return 0.0
        total, known = 0.0, self.known
        for word in words:
            score = known.get(word)
            if score is None:
                one, two = slots(word)
                score = self.weights[one] + self.weights[two]
                if len(word) < 64:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[word] = score
            total += score
        return float(1 / (1 + np.exp(-np.clip(total / len(words) + self.bias, -500, 500))))


def labels(text) -> list:
    """The labellers: the quality rules but for the repeated windows; short texts are no reason to reject."""
    rules = votes(measures(text, repeats=False))
    return [*rules[1:4], *rules[5:]]


def labelled(docs: DataFrame, text_col: str, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (see ``train``) and posteriors of a bounded sample; the posteriors come from the votes on all documents."""
    docs = docs.select(F.col(f"`{text_col}`").alias("text"))
    own = label_model.pattern(labels(F.col("text")))
    hashed = F.xxhash64("text")
    drawn = F.pmod(hashed, F.lit(1 << 30))
    patterns = stored(docs.select(own.alias("votes"), hashed.alias("hash"), drawn.alias("draw")), "classifier-votes")
    rules = len(labels(F.col("text")))
    counts = label_model.pattern_counts(patterns, "votes")
    posterior = label_model.fit(counts, rules)
    total = sum(counts.values())
    if not total:
        return (np.zeros(0, dtype=np.int32),) * 2 + (np.zeros(0, dtype=np.float32), np.zeros(0))
    # rows of equal text have equal draws, and a text may make up a third of all rows: one row stands for a text. So the
    # bound is raised, where texts repeat, to what draws the sample from the distinct texts, in two steps.
    texts = patterns.agg(F.approx_count_distinct("hash")).first()[0]
    bound = (1 << 30) * min(1.0, sample / max(texts, 1))
    distinct = patterns.where(F.col("draw") < int(bound)).select("hash").distinct().count()
    bound = int(bound * min(1.0, sample / max(distinct, 1)))
    release(patterns)
    picked = docs.where(drawn < bound).dropDuplicates(["text"]).withColumn("votes", own)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [features(t) for t in frame["text"]]
            yield pd.DataFrame({"hash": frame["hash"], "votes": frame["votes"], "slots": [k for k, _ in made], "shares": [v for _, v in made]})

    rows = (
        picked.select(hashed.alias("hash"), "votes", "text")
        .mapInPandas(of, "hash long, votes int, slots array<int>, shares array<float>")
        .where(F.size("slots") > 0).orderBy("hash").toArrow()
    )
    if not rows.num_rows and texts > sample:
        raise ValueError("no text with words among those drawn for the classifier")
    lists = rows.column("slots").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    slot, share = lists.flatten().to_numpy().copy(), rows.column("shares").combine_chunks().flatten().to_numpy().copy()
    return lengths, slot, share, np.array([posterior[v] for v in rows.column("votes").to_pylist()], dtype=float)


def scorer(spark: SparkSession, weights: np.ndarray, bias: float):
    sent = spark.sparkContext.broadcast((weights.astype(np.float32), bias))

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(*sent.value)
        for texts in batches:
            yield pd.Series([own(t) for t in texts], dtype="float64")

    return score


def classify(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """Every column of ``docs`` and ``quality`` (probability of good) and ``kept`` (quality >= least).

    The labellers' accuracies come from all documents; the scorer is fitted on about ``sample`` documents.
    Input columns of these names are replaced.

    Defined results: a NULL or blank text has the quality 0 and is not kept. Texts of any length are read whole. Rows are scored by themselves, so
    repeated rows get equal scores. An empty table, or one of blank texts only, scores without a fit. Reruns agree.
    """
    spark = docs.sparkSession
    ship(spark)
    made = labelled(docs, text_col, sample)
    weights, bias = train(*made) if len(made[0]) else (np.zeros(SLOTS), 0.0)
    del made
    (name,) = unused(docs, "quality")
    scored = docs.withColumn(name, scorer(spark, weights, bias)(F.col(f"`{text_col}`")))
    return merged(scored, {"quality": F.col(name), "kept": F.col(name) >= least}).drop(name)
