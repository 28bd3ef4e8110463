"""Quality rules combined by weak supervision.

Each rule looks at a few counts of a text and votes good, bad, or abstains. Rows with the same votes are counted
over the whole table, expectation-maximisation on these counts estimates how accurate each rule is, and the
posterior probability of good decides, instead of a chain of rules that all must pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.llm import label_model
from lendframe.llm.common import let, merged, stored, strip, unused, words

#: Frequent function words of the corpus languages (fixed values).
FUNCTION_WORDS = (
    "the of and to in is that for on with as was by this are it "
    "de la le les des et en un une que qui du el los las y por con para se "
    "der die das und ist von mit zu den ein eine nicht für auf im"
).split()
WINDOW = 8


def _pairs(hashes: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` later."""
    return let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))))


def repeated_words(tokens: Column) -> Column:
    """How many words lie in 8-word windows that occur at least twice; three doublings hash every window."""
    windows = _pairs(_pairs(_pairs(F.transform(tokens, lambda w: F.xxhash64(w)), 1), 2), 4)

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            ordered,
            lambda rows: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            rows,
                            lambda row, k: F.struct(
                                row["i"].alias("i"),
                                (
                                    F.coalesce(F.get(rows, k - 1)["h"] == row["h"], F.lit(False))
                                    | F.coalesce(F.get(rows, k + 1)["h"] == row["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda row: row["twice"],
                    ),
                    lambda row: row["i"],
                )
            ),
        )
        lengths = let(places, lambda at: F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))))
        return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)

    return F.when(F.size(tokens) <= WINDOW, F.lit(0)).otherwise(
        let(
            F.slice(windows, F.lit(1), F.greatest(F.size(tokens) - (WINDOW - 1), F.lit(0))),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
        )
    )


def _without(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, what, ""))


def measures(text: Column, repeats: bool = True) -> Column:
    """A struct of the counts that the rules look at."""
    whole = F.coalesce(text, F.lit(""))

    def of(x: Column) -> Column:
        lines = F.filter(F.split(x["t"], "\n", -1), lambda line: F.length(strip(line)) > 0)
        return let(
            F.struct(x["t"].alias("t"), x["w"].alias("w"), lines.alias("l")),
            lambda y: F.struct(
                F.size(y["w"]).cast("long").alias("n_words"),
                F.length(F.array_join(y["w"], "")).cast("long").alias("word_chars"),
                _without(y["t"], "[#*$%&|<>]").cast("long").alias("n_symbols"),
                (F.size(y["l"]) - F.size(F.array_distinct(y["l"]))).cast("long").alias("n_dup_lines"),
                (repeated_words(y["w"]) if repeats else F.lit(0)).cast("long").alias("n_repeat_words"),
                F.size(y["l"]).alias("n_lines"),
                F.size(F.array_distinct(y["w"])).alias("n_distinct"),
                _without(y["t"], "[A-Z]").alias("n_upper"),
                _without(y["t"], "[.!?]").alias("n_stops"),
                _without(y["t"], "!").alias("n_bangs"),
                _without(y["t"], "[0-9]").alias("n_digits"),
                F.size(F.array_intersect(F.array(*[F.lit(w) for w in FUNCTION_WORDS]), y["w"])).alias("n_function"),
            ),
        )

    return let(F.struct(whole.alias("t"), words(text).alias("w")), of)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), -1).when(F.coalesce(good, F.lit(False)), 1).otherwise(0)


def votes(m: Column) -> list[Column]:
    """The rules. Most only speak up when something is wrong; a few vouch for ordinary prose."""
    n, chars, never = m["n_words"], m["word_chars"], F.lit(False)
    return [
        _vote(n < 20, never),
        _vote((chars < 3 * n) | (chars > 7 * n), never),
        _vote(20 * m["n_symbols"] > n, m["n_symbols"] == 0),
        _vote(10 * m["n_dup_lines"] > 3 * m["n_lines"], never),
        _vote(100 * m["n_repeat_words"] > 15 * n, never),
        _vote(5 * m["n_upper"] > chars, never),
        _vote((n >= 60) & (100 * m["n_stops"] < 3 * n), (100 * m["n_stops"] >= 3 * n) & (10 * m["n_stops"] <= 3 * n)),
        _vote(10 * m["n_bangs"] > n, never),
        _vote(5 * m["n_digits"] > chars, never),
        _vote((n >= 40) & (m["n_function"] < 5), m["n_function"] >= 8),
        _vote((n >= 40) & (5 * m["n_distinct"] < n), (10 * m["n_distinct"] >= 3 * n) & (n >= 40)),
    ]


def judge(docs: DataFrame, text_col: str = "text", keep_text: bool = False, least: float = 0.5) -> DataFrame:
    """Every column of ``docs`` (the text only if ``keep_text``), the counts, ``posterior``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in repeated 8-word windows. ``kept``: not
    base_failed and a posterior of at least ``least``. Input columns of the same names are replaced.

    Defined results: a NULL or blank text has no words, fails the base rules and is not kept. Texts of any length are
    read whole. Rows are judged by
    themselves, so repeated rows get equal results; repeats do count in the estimation. An empty table gives an
    empty result.
    """
    held, voted, pattern, chance = unused(docs, "m", "votes", "pattern", "posterior")
    m = F.col(held)
    measured = docs.withColumn(held, measures(F.col(f"`{text_col}`"))).withColumn(voted, label_model.pattern(votes(m)))
    measured = stored(measured if keep_text else measured.drop(text_col), "quality-measures")
    posterior = label_model.fit(label_model.pattern_counts(measured, voted), len(votes(m)))
    table = label_model.table(docs.sparkSession, posterior).select(F.col("pattern").alias(pattern), F.col("posterior").alias(chance))
    # a row for each pattern of votes that occurs: at most 3 to the number of rules
    joined = measured.join(F.broadcast(table), F.col(voted) == F.col(pattern))
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return merged(
        joined,
        {name: m[name] for name in names}
        | {"posterior": F.col(chance), "base_failed": failed, "kept": ~failed & (F.col(chance) >= least)},
    ).drop(held, voted, pattern, chance)
