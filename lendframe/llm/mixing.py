"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 32-bit hash of its id. A source's budget is met by a hash threshold: all documents below
it are taken. The threshold is found without sorting documents: sizes are summed by source and by the leading
bits of the hash, a running sum finds the bucket in which the budget ends, and only that boundary bucket is
summed again by the next bits, until all bits are used. The thresholds are nested: a larger budget takes a
superset. Partial sums make a hot source cost no more than any other; per source a level shuffles at most
2**11 sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.llm.common import WORD_GAP, let, merged, release, stored, strip, unused

#: Leading hash bits used up by each level.
LEVELS = (11, 11, 10)
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def n_words(text: Column) -> Column:
    return let(
        strip(F.coalesce(text, F.lit(""))),
        lambda t: F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, WORD_GAP, -1))),
    ).cast("long")


def id_hash(key: Column) -> Column:
    """32 bits of an MD5: other engines can compute it too."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources: one row (source, source_size) each. Adds ``target``: the budget dealt by weight and capped.

    Sources reach their cap in the order of cap / weight; for the first k capped, the level of the others is
    (budget - caps) / their weights, and the right k is the first whose next source stays at or under its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(most).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(from_here).alias("open_weight"),
    ).withColumn("fits", F.col("ratio") * F.col("open_weight") >= F.col("left"))
    level = F.min_by(F.struct("left", "open_weight"), F.when(F.col("fits"), F.struct("ratio", F.col("source").isNull(), "source"))).over(everything)
    return (
        levels.withColumn("level", level)
        .withColumn("target", F.least("cap", F.coalesce(F.col("level.left") * F.col("weight") / F.col("level.open_weight"), F.col("cap"))))
        .select("source", "source_size", "target")
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows: (source, size, hash); budgets: (source, budget). One row (source, threshold): a smaller hash is taken.

    The boundary hash value itself is taken when that comes nearer to the budget than leaving it.
    """
    bits, used = sum(LEVELS), 0
    state = budgets.select("source", F.floor("budget").alias("left"), F.lit(1).cast("long").alias("prefix"))
    for width in LEVELS:
        part = rows
        if used:
            part = rows.withColumn("prefix", F.shiftright("hash", bits - used)).join(
                state.select(F.col("source").alias("s"), F.col("prefix").alias("p")),
                F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p")),
            )
        used += width
        sums = part.groupBy("source", F.shiftright("hash", bits - used).alias("bucket")).agg(F.sum("size").alias("size"))
        found = (
            sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
            .join(state.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(
                F.sum(F.when(F.col("upto") <= F.col("left"), F.col("size"))).alias("below"),
                F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "size"))).alias("boundary"),
            )
            .select(F.col("source").alias("s"), "below", "boundary")
        )
        before, state = state, stored(
            state.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source",
                (F.col("left") - F.coalesce("below", F.lit(0))).alias("left"),
                # without a boundary the threshold lies past every hash
                F.coalesce("boundary.bucket", F.shiftleft("prefix", width)).alias("prefix"),
                F.col("boundary.size").alias("boundary_size"),
            ),
            "mix-level",
        )
        if used > width:
            release(before)
    nearer = F.coalesce(2 * F.col("left") > F.col("boundary_size"), F.lit(False))
    return state.select("source", (F.col("prefix") + nearer.cast("long")).alias("threshold"))


def plan(
    docs: DataFrame,
    size_col: str,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
) -> DataFrame:
    """One row (source, source_size, target, whole, threshold) a source: how often all its documents are taken, and below
    which id hash once more. ``docs`` is read once a level, so sizes that are dear to compute should be stored."""
    rows = docs.select(
        F.col(f"`{source_col}`").alias("source"), F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)).alias("size"),
        id_hash(F.col(f"`{id_col}`")).alias("hash"),
    )
    dealt = stored(
        targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    cuts = thresholds(rows, dealt.select("source", "budget")).select(F.col("source").alias("cut_source"), "threshold")
    return dealt.join(cuts, F.col("source").eqNullSafe(F.col("cut_source"))).select("source", "source_size", "target", "whole", "threshold")


def taken(docs: DataFrame, made: DataFrame, id_col: str = "doc_id", source_col: str = "source", most: int = MOST) -> DataFrame:
    """Every column of ``docs`` and ``source_size``, ``target`` and ``copies``, by what ``plan`` made."""
    names = unused(docs, "source", "source_size", "target", "whole", "threshold")
    by, total, target, whole, threshold = map(F.col, names)
    joined = docs.join(made.select(*[F.col(c).alias(n) for c, n in zip(made.columns, names)]), F.col(f"`{source_col}`").eqNullSafe(by))
    copies = whole + ((id_hash(F.col(f"`{id_col}`")) < threshold) & (whole < most)).cast("long")
    return merged(joined, {"source_size": total, "target": target, "copies": copies}).drop(*names)


def mix(
    docs: DataFrame,
    size_col: str,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
) -> DataFrame:
    """Deal ``share`` times all sizes to the sources by weight and choose the documents that fill each budget.

    Sources in code point order (NULL last) have the weights in turn; a target stops at ``most`` times its source's
    size and the excess is dealt again by weight. A source takes all its documents floor(target / size) times and,
    for the rest of its budget, once more those whose id hash lies below the source's threshold.

    Returns every column of ``docs`` and ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size times
    copies); input columns of these names are replaced.

    Defined results: a NULL source is a source of its own, a NULL size counts 0, a NULL id hashes like an empty
    one. Rows with equal ids have equal hashes and are taken together. A source without words has the target 0. An
    empty table gives an empty result. Reruns agree: nothing depends on row order or partitions.
    """
    (size,) = unused(docs, "size")
    sized = docs.withColumn(size, F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)))
    mixed = taken(sized, plan(docs, size_col, id_col, source_col, weights, share, most), id_col, source_col, most)
    return merged(mixed, {"size": F.col(size), "taken": F.col(size) * F.col("copies")}).drop(size)
