"""Line dedup by levelled sorted runs of line hashes.

The corpus arrives in batches. Every batch is reduced to one row per line key and merge-joined with each sorted run
that is there: a key that a run holds becomes an addition to that run, and what no run holds becomes a new run. So the
runs stay disjoint, and every key has its number of documents and its largest document in the one run that holds it.
Runs are bucketed and sorted by the 128-bit key hash, as are the additions (both are parts of one table a batch), so
that merges need no exchange and no sort on the side of the runs. When a level has ``fanout`` runs, they take in
their additions and are compacted into one run of the next level.

Only key hashes, document ids and line positions are shuffled by key. Lines that a large share of the documents
hold are resolved by a broadcast table whose row count is bounded by construction (a key with more than
1/10,000 of all occurrences can exist at most 10,000 times); all other keys go through an ordinary join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.llm.common import ascii_lower, discard, let, merged, release, scratch, shuffle_partitions, stored, strip, unused

KEY = ["h1", "h2"]
HOT_KEYS = 10_000
HOT_LEAST = 1_000
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Let scans of bucketed tables with one file a bucket report the order of their rows."""
    before = spark.conf.get(ORDERED, "false")
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


@dataclass(eq=False)
class Run:
    """A part of a table of sorted keys, and the parts of later tables that add to it."""

    name: int
    table: str
    additions: list[str] = field(default_factory=list)


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs, max_doc) with disjoint keys: ``levels[i]`` lists the runs of level i."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[Run]] = [[]]
        self.paths: dict[str, str] = {}
        self.made = 0

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _part(self, table: str, run: Run) -> DataFrame:
        return self.spark.table(table).where(F.col("run") == run.name).select(*KEY, "n_docs", "max_doc")

    def contents(self, run: Run) -> DataFrame:
        """The keys of a run with all that was added to them; merge joins of sorted buckets."""
        rows = self._part(run.table, run)
        for table in run.additions:
            more = self._part(table, run).select(*KEY, F.col("n_docs").alias("more"), F.col("max_doc").alias("top"))
            rows = rows.join(more.hint("merge"), KEY, "left").select(
                *KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "top").alias("max_doc")
            )
        return rows

    def add(self, batch: DataFrame) -> None:
        """``batch``: one row (h1, h2, n_docs, max_doc) for each key of a new batch of documents."""
        fresh = self._fresh()
        owner = F.lit(None).cast("int")
        rows = batch
        for run in self.runs():
            mark = f"in_{run.name}"
            rows = rows.join(self._part(run.table, run).select(*KEY, F.lit(run.name).alias(mark)).hint("merge"), KEY, "left")
            owner = F.coalesce(owner, F.col(mark))
        fresh.table = self._write(rows.withColumn("run", F.coalesce(owner, F.lit(fresh.name))))
        for run in self.runs():
            run.additions.append(fresh.table)
        self.levels[0].append(fresh)
        self._compact()

    def _fresh(self) -> Run:
        self.made += 1
        return Run(self.made, "")

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, "line-run")
        (
            rows.select(*KEY, "n_docs", "max_doc", "run").write.partitionBy("run").bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", self.paths[name]).saveAsTable(name)
        )
        return name

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) < self.fanout:
                return
            into = self._fresh()
            rows = reduce(DataFrame.unionByName, [self.contents(run) for run in level])
            into.table = self._write(rows.withColumn("run", F.lit(into.name)))
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(into)
            level.clear()
            self._drop_unread()

    def _drop_unread(self) -> None:
        read = {table for run in self.runs() for table in (run.table, *run.additions)}
        for name in [n for n in self.paths if n not in read]:
            self.spark.sql(f"DROP TABLE {name}")
            discard(self.spark, self.paths.pop(name))

    def shared(self, min_docs: int) -> DataFrame:
        """The keys that at least ``min_docs`` documents hold, read run by run."""
        return reduce(DataFrame.unionByName, [self.contents(run).where(F.col("n_docs") >= min_docs) for run in self.runs()])

    def close(self) -> None:
        self.levels = [[]]
        self._drop_unread()


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_occurrences(text: Column, min_chars: int) -> Column:
    """array<struct<h1,h2,pos,first>>: keys of the lines long enough, sorted; ``first`` marks one row a key."""
    long_enough = F.filter(
        F.transform(_lines(text), lambda line, pos: F.struct(strip(line).alias("s"), pos.alias("pos"))),
        lambda line: F.char_length(line["s"]) >= min_chars,
    )
    hashed = F.sort_array(
        F.transform(
            long_enough,
            lambda line: let(
                ascii_lower(line["s"]),
                lambda key: F.struct(
                    F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), line["pos"].alias("pos")
                ),
            ),
        )
    )
    return let(
        hashed,
        lambda rows: F.transform(
            rows,
            lambda row, i: F.struct(
                row["h1"].alias("h1"), row["h2"].alias("h2"), row["pos"].alias("pos"),
                F.when(i == 0, True).otherwise(
                    (row["h1"] != F.get(rows, i - 1)["h1"]) | (row["h2"] != F.get(rows, i - 1)["h2"])
                ).alias("first"),
            ),
        ),
    )


def _without(lines: Column, dropped: Column) -> Column:
    """The lines but those at the sorted positions, by copying the stretches between: linear in the lines."""
    bounds = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    return let(
        F.struct(lines.alias("lines"), bounds.alias("at"), F.size(dropped).alias("n")),
        lambda x: F.flatten(
            F.transform(
                F.sequence(F.lit(0), x["n"]),
                lambda i: F.slice(x["lines"], x["at"][i] + 2, x["at"][i + 1] - x["at"][i] - 1),
            )
        ),
    )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 3,
) -> DataFrame:
    """Drop lines that many documents share, except in the document with the largest id.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of at least ``min_chars``
    code points that at least ``min_docs`` rows hold lose all their lines but those of the largest id.

    Returns every column of ``docs`` with the text replaced by the kept lines, and ``n_lines`` (before) and
    ``n_dropped``; input columns of these names are replaced.

    Defined results: a NULL or empty text is one empty line and never loses it. Texts of any length are read whole.
    Rows of equal id are one document; they all keep the line if the id is the largest. Rows with a NULL id are one
    document too, below every id; if no other row holds a line, all of them keep it. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    id_, text_ = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    base = docs.select(id_.alias("doc_id"), text_.alias("text"))
    found = stored(
        base.select(
            "doc_id",
            F.xxhash64("text").alias("text_hash"),
            # all rows of an id are in one batch, so that batches can count documents
            F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
            F.inline(line_occurrences(F.col("text"), min_chars)),
        ),
        "line-keys",
        "batch",
    )
    runs = LineRuns(spark, fanout)
    with ordered_scans(spark):
        for batch in range(batches):
            runs.add(
                found.where((F.col("batch") == batch) & F.col("first"))
                # by document first: a line that very many documents hold is summed in parts
                .groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
                .groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
            )
        shared = stored(runs.shared(min_docs), "line-shared")
    runs.close()

    hot_from = max(HOT_LEAST, (found.where("first").count()) // HOT_KEYS)
    hot = F.broadcast(
        shared.where(F.col("n_docs") > hot_from).select(*KEY, F.lit(True).alias("hot"), F.col("max_doc").alias("hot_max"))
    )
    placed = found.drop("first", "batch").join(hot, KEY, "left")
    loses = lambda top: F.coalesce(F.col("doc_id") < F.col(top), F.col("doc_id").isNull() & F.col(top).isNotNull())
    at = ["doc_id", "text_hash", "pos"]
    own_hash, own_id, hash_, dropped = unused(docs, "text_hash", "id", "hash", "dropped")
    drops = stored(
        placed.where(F.col("hot") & loses("hot_max")).select(*at)
        .unionByName(
            placed.where(F.col("hot").isNull())
            .join(shared.where(F.col("n_docs") <= hot_from).select(*KEY, "max_doc"), KEY)
            .where(loses("max_doc")).select(*at)
        )
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
        .select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(hash_), F.col("dropped").alias(dropped)),
        "line-drops",
    )
    release(found, shared)
    joined = docs.withColumn(own_hash, F.xxhash64(text_)).join(
        drops, id_.eqNullSafe(F.col(own_id)) & (F.col(own_hash) == F.col(hash_)), "left"
    )
    kept = F.when(F.col(dropped).isNull(), F.coalesce(text_, F.lit(""))).otherwise(
        F.array_join(_without(_lines(text_), F.col(dropped)), "\n")
    )
    return merged(
        joined,
        {
            text_col: kept,
            "n_lines": F.size(_lines(text_)).cast("long"),
            "n_dropped": F.coalesce(F.array_size(dropped), F.lit(0)).cast("long"),
        },
    ).drop(own_hash, own_id, hash_, dropped)
