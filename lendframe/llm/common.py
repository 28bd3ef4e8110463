"""What the operators of this subpackage share: scratch tables, text keys, and let-bindings for arrays."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every contract here: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a ``local`` master may go without that setting: it gets a temporary folder, kept in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lendframe.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lendframe-")
        spark.conf.set("lendframe.scratch.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once a context: they may run where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_lendframe_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="lendframe-"), f"lendframe_{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(target)
    context._lendframe_shipped = True


def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage is cut and survives lost executors.

    What a returned DataFrame reads has to stay; ``release`` deletes what nothing reads any more.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete the scratch tables behind frames that ``stored`` returned."""
    for frame in frames:
        discard(frame.sparkSession, frame._scratch_path)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of DataFrames that nothing refers to any more: it does so when garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no returned DataFrame reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key is hot if it has more than this share of all rows (so there are at most so many hot keys) and more than the floor.
HOT_SHARE, HOT_FLOOR = 4096, 256


def hot_from(total: int) -> int:
    return max(HOT_FLOOR, total // HOT_SHARE)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], n_rows: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key, where a few keys may hold most of the rows.

    n_rows: the column of ``table`` with the number of rows that a key has; total: their sum, or more. Hot keys, of
    which there are at most ``HOT_SHARE`` whatever the size (or total / HOT_FLOOR if that is less), are joined by
    broadcast where the rows are; the others by a shuffle. NULL keys match nothing.
    """
    least = hot_from(total)
    out = [c for c in table.columns if c not in keys]
    flag, *held = unused(rows, "hot", *[f"hot_{c}" for c in out])
    hot = F.broadcast(table.where(F.col(n_rows) > least).select(*keys, F.lit(True).alias(flag), *[F.col(c).alias(h) for c, h in zip(out, held)]))
    near = rows.join(hot, keys, "left")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    one = near.where(F.col(flag)).select(*kept, *[F.col(h).alias(c) for c, h in zip(out, held)])
    two = near.where(F.col(flag).isNull()).select(*kept).join(table.where(F.col(n_rows) <= least), keys)
    return one.unionByName(two)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, node, tie, ...) with each row's rank in its tree by ``order``, node and tie, and the tree's size n.

    Ranks come from a range partitioning: an index inside the partition, and starts from counts of (partition, tree).
    """
    keys = ["tree", *order, "node", "tie"]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    indexed = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranks")
    runs = indexed.groupBy("part", "tree").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")
    starts = runs.select(
        F.col("part").alias("part_"), F.col("tree").alias("tree_"), F.sum("here").over(whole).alias("n"),
        (F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here") - F.col("first")).alias("start"),
    )
    joined = indexed.join(starts, (F.col("part") == F.col("part_")) & F.col("tree").eqNullSafe(F.col("tree_")))
    return joined.withColumn("pos", F.col("start") + F.col("at")).drop("part", "part_", "tree_", "at", "start", "tie")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; all-ASCII strings take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The array of ``[^\\x20\\x09-\\x0D]+`` runs of a text; NULL and blank texts give an empty array."""
    return let(
        strip(F.coalesce(text, F.lit(""))),
        lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP, -1)),
    )


def merged(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """All columns of ``df`` and the outputs; an output replaces any input column of its name."""
    taken = {name.lower() for name in outputs}
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken],
        *[value.alias(name) for name, value in outputs.items()],
    )


def runs_of(frames: Iterator, keys: list[str]) -> Iterator:
    """Join sorted pandas batches into one frame per run of equal keys; only one run is held at a time."""
    import numpy as np
    import pandas as pd

    held = []
    for frame in frames:
        if not len(frame):
            continue
        same = np.ones(len(frame) - 1, dtype=bool)
        for key in keys:
            column = frame[key].to_numpy()
            same &= column[1:] == column[:-1]
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(frame)]
        for start, stop in zip(cuts, cuts[1:]):
            piece = frame.iloc[start:stop]
            if held and any(held[-1][key].iat[-1] != piece[key].iat[0] for key in keys):
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(piece)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)
