"""Stability monitoring of a stream: windowed counts by bin, from which the index against a base follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendframe.operators.metrics import cut


def binned_counts(stream: DataFrame, ts: str, value: str, edges: list[float], window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by event-time window and bin; late rows are taken up to the watermark. Batch tables work too."""
    return (
        stream.withWatermark(ts, late).withColumn("bin", cut(F.col(value), edges, right=False))
        .groupBy(F.window(ts, window).alias("w"), "bin").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "bin", "n")
    )


def window_psi(counts: DataFrame, base: dict[int, float]) -> DataFrame:
    """The index of each window against base shares by bin."""
    pairs = [F.lit(x) for k, v in base.items() for x in (k, float(v))]
    share = F.col("n") / F.sum("n").over(Window.partitionBy("window_start"))
    rows = counts.withColumns({"share": share, "base": F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("bin")), F.lit(0.0))})
    floor = F.lit(1e-10)
    part = (F.col("share") - F.col("base")) * F.log(F.greatest("share", floor) / F.greatest("base", floor))
    return rows.withColumn("part", part).groupBy("window_start").agg(F.sum("part").alias("psi"), F.sum("n").alias("n"))
