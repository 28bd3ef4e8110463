"""Tables written to the folder that driver and executors share, so that lineage is cut and lost executors cost no rerun."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again; only a ``local`` master may go without that setting."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lendframe.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lendframe-")
        spark.conf.set("lendframe.scratch.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames of ``stored`` that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(frame._scratch_path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context: they may run where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_lendframe_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="lendframe-")) / f"lendframe_{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(target))
    context._lendframe_shipped = True
