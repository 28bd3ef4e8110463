"""Special cases: NULL, NaN, infinities and user codes form a domain value of their own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

SC_LABEL = "SC"
SC_THRESHOLD = 0.2
MIN_PCT_OBS = 0.05
MIN_AVG_RATE = 0.01
P_VALUE = 0.05
TOLERANCE = 1e-8
FLOOR = 1e-10


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL, doubles for numbers and strings otherwise."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, (DoubleType, FloatType)):
        column = F.nanvl(column, F.lit(None))
    return column.cast("double") if isinstance(kind, NumericType) else column.cast("string")


def is_special(value: Column, codes: Iterable = (), infinities: bool = True, numeric: bool = True) -> Column:
    """NULL, a user code, or (for numbers) infinite."""
    out = value.isNull()
    codes = list(codes)
    if codes:
        out = out | F.coalesce(value.isin(codes), F.lit(False))
    if infinities and numeric:
        # a code of one infinity leaves the other a value
        signs = [v for v in (float("inf"), float("-inf")) if v in codes] or [float("inf"), float("-inf")]
        out = out | F.coalesce(value.isin(signs), F.lit(False))
    return out


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"not in the table: {', '.join(missing)}")


def require_binary(df: DataFrame, target: str) -> None:
    """One small aggregate: the target may hold 0, 1 and NULL only."""
    require(df, target)
    bad = df.select(F.max(F.when(F.col(target).isNotNull() & ~F.col(target).isin(0, 1), 1))).first()[0]
    if bad:
        raise ValueError(f"{target} must hold 0 and 1 only")


def counted(condition: Column, times: str | None) -> Column:
    """How many rows fulfil the condition, where a row stands for as many equal ones as ``times`` says."""
    return F.coalesce(F.sum(F.when(condition, F.col(f"`{times}`"))), F.lit(0)) if times else F.count_if(condition)


def long_form(df: DataFrame, names: list[str], *keep: str, numeric: bool) -> DataFrame:
    """(kept columns, rf, value): all columns in one pass, so that one shuffle serves them all."""
    rows = F.array(*[F.struct(F.lit(n).alias("rf"), clean(df, n).cast("double" if numeric else "string").alias("value")) for n in names])
    return df.select(*[F.col(f"`{k}`") for k in keep], F.inline(rows))
