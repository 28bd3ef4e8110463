"""A synthetic loans source, and the data dictionary with its code books."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.functions.draws import normal, uniform

#: Categories of the synthetic loans (fixed values).
OWNERSHIP = ["RENT", "MORTGAGE", "OWN"]
PURPOSES = ["debt_consolidation", "credit_card", "home_improvement", "major_purchase", "medical", "other"]
GRADES = ["A", "B", "C", "D", "E", "F", "G"]
ROLES = {"nominal": "nominal", "binary": "nominal", "categorical": "nominal", "ordinal": "ordinal", "continuous": "continuous", "numerical": "continuous", "target": "target"}


#: What the columns of the synthetic loans are (fixed values).
COLUMNS = {
    "id": "number of the loan", "default": "1 = defaulted, 0 = not", "age": "years", "income": "a year", "emp_length": "years in the job",
    "loan_amount": "amount lent", "interest_rate": "per cent", "dti": "debt to income, per cent", "credit_score": "300 to 850",
    "home_ownership": ", ".join(OWNERSHIP), "purpose": ", ".join(PURPOSES), "grade": "A to G, A the best",
}


def describe_loans() -> str:
    """A text on the columns of ``load_loans``."""
    return "Synthetic loans; the chance of default rises with rate and debt and falls with the credit score.\n" + "\n".join(f"- {c}: {text}" for c, text in COLUMNS.items())


def load_loans(spark: SparkSession, n: int = 3000, seed: int = 2191) -> DataFrame:
    """default, age, income, emp_length, loan_amount, interest_rate, dti, credit_score and three categories; seeded."""
    u, z = (lambda s: uniform(F.lit(seed), F.col("id"), F.lit(s))), (lambda s: normal(F.lit(seed), F.col("id"), F.lit(s)))
    pick = lambda values, s: F.get(F.array(*[F.lit(v) for v in values]), F.floor(u(s) * len(values)).cast("int"))
    rows = spark.range(n).select(
        F.col("id"), F.floor(u("age") * 50 + 20).cast("int").alias("age"), F.exp(z("income") * 0.5 + 10.8).alias("income"),
        F.floor(u("job") * 20).cast("int").alias("emp_length"), F.exp(z("amount") * 0.6 + 9.3).alias("loan_amount"),
        (u("rate") * 18 + 5).alias("interest_rate"), (u("dti") * 40).alias("dti"),
        F.least(F.greatest(F.bround(z("score") * 60 + 680), F.lit(300)), F.lit(850)).cast("int").alias("credit_score"),
        pick(OWNERSHIP, "home").alias("home_ownership"), pick(PURPOSES, "purpose").alias("purpose"), pick(GRADES, "grade").alias("grade"), u("default").alias("u"),
    )
    risk = -2.0 + 0.08 * (F.col("interest_rate") - 14) + 0.03 * (F.col("dti") - 20) - 0.01 * (F.col("credit_score") - 680)
    return rows.withColumn("default", (F.col("u") < 1 / (1 + F.exp(-risk))).cast("int")).drop("u")


def parse_codes(text: str | None) -> dict[str, str]:
    """``1 = none, 2 = some`` to a map; a text without ``=`` gives none."""
    found = re.findall(r"(-?\d+)\s*=\s*(.*?)(?=[,;]?\s*-?\d+\s*=|$)", text or "", re.S)
    return {k: v.strip().rstrip(",;").strip() for k, v in found}


def parse_special(value) -> list[int]:
    """``4``, ``"4,5"``, 4.0 to a list of ints; missing and blank to none."""
    if value is None or value != value or str(value).strip() == "":
        return []
    return [int(float(x)) for x in str(value).split(",") if x.strip()]


def load_dictionary(spark: SparkSession, path: str) -> dict[str, dict]:
    """Role, dtype, monotonicity, special codes and code book of each variable of a dictionary CSV."""
    out = {}
    for r in spark.read.csv(path, header=True).collect():
        kind = (r["Type"] or "").strip().lower()
        if kind not in ROLES:
            raise ValueError(f"unknown type {r['Type']!r} of {r['Variable']}")
        out[r["Variable"]] = {
            "type": ROLES[kind], "dtype": r["dtype"], "monotonicity": (r["Monotonicity"] or "").strip().lower() == "yes",
            "special_codes": parse_special(r["SpecialCodes"]), "encoding": parse_codes(r["Encoding"]),
        }
    return out


def with_roles(df: DataFrame, roles: dict[str, dict]) -> DataFrame:
    """Roles as column metadata: they survive Parquet."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=roles[c]) if c in roles else F.col(f"`{c}`") for c in df.columns])


def decode(df: DataFrame, column: str, book: dict[str, str]) -> DataFrame:
    pairs = [F.lit(x) for k, v in book.items() for x in (k, v)]
    return df.withColumn(column, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column).cast("string")), F.col(column).cast("string")) if pairs else F.col(column))
