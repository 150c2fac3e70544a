"""Checks of a payments table against its contract. Nothing is coerced: checks give (check, column, value, failed) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.contract import LOGICAL, UNIT_SCORES, logical

REPORT = "check string, column string, value long, failed boolean"


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in LOGICAL if c not in df.columns]


def wrong_types(df: DataFrame) -> dict[str, tuple[str, str]]:
    """column: (expected, found) for columns of the contract with another logical type."""
    return {f.name: (LOGICAL[f.name], logical(f.dataType)) for f in df.schema if f.name in LOGICAL and logical(f.dataType) != LOGICAL[f.name]}


def missing_values(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(column, missing, failed) of columns with NULLs; more than `threshold` of the rows fails."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    rows = counts.unpivot(["_n"], [f"`{c}`" for c in df.columns], "column", "missing").where("missing > 0")
    return rows.select("column", "missing", (F.col("missing") > threshold * F.col("_n")).alias("failed"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(duplicate_rows): rows beyond the first of equal ones; NULLs are equal."""
    return df.groupBy(*[f"`{c}`" for c in df.columns]).count().agg(F.coalesce(F.sum("count") - F.count("*"), F.lit(0)).cast("long").alias("duplicate_rows"))


def duplicate_keys(df: DataFrame, key: str = "payment_id") -> DataFrame:
    """(duplicate_keys): rows beyond the first of a key; NULL is a key."""
    return df.groupBy(key).count().agg(F.coalesce(F.sum("count") - F.count("*"), F.lit(0)).cast("long").alias("duplicate_keys"))


def range_checks(df: DataFrame) -> DataFrame:
    """(check, value): rows with impossible values, for the columns that exist; one aggregation."""
    have, checks = set(df.columns), {}
    if "amount_usd_equivalent" in have:
        checks["negative_amount_usd_equivalent"] = F.col("amount_usd_equivalent") < 0
    if "transaction_hour" in have:
        checks["invalid_transaction_hour"] = (F.col("transaction_hour") < 0) | (F.col("transaction_hour") > 23)
    for c in UNIT_SCORES:
        if c in have:
            checks[f"invalid_{c}"] = (F.col(c) < 0) | (F.col(c) > 1)
    if "payment_timestamp" in have and isinstance(df.schema["payment_timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)):
        checks["invalid_payment_timestamp"] = F.col("payment_timestamp").isNull()
    if not checks:
        return df.sparkSession.createDataFrame([], "check string, value long")
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()]).unpivot([], list(checks), "check", "value")


def validate(df: DataFrame, threshold: float = 0.3, key: str = "payment_id") -> DataFrame:
    """(check, column, value, failed) of all checks in order. Schema checks run no job; duplicate rows only warn."""
    spark = df.sparkSession
    schema = [("missing_column", c, 1, True) for c in missing_columns(df)] + [("wrong_type", c, 1, True) for c in wrong_types(df)]
    parts = [spark.createDataFrame(schema, REPORT)]
    parts.append(missing_values(df, threshold).select(F.lit("missing_values").alias("check"), "column", F.col("missing").alias("value"), "failed"))
    parts.append(duplicate_rows(df).select(F.lit("duplicate_rows").alias("check"), F.lit("").alias("column"), F.col("duplicate_rows").alias("value"), F.lit(False).alias("failed")))
    if key in df.columns:
        parts.append(duplicate_keys(df, key).select(F.lit("duplicate_keys").alias("check"), F.lit(key).alias("column"), F.col("duplicate_keys").alias("value"), (F.col("duplicate_keys") > 0).alias("failed")))
    parts.append(range_checks(df).select("check", F.lit("").alias("column"), "value", (F.col("value") > 0).alias("failed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def passed(report: DataFrame) -> bool:
    return report.where("failed").isEmpty()


def profile(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls) of every column, in one aggregation."""
    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot(["rows"], [f"`{c}`" for c in df.columns], "column", "nulls").select("column", kinds[F.col("column")].alias("type"), "rows", "nulls")
