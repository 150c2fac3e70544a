"""Column expressions that keep the missing-value rules of the payment features: NaN is NULL, a comparison with NULL is false."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a floating column becomes NULL, once, at the boundary."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def safe_ratio(numerator: Column, denominator: Column, fill: float) -> Column:
    """numerator / denominator; `fill` if either is missing or the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(fill))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; NULL stays NULL."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    return out if high is None else F.when(out > high, F.lit(high)).otherwise(out)


def row_mean(columns: list[str]) -> Column:
    """The mean of the columns that are not NULL; NULL if all are."""
    total = reduce(add, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    n = reduce(add, [F.col(c).isNotNull().cast("int") for c in columns])
    return F.try_divide(total, n)


def lookup(key: Column, table: dict, default, kind: str = "string") -> Column:
    """table[key] as a constant expression: a small fixed dictionary needs no join."""
    if not table:
        return F.lit(default).cast(kind)
    by_value: dict = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    out = F
    for v, keys in by_value.items():
        out = out.when(key.isin(keys), F.lit(v))
    return out.otherwise(F.lit(default)).cast(kind)


def hash_uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from a hash of the keys: the same on any cluster, in any order."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
