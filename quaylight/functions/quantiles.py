"""Exact quantiles and order statistics without a global sort.

Up to SMALL rows one aggregate with percentile() does it. Beyond that, a value's place is found by narrowing a range: each
round counts rows in BUCKETS buckets (a partial aggregation with a bounded result) and goes on inside the one that holds
the place, until the rows left are few enough to sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL, BUCKETS = 200_000, 4096


def kth(df: DataFrame, column: str, k: int, small: int = SMALL):
    """The k-th smallest value (from 0) of a numeric column without NULLs."""
    some = df.select(F.col(column).alias("v")).where("v is not null")
    while True:
        low, high, n = some.agg(F.min("v"), F.max("v"), F.count("*")).first()
        if low is None or low == high:
            return low
        if n <= small:
            return some.orderBy("v").limit(k + 1).agg(F.max("v")).first()[0]
        width = (float(high) - float(low)) / BUCKETS
        bucket = F.least(F.floor((F.col("v") - F.lit(low)) / width), F.lit(BUCKETS - 1)).cast("long")
        seen = 0
        for b, c in sorted(map(tuple, some.groupBy(bucket.alias("b")).count().collect())):
            if seen + c > k:
                break
            seen += c
        if c == n:
            return some.orderBy("v").limit(k + 1).agg(F.max("v")).first()[0]
        k -= seen
        some = some.where(bucket == b)


def quantile(df: DataFrame, column: str, q: float, small: int = SMALL) -> float | None:
    """The q-quantile with linear interpolation; None without values."""
    some = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = some.count()
    if not n:
        return None
    if n <= small:
        return some.agg(F.percentile("v", q)).first()[0]
    place = q * (n - 1)
    k = int(place)
    low = kth(some, "v", k, small)
    return low if place == k else low + (place - k) * (kth(some, "v", k + 1, small) - low)


def medians(df: DataFrame, columns: list[str], small: int = SMALL) -> dict[str, float | None]:
    """Medians of several columns, in one pass if the table is small."""
    if not columns:
        return {}
    if df.count() <= small:
        return df.agg(*[F.median(F.col(c).cast("double")).alias(c) for c in columns]).first().asDict()
    return {c: quantile(df, c, 0.5, small) for c in columns}
