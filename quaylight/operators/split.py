"""Time-based train and test split. The cutoff is an exact row position, found without a global sort or rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.functions.columns import micros


class PreprocessingError(Exception):
    """Input that the preprocessing can't work on."""


def drop_missing_timestamps(df: DataFrame, ts: str = "payment_timestamp") -> DataFrame:
    return df.where(F.col(ts).isNotNull())


def _place(df: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th smallest (from 0) of a long column, and how many rows have smaller values; by narrowing buckets of a power of two."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    below, shift = 0, max(0, (high - low).bit_length() - 12)
    while True:
        bucket = F.shiftright(F.col(column) - F.lit(low), shift)
        for b, n in sorted(map(tuple, df.groupBy(bucket.alias("b")).count().collect())):
            if below + n > k:
                break
            below += n
        low += b << shift
        if not shift:
            return low, below
        df = df.where((F.col(column) >= low) & (F.col(column) < low + (1 << shift)))
        shift = max(0, shift - 12)


def split_cutoff(df: DataFrame, ts: str, tie: str, test_size: float) -> tuple[int, int] | None:
    """(time in microseconds, id) of the first test row in the order of (time, id); None if all rows are train rows."""
    keys = df.select(micros(F.col(ts)).alias("t"), F.col(tie).cast("long").alias("i"))
    n = keys.count()
    k = int(n * (1 - test_size))
    if k >= n:
        return None
    t, below = _place(keys, "t", k)
    i, _ = _place(keys.where(F.col("t") == t), "i", k - below)
    return t, i


def time_based_split(df: DataFrame, ts: str = "payment_timestamp", test_size: float = 0.2, tie: str = "payment_id") -> DataFrame:
    """df with `split`: train for the first int(n * (1 - test_size)) rows by (ts, tie), then test. Rows need a time."""
    if ts not in df.columns:
        raise PreprocessingError(f"no column {ts} to split by")
    cut = split_cutoff(df, ts, tie, test_size)
    if cut is None:
        return df.withColumn("split", F.lit("train"))
    t, i = micros(F.col(ts)), F.col(tie).cast("long")
    return df.withColumn("split", F.when((t < cut[0]) | ((t == cut[0]) & (i < cut[1])), "train").otherwise("test"))


def day_split(df: DataFrame, day: str = "day", validation_day: int = 5, test_day: int | None = None) -> DataFrame:
    """df with `split`: train before the validation days, test from the test day on."""
    test_day = validation_day + 1 if test_day is None else test_day
    return df.withColumn("split", F.when(F.col(day) < validation_day, "train").when(F.col(day) < test_day, "validation").otherwise("test"))
