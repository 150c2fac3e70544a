"""Statistical detectors with train-fitted parameters: double MAD, z-score, IQR, scaling, min-max."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.functions.columns import clip, flag
from quaylight.functions.quantiles import quantile

CONSISTENCY = 1.4826


@dataclass(frozen=True)
class DoubleMad:
    median: float | None
    below: float | None
    above: float | None

    @staticmethod
    def fit(train: DataFrame, column: str) -> DoubleMad:
        """The median, and the median distance to it of the values on either side; the median itself is on both."""
        m = quantile(train, column, 0.5)
        if m is None:
            return DoubleMad(None, None, None)
        x = F.col(column)
        return DoubleMad(m, quantile(train.where(x <= m).select((m - x).alias("d")), "d", 0.5), quantile(train.where(x >= m).select((x - m).alias("d")), "d", 0.5))

    def score(self, x: Column) -> Column:
        """Signed distance in robust standard deviations of its side; 0 where a side has no spread."""
        side = F.when(x <= F.lit(self.median), F.lit(self.below)).otherwise(F.lit(self.above))
        return F.when(x.isNotNull(), F.when(side == 0, 0.0).otherwise(F.try_divide(x - F.lit(self.median), CONSISTENCY * side)))

    def apply(self, df: DataFrame, column: str, threshold: float = 3.5) -> DataFrame:
        out = df.withColumn(f"{column}_mad_score", self.score(F.col(column)))
        return out.withColumn(f"{column}_mad_flag", flag(F.abs(f"{column}_mad_score") >= threshold))


def statistical_detection(train: DataFrame, df: DataFrame, column: str = "amount_usd_equivalent_raw", threshold: float = 3.5) -> DataFrame:
    """df with the train-fitted double-MAD score and flag, also as statistical_anomaly_flag."""
    out = DoubleMad.fit(train, column).apply(df, column, threshold)
    return out.withColumn("statistical_anomaly_flag", F.col(f"{column}_mad_flag"))


def zscore_flags(train: DataFrame, df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    mean, std = train.agg(F.avg(column), F.stddev_pop(column)).first()
    return df.withColumn(f"{column}_zscore_flag", flag(F.abs(F.try_divide(F.col(column) - F.lit(mean), F.lit(std))) >= threshold))


def iqr_flags(train: DataFrame, df: DataFrame, column: str, multiplier: float = 1.5) -> DataFrame:
    q1, q3 = quantile(train, column, 0.25), quantile(train, column, 0.75)
    if q1 is None:
        return df.withColumn(f"{column}_iqr_flag", F.lit(0))
    reach = multiplier * (q3 - q1)
    return df.withColumn(f"{column}_iqr_flag", flag((F.col(column) < q1 - reach) | (F.col(column) > q3 + reach)))


def percentile_flags(train: DataFrame, df: DataFrame, column: str, q: float = 0.99) -> DataFrame:
    cut = quantile(train, column, q)
    return df.withColumn(f"{column}_percentile_flag", flag(F.col(column) > F.lit(cut).cast("double")))


@dataclass(frozen=True)
class Scaler:
    stats: dict

    @staticmethod
    def fit(train: DataFrame, columns: list[str]) -> Scaler:
        """Means and population standard deviations, in one pass; a constant column keeps scale 1."""
        row = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return Scaler({c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()})


def minmax_invert(df: DataFrame, column: str, low: float | None, high: float | None, out: str) -> DataFrame:
    """1 - the value's place between the train minimum and maximum: 1 is the most anomalous. A degenerate range gives 1."""
    if low is None or high == low:
        return df.withColumn(out, F.lit(1.0))
    return df.withColumn(out, 1.0 - clip((F.col(column) - F.lit(low)) / F.lit(high - low), 0.0, 1.0))
