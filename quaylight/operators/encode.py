"""Encoders fitted on train rows only: fit() gives a small object, apply() is a projection of any frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.contract import FREQUENCY, IMPUTE_MEDIAN, IMPUTE_MODE, LEVELS, ONE_HOT, ORDINAL, SKEWED
from quaylight.functions.columns import clip
from quaylight.functions.quantiles import medians

#: Categories of a column that become columns of their own; more would be no one-hot encoding.
MOST_CATEGORIES = 10_000
#: Categories of a frequency table that is broadcast.
BROADCAST_CATEGORIES = 1_000_000


@dataclass(frozen=True)
class Imputer:
    values: dict = field(default_factory=dict)

    @staticmethod
    def fit(train: DataFrame) -> Imputer:
        """Train medians of the numeric columns and modes (the smallest of tied ones, UNKNOWN without values) of the others."""
        numeric, text = [c for c in IMPUTE_MEDIAN if c in train.columns], [c for c in IMPUTE_MODE if c in train.columns]
        modes = train.agg(*[F.mode(c, True).alias(c) for c in text]).first().asDict() if text else {}
        return Imputer({c: v for c, v in medians(train, numeric).items() if v is not None} | {c: "UNKNOWN" if v is None else v for c, v in modes.items()})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double") if c in IMPUTE_MEDIAN else F.col(c), F.lit(v)) for c, v in self.values.items() if c in df.columns})


def ordinal_encode(df: DataFrame, columns=ORDINAL) -> DataFrame:
    """LOW, MEDIUM, HIGH become 0, 1, 2; anything else is NULL."""
    code = lambda c: F.when(F.col(c) == LEVELS[0], 0).when(F.col(c) == LEVELS[1], 1).when(F.col(c) == LEVELS[2], 2)
    return df.withColumns({c: code(c) for c in columns if c in df.columns})


@dataclass(frozen=True)
class OneHot:
    categories: dict = field(default_factory=dict)

    @staticmethod
    def fit(train: DataFrame, columns=ONE_HOT) -> OneHot:
        found = {}
        for c in columns:
            if c in train.columns:
                rows = train.select(c).where(F.col(c).isNotNull()).distinct().limit(MOST_CATEGORIES + 1).collect()
                if len(rows) > MOST_CATEGORIES:
                    raise ValueError(f"{c} has more than {MOST_CATEGORIES} categories")
                found[c] = sorted(r[0] for r in rows)
        return OneHot(found)

    def apply(self, df: DataFrame) -> DataFrame:
        """Columns {column}_{value} of the train categories in order; the original columns go."""
        new = {f"{c}_{v}": F.col(c).eqNullSafe(F.lit(v)).cast("int") if c in df.columns else F.lit(0) for c, values in self.categories.items() for v in values}
        return df.withColumns(new).drop(*self.categories)


def frequency_table(train: DataFrame, column: str) -> DataFrame:
    """(column, frequency) among the train rows that have a value."""
    counts = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select(column, (F.col("n") / F.lit(float(total))).alias("frequency"))


def frequency_encode(df: DataFrame, train: DataFrame, columns=FREQUENCY) -> DataFrame:
    """Each column becomes its value's frequency in train; values that train lacks get 0, NULL in a train row stays NULL."""
    for c in columns:
        if c in df.columns:
            table = frequency_table(train, c).withColumnRenamed(c, "_value").withColumnRenamed("frequency", "_frequency")
            if table.count() <= BROADCAST_CATEGORIES:
                table = F.broadcast(table)
            known = F.when(F.col(c).isNull(), F.lit(None) if "split" not in df.columns else F.when(F.col("split") != "train", 0.0)).otherwise(F.coalesce("_frequency", F.lit(0.0)))
            df = df.join(table, F.col(c) == F.col("_value"), "left").withColumn(c, known.cast("double")).drop("_value", "_frequency")
    return df


def log_transform(df: DataFrame, columns=SKEWED, passes: int = 1) -> DataFrame:
    """log1p of the columns that exist, negative values as 0."""
    def log(c):
        out = F.col(c).cast("double")
        for _ in range(passes):
            out = F.log1p(clip(out, low=0.0))
        return out

    return df.withColumns({c: log(c) for c in columns if c in df.columns})


def timestamp_features(df: DataFrame, ts: str = "payment_timestamp") -> DataFrame:
    """Hour (an existing column wins), day of week (Monday 0), of month, month, and the weekend, night and business-hour flags."""
    hour = F.col("transaction_hour") if "transaction_hour" in df.columns else F.hour(ts)
    out = df.withColumns({"transaction_hour": hour, "day_of_week": F.weekday(ts), "day_of_month": F.dayofmonth(ts), "month": F.month(ts)})
    weekend, h = F.col("day_of_week") >= 5, F.col("transaction_hour")
    to_flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    return out.withColumns({"is_weekend": to_flag(weekend), "is_night": to_flag((h >= 23) | (h < 5)), "is_business_hour": to_flag((h >= 9) & (h < 17) & ~weekend)})
