"""The preprocessing pipeline as a fitted object: fit on train rows, apply to any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.operators.components import stored
from quaylight.operators.encode import Imputer, OneHot, frequency_encode, log_transform, ordinal_encode, timestamp_features
from quaylight.operators.history import feature_engineering
from quaylight.operators.split import drop_missing_timestamps, time_based_split


def preprocess(df: DataFrame, test_size: float = 0.2, legacy_drop_engineered: bool = False, log_passes: int = 1) -> DataFrame:
    """Rows with a time, their features engineered, split by time, then imputed, encoded and transformed by train statistics.

    The result has `split` (train or test) and amount_usd_equivalent_raw, the amount before the logarithm. The two legacy
    switches drop the engineered features again and take the logarithm twice.
    """
    cleaned = drop_missing_timestamps(df)
    # Medians, modes, categories and frequencies take dozens of passes; stored, the frames of history are computed once.
    rows = stored(time_based_split(cleaned if legacy_drop_engineered else feature_engineering(cleaned), test_size=test_size), "features")
    train = rows.where("split = 'train'")
    filled = Imputer.fit(train).apply(rows)
    known = filled.where("split = 'train'")
    coded = OneHot.fit(known).apply(ordinal_encode(filled))
    coded = frequency_encode(coded, known)
    raw = coded.withColumn("amount_usd_equivalent_raw", F.col("amount_usd_equivalent")) if "amount_usd_equivalent" in coded.columns else coded
    return timestamp_features(log_transform(raw, passes=log_passes))


def preprocess_report(df: DataFrame) -> DataFrame:
    """(split, rows, columns) of a preprocessed frame."""
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))
