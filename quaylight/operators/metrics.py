"""Classification metrics over scored rows, from one row per distinct score: exact under ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct scores whose running sums fit one task; beyond that scores are ranked within ranges first.
RANGES = 256


def _curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(s, n, pos, n_ge, pos_ge): rows and positives of each distinct score, and of all scores at or above it.

    Running sums go over ranges of scores: offsets of the ranges (RANGES rows) are added to sums within each.
    """
    points = df.where(f"`{score}` is not null and `{label}` is not null").groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    low, high = points.agg(F.min("s"), F.max("s")).first()
    width = ((high - low) / RANGES if low is not None and high > low else 1.0) or 1.0
    points = points.withColumn("r", F.least(F.floor((F.col("s") - F.lit(0.0 if low is None else low)) / width), F.lit(RANGES - 1)))
    up = Window.partitionBy("r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    base = points.groupBy("r").agg(F.sum("n").alias("rn"), F.sum("pos").alias("rp")).select("r", F.coalesce(F.sum("rn").over(over), F.lit(0)).alias("bn"), F.coalesce(F.sum("rp").over(over), F.lit(0)).alias("bp"))
    own = points.select("r", "s", "n", "pos", F.sum("n").over(up).alias("cn"), F.sum("pos").over(up).alias("cp"))
    return own.join(F.broadcast(base), "r").select("s", "n", "pos", (F.col("cn") + F.col("bn")).alias("n_ge"), (F.col("cp") + F.col("bp")).alias("pos_ge"))


def scale_pos_weight(df: DataFrame, label: str) -> DataFrame:
    """(scale_pos_weight): negatives per positive; 1 without positives."""
    return df.agg(F.coalesce(F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1).cast("double")), F.lit(1.0)).alias("scale_pos_weight"))


def best_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, f1): the score with the best F1 of `score >= threshold`, the lowest on ties."""
    total = df.agg(F.sum(F.col(label).cast("long"))).first()[0] or 0
    f1 = F.coalesce(F.try_divide(2.0 * F.col("pos_ge"), (F.col("n_ge") + F.lit(total)).cast("double")), F.lit(0.0))
    return _curve(df, label, score).select(F.col("s").alias("threshold"), f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def classification_metrics(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """(precision, recall, f1, roc_auc, average_precision); 0 where a ratio has no denominator.

    Average precision is the step sum of precision over gains in recall; the area counts tied pairs as half.
    """
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    tp, flagged, pos, n = df.agg(F.count_if(y & hit), F.count_if(hit), F.count_if(y), F.count("*")).first()
    curve = _curve(df, label, score)
    neg = n - pos
    sums = curve.agg(
        F.sum(F.col("pos") * F.try_divide(F.col("pos_ge").cast("double"), F.col("n_ge").cast("double"))).alias("ap"),
        F.sum((F.col("n") - F.col("pos")) * ((F.col("pos_ge") - F.col("pos")) + F.col("pos") / 2.0)).alias("auc"),
    )
    p, r = tp / flagged if flagged else 0.0, tp / pos if pos else 0.0
    return sums.select(
        F.lit(float(p)).alias("precision"), F.lit(float(r)).alias("recall"), F.lit(2 * p * r / (p + r) if p + r else 0.0).alias("f1"),
        (F.col("auc") / F.lit(float(pos * neg))).alias("roc_auc") if pos and neg else F.lit(None).cast("double").alias("roc_auc"),
        (F.col("ap") / F.lit(float(pos))).alias("average_precision") if pos else F.lit(0.0).alias("average_precision"),
    )
