"""Weighted fusion of the layers' signals, and alert severity."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.config import Thresholds

DEFAULTS = Thresholds()


def risk_fusion(df: DataFrame, signals: dict[str, str], settings: Thresholds = DEFAULTS) -> DataFrame:
    """risk_score: the weighted mean of the signals (layer -> column, values 0..1); missing ones leave their weight to the others."""
    weights = {layer: settings.fusion_weights[layer] for layer in signals}
    total = reduce(add, [F.coalesce(F.col(c).cast("double") * weights[layer], F.lit(0.0)) for layer, c in signals.items()])
    weight = reduce(add, [F.when(F.col(c).isNotNull(), weights[layer]).otherwise(0.0) for layer, c in signals.items()])
    return df.withColumn("risk_score", F.try_divide(total, weight))


def alert_severity(df: DataFrame, settings: Thresholds = DEFAULTS, score: str = "risk_score") -> DataFrame:
    """alert_severity: the first severity whose upper bound the score doesn't pass."""
    out = F
    for name, bound in sorted(settings.severity.items(), key=lambda x: x[1]):
        out = out.when(F.col(score) <= bound, name)
    return df.withColumn("alert_severity", out)
