"""The rule layer: reporting thresholds, structuring, country tiers, geography, velocity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.config import Thresholds
from quaylight.functions.columns import clip, flag, lookup
from quaylight.functions.quantiles import quantile
from quaylight.functions.windows import DAY, ORDER, trailing, with_order_key

DEFAULTS = Thresholds()
ELEVATED = ("grey_list", "moderate", "sanctioned")


def applicable_threshold(country: Column, settings: Thresholds = DEFAULTS) -> Column:
    """The reporting threshold of a country's jurisdiction."""
    return lookup(country, settings.threshold_by_country(), settings.thresholds_usd["DEFAULT"], "double")


def country_tier(country: Column, settings: Thresholds = DEFAULTS) -> Column:
    return lookup(country, settings.tier_by_country(), "baseline")


def country_score(country: Column, settings: Thresholds = DEFAULTS) -> Column:
    scores = {c: settings.tiers[tier][0] for c, tier in settings.tier_by_country().items()}
    return lookup(country, scores, settings.baseline_score, "double")


def is_elevated(country: Column, settings: Thresholds = DEFAULTS) -> Column:
    return country_tier(country, settings).isin(*ELEVATED)


def threshold_rule(df: DataFrame, settings: Thresholds = DEFAULTS, amount: str = "amount_usd_equivalent") -> DataFrame:
    """threshold_exceeded_flag: the amount reaches the large-transaction cutoff."""
    return df.withColumn("threshold_exceeded_flag", flag(F.col(amount) >= settings.large_transaction))


def trailing_24h(df: DataFrame, customer: str = "customer_id", amount: str = "amount_usd_equivalent", ts: str = "payment_timestamp", tie: str = "payment_id") -> DataFrame:
    """trailing_24h_amount_sum and _max over the customer's last 24 hours, this payment included. Rows without a customer go."""
    keyed = with_order_key(df.where(F.col(customer).isNotNull()), customer, ts, tie)
    return keyed.withColumns({f"trailing_24h_amount_{f}": trailing(f"{f}(`{amount}`)", customer, DAY, inclusive=True) for f in ("sum", "max")}).drop(ORDER)


def structuring_rule(df: DataFrame, settings: Thresholds = DEFAULTS, customer: str = "customer_id", amount: str = "amount_usd_equivalent", country: str = "counterparty_country", ts: str = "payment_timestamp") -> DataFrame:
    """near_threshold_flag, and structuring_flag: 24 hours' payments pass the threshold together while none does alone."""
    out = trailing_24h(df, customer, amount, ts).withColumn("applicable_threshold_usd", applicable_threshold(F.col(country), settings))
    limit = F.col("applicable_threshold_usd")
    ratio = F.try_divide(F.col(amount), limit)
    return out.withColumns({
        "near_threshold_flag": flag((ratio >= settings.near_ratio) & (ratio < 1.0)),
        "structuring_flag": flag((F.col("trailing_24h_amount_sum") > limit) & (F.col("trailing_24h_amount_max") <= limit)),
    })


def sanctions_rule(df: DataFrame, settings: Thresholds = DEFAULTS, country: str = "counterparty_country") -> DataFrame:
    """country_risk_tier, country_risk_score, sanctions_country_flag."""
    c = F.col(country)
    return df.withColumns({"country_risk_tier": country_tier(c, settings), "country_risk_score": country_score(c, settings), "sanctions_country_flag": flag(country_tier(c, settings) == "sanctioned")})


def geo_risk_rules(df: DataFrame, settings: Thresholds = DEFAULTS, country: str = "counterparty_country", new_country: str = "new_country_flag", direction: str = "transaction_direction", amount: str = "amount_usd_equivalent", cutoff: float | None = None) -> DataFrame:
    """geo_mismatch_flag, and high_risk_corridor_flag: an outbound payment to an elevated country of at least the dataset's 90th percentile."""
    elevated = is_elevated(F.col(country), settings)
    mismatch = flag(F.coalesce(F.col(new_country) != 0, F.lit(True)) & elevated) if new_country in df.columns else F.lit(0)
    if cutoff is None:
        cutoff = quantile(df, amount, settings.corridor_quantile)
    outbound = F.upper(F.col(direction).cast("string")) == "OUTBOUND"
    return df.withColumns({"geo_mismatch_flag": mismatch, "high_risk_corridor_flag": flag(outbound & elevated & (F.col(amount) >= F.lit(cutoff).cast("double")))})


def velocity_score(df: DataFrame, settings: Thresholds = DEFAULTS, freq_24h: str = "transaction_frequency_24h", freq_7d: str = "transaction_frequency_7d") -> DataFrame:
    """velocity_score: capped shares of both frequencies' norms, 0.7 and 0.3; velocity_flag at the cutoff."""
    day, week = (clip(F.col(c) / n, high=1.0) for c, n in ((freq_24h, settings.frequency_24h), (freq_7d, settings.frequency_7d)))
    out = df.withColumn("velocity_score", F.bround(0.7 * day + 0.3 * week, 4))
    return out.withColumn("velocity_flag", flag(F.col("velocity_score") >= settings.velocity_cutoff))


def simple_flags(df: DataFrame, settings: Thresholds = DEFAULTS) -> DataFrame:
    """ip_risk_flag and young_account_flag."""
    return df.withColumns({"ip_risk_flag": flag(F.col("ip_risk_score") >= settings.ip_risk), "young_account_flag": flag(F.col("account_age_days") < settings.account_age_days)})


def rule_engine(df: DataFrame, settings: Thresholds = DEFAULTS) -> DataFrame:
    """All rules in order; needs the history features."""
    cutoff = quantile(df, "amount_usd_equivalent", settings.corridor_quantile)
    out = sanctions_rule(structuring_rule(threshold_rule(df, settings), settings), settings)
    return velocity_score(geo_risk_rules(out, settings, cutoff=cutoff), settings)


FLAGS = ("threshold_exceeded_flag", "near_threshold_flag", "structuring_flag", "sanctions_country_flag", "geo_mismatch_flag", "high_risk_corridor_flag", "velocity_flag")


def rule_report(df: DataFrame) -> DataFrame:
    """(metric, value) of the rule layer in one aggregation."""
    counts = df.agg(F.count("*").alias("rows"), *[F.sum(c).cast("long").alias(c) for c in FLAGS])
    return counts.unpivot([], ["rows", *FLAGS], "metric", "value")


def tier_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("country_risk_tier").agg(F.count("*").alias("n"))
