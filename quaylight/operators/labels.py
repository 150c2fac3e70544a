"""Simulated analyst review of rule alerts. Draws are hashes of the seed and the payment, so they don't depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.config import Thresholds
from quaylight.functions.columns import clip, flag, hash_uniform, lookup

DEFAULTS = Thresholds()
NO_RULE = "no_rule_triggered"


def risk_multiplier(df: DataFrame, customer: str = "customer_id", amount: str = "amount_usd_equivalent") -> DataFrame:
    """risk_multiplier = min(1 + 0.5 k, 3), k being how many of four risk marks a payment has; the mean is over all of a customer's payments."""
    mean = F.avg(amount).over(Window.partitionBy(customer))
    large = F.when(F.col(customer).isNull() | mean.isNull() | (mean == 0), F.lit(False)).otherwise(F.col(amount) / mean > 2)
    k = flag(large) + flag(F.col("customer_risk_segment") == "HIGH") + flag(F.col("device_shared_flag") == 1) + flag(F.col("repeated_beneficiary_flag") == 1)
    return df.withColumn("risk_multiplier", clip(1.0 + 0.5 * k, high=3.0))


def analyst_confirmation(df: DataFrame, settings: Thresholds = DEFAULTS, key: str = "payment_id") -> DataFrame:
    """analyst_confirmed_label: confirmed with the rule's rate times the multiplier; rows without an alert with the miss rate."""
    out = risk_multiplier(df)
    rate = lookup(F.coalesce("fraud_rule_name", F.lit("")), settings.confirmation_rates | {NO_RULE: settings.false_negative_rate}, 0.0, "double")
    drawn = hash_uniform(settings.random_seed, key) < clip(rate * F.col("risk_multiplier"), 0.0, 1.0)
    return out.withColumn("analyst_confirmed_label", flag(drawn))


def confirmation_rates(df: DataFrame) -> DataFrame:
    """(rule, rate): the confirmed share of each rule's alerts; of rows without a rule, the share that is fraud all the same."""
    return df.groupBy(F.coalesce("fraud_rule_name", F.lit("")).alias("rule")).agg(F.avg("analyst_confirmed_label").alias("rate"))


def label_report(df: DataFrame) -> DataFrame:
    """(rule, alerts, confirmed): alert rows by rule (a missing rule is one), and missed frauds among the others."""
    return df.groupBy(F.coalesce("fraud_rule_name", F.lit("")).alias("rule")).agg(F.count_if(~F.col("fraud_rule_name").eqNullSafe(F.lit(NO_RULE))).alias("alerts"), F.sum("analyst_confirmed_label").cast("long").alias("confirmed"))
