"""Leakage-free trailing history of customers, and what derives from it.

Every frame shares one partitioning by customer and one order, so the whole layer plans as one exchange. NULL devices and
countries count as one value of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.columns import flag, row_mean, safe_ratio
from quaylight.functions.windows import DAY, ORDER, trailing, with_order_key

_ABSENT = "\u0000absent"


def customer_history(
    df: DataFrame, customer: str = "customer_id", device: str = "device_id", country: str = "counterparty_country", amount: str = "amount_usd_equivalent",
    merchants: str = "unique_merchants", status: str = "payment_status", ts: str = "payment_timestamp", tie: str = "payment_id",
) -> DataFrame:
    """The ten history features of each payment of a known customer, from that customer's earlier payments only."""
    out = with_order_key(df.where(F.col(customer).isNotNull()), customer, ts, tie)
    week, month = 7 * DAY, 30 * DAY
    distinct = lambda c: F.size(trailing(f"collect_set(coalesce(cast(`{c}` as string), '{_ABSENT}'))", customer, month)).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    out = out.withColumns({
        "customer_txn_count_30d": trailing("count(*)", customer, month).cast("double"),
        "customer_avg_amount_30d": zero(trailing(f"avg(`{amount}`)", customer, month)),
        "customer_unique_devices_30d": distinct(device),
        "customer_unique_countries_30d": distinct(country),
        "customer_unique_merchants_30d": zero(trailing(f"sum(`{merchants}`)", customer, month)) if merchants in df.columns else F.lit(0.0),
        "customer_failed_payments_7d": zero(trailing(f"count_if(`{status}` = 'failed')", customer, week)) if status in df.columns else F.lit(0.0),
        "transaction_frequency_24h": trailing("count(*)", customer, DAY).cast("double"),
        "transaction_frequency_7d": trailing("count(*)", customer, week).cast("double"),
    })
    first = lambda c: flag(F.row_number().over(Window.partitionBy(customer, c).orderBy(ORDER)) == 1)
    return out.withColumns({"new_device_flag": first(device), "new_country_flag": first(country)}).drop(ORDER)


def derived_features(df: DataFrame) -> DataFrame:
    """Ratios of history features, each if its inputs exist, and the mean of the risk scores."""
    have = set(df.columns)
    ratios = {
        "amount_vs_customer_avg_ratio": ("amount_usd_equivalent", "customer_avg_amount_30d", 1.0),
        "txn_frequency_ratio_24h_7d": ("transaction_frequency_24h", "transaction_frequency_7d", 0.0),
        "failed_payment_ratio_7d": ("customer_failed_payments_7d", "customer_txn_count_30d", 0.0),
        "product_diversity_ratio": ("unique_products", "item_count", 1.0),
        "merchant_diversity_ratio": ("unique_merchants", "item_count", 1.0),
        "account_instrument_age_ratio": ("account_age_days", "instrument_age_days", 1.0),
    }
    new = {name: safe_ratio(F.col(a), F.col(b), fill) for name, (a, b, fill) in ratios.items() if {a, b} <= have}
    scores = [c for c in ("ip_risk_score", "amount_risk_score", "device_risk_score") if c in have]
    return df.withColumns(new | ({"combined_risk_score": row_mean(scores)} if scores else {}))


def feature_engineering(df: DataFrame) -> DataFrame:
    return derived_features(customer_history(df))
