"""The contract of the payments table: 47 columns, their logical types and the lists that operators work on."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns by logical type.
NUMERIC = (
    "payment_id", "order_id", "customer_id", "counterparty_account_id", "account_age_days", "repeated_beneficiary_flag", "ip_risk_score",
    "device_shared_flag", "instrument_age_days", "transaction_hour", "amount_usd_equivalent", "velocity_score", "amount_risk_score",
    "device_risk_score", "transaction_frequency_24h", "transaction_frequency_7d", "geo_mismatch_flag", "sanctions_country_flag",
    "high_risk_corridor_flag", "structuring_flag", "fraud_label", "item_count", "total_quantity", "unique_products", "unique_merchants",
    "max_product_risk_score", "avg_product_risk_score", "customer_txn_count_30d", "customer_avg_amount_30d", "customer_unique_devices_30d",
    "customer_unique_countries_30d", "customer_unique_merchants_30d", "customer_failed_payments_7d", "new_device_flag", "new_country_flag",
)
STRING = (
    "kyc_level", "customer_risk_segment", "device_id", "payment_status", "payment_method", "transaction_channel", "geo_risk_level",
    "transaction_direction", "counterparty_country", "fraud_rule_name", "label_source",
)
DATETIME = ("payment_timestamp",)
LOGICAL = {**dict.fromkeys(NUMERIC, "numeric"), **dict.fromkeys(STRING, "string"), **dict.fromkeys(DATETIME, "datetime")}
AMOUNTS = ("amount_usd_equivalent", "customer_avg_amount_30d")
UNIT_SCORES = ("ip_risk_score", "velocity_score", "amount_risk_score", "device_risk_score")

IMPUTE_MEDIAN = ("account_age_days", "ip_risk_score", "instrument_age_days", "amount_usd_equivalent", "velocity_score", "amount_risk_score", "device_risk_score", "customer_avg_amount_30d")
IMPUTE_MODE = ("kyc_level", "customer_risk_segment", "payment_status", "payment_method", "transaction_channel", "geo_risk_level", "transaction_direction", "counterparty_country")
ORDINAL = ("kyc_level", "geo_risk_level", "customer_risk_segment")
LEVELS = ("LOW", "MEDIUM", "HIGH")
ONE_HOT = ("payment_method", "transaction_channel", "transaction_direction", "payment_status")
FREQUENCY = ("counterparty_country", "device_id")
SKEWED = (
    "amount_usd_equivalent", "customer_avg_amount_30d", "customer_txn_count_30d", "transaction_frequency_24h", "transaction_frequency_7d", "item_count",
    "total_quantity", "unique_products", "unique_merchants", "customer_unique_devices_30d", "customer_unique_countries_30d",
    "customer_unique_merchants_30d", "customer_failed_payments_7d", "amount_vs_customer_avg_ratio", "txn_frequency_ratio_24h_7d", "failed_payment_ratio_7d",
)
#: Columns that are no features of a model: identifiers, labels, and outputs of other layers.
NO_FEATURES = (
    "payment_id", "order_id", "customer_id", "counterparty_account_id", "payment_timestamp", "fraud_label", "fraud_rule_name", "label_source",
    "velocity_score", "geo_mismatch_flag", "sanctions_country_flag", "high_risk_corridor_flag", "structuring_flag", "threshold_exceeded_flag",
    "near_threshold_flag", "velocity_flag", "country_risk_score", "trailing_24h_amount_sum", "trailing_24h_amount_max", "applicable_threshold_usd",
    "amount_usd_equivalent_raw", "amount_usd_equivalent_raw_mad_score", "amount_usd_equivalent_raw_mad_flag", "statistical_anomaly_flag",
)
NO_SUPERVISED_FEATURES = (*NO_FEATURES, "isolation_forest_score", "ocsvm_score", "unsupervised_anomaly_score", "unsupervised_anomaly_flag", "analyst_confirmed_label")


def logical(kind: T.DataType) -> str:
    """numeric, string, datetime or other."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(kind, T.StringType):
        return "string"
    return "datetime" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "other"


def feature_columns(schema: T.StructType, excluded: tuple[str, ...] = NO_FEATURES) -> list[str]:
    """The numeric columns that are not excluded, in the schema's order."""
    return [f.name for f in schema if f.name not in excluded and isinstance(f.dataType, T.NumericType)]
