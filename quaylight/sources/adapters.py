"""The benchmark tables as payments and transfers, and the rule settings that fit their value ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.config import Thresholds, override


def _nations(*k: int) -> tuple[str, ...]:
    return tuple(f"NATION_{i}" for i in k)


#: Our own choice of tiers and jurisdictions for NATION_0..NATION_24, and cutoffs that some rows pass.
SETTINGS = override(
    Thresholds(),
    large_transaction=30_000.0, frequency_24h=3.0, frequency_7d=21.0,
    jurisdictions={"US": _nations(15), "IN": _nations(16), "GCC": _nations(*range(9, 15))},
    tiers={"sanctioned": (1.00, _nations(0, 1)), "grey_list": (0.65, _nations(*range(2, 7))), "moderate": (0.45, _nations(7, 8)), "gcc_baseline": (0.35, _nations(*range(9, 15)))},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payments_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment for each event."""
    k = F.get_json_object("props", "$.k").cast("int")
    level = lambda c: F.when(c % 3 == 0, "LOW").when(c % 3 == 1, "MEDIUM").otherwise("HIGH")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("payment_method"))
    return e.join(c, "user_id", "left").select(
        F.col("event_id").alias("payment_id"), F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"), F.col("ts").cast("timestamp").alias("payment_timestamp"),
        F.round(F.col("value") * 100, 2).alias("amount_usd_equivalent"), F.concat(F.lit("DEV_"), (F.col("k") % 10).cast("string")).alias("device_id"),
        F.concat(F.lit("NATION_"), (F.col("k") % 25).cast("string")).alias("counterparty_country"),
        F.when(F.col("event_type").isin("purchase", "error"), "OUTBOUND").otherwise("INBOUND").alias("transaction_direction"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("payment_status"),
        F.when(F.col("event_type").isin("view", "click"), "MOBILE").otherwise("WEB").alias("transaction_channel"), "payment_method",
        level(F.col("user_id")).alias("kyc_level"), level(F.col("user_id") + 1).alias("customer_risk_segment"), level(F.col("k")).alias("geo_risk_level"),
        ((F.col("k") % 10) / 10).alias("ip_risk_score"), F.least(F.col("value") / 500, F.lit(1.0)).alias("amount_risk_score"), ((F.col("k") % 7) / 10).alias("device_risk_score"),
        (F.col("user_id") * 7 % 900).alias("account_age_days"), (F.col("k") * 5).alias("instrument_age_days"),
        (1 + F.col("k") % 4).alias("unique_merchants"), (1 + F.col("k") % 6).alias("item_count"), (1 + F.col("k") % 5).alias("unique_products"), (1 + F.col("k") % 9).alias("total_quantity"),
        (F.col("k") % 2).alias("device_shared_flag"), F.when(F.col("k") % 5 == 0, 1).otherwise(0).alias("repeated_beneficiary_flag"),
    )


def payments_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment for each order; days as times, so there are ties."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("s"), F.min("s_nationkey").alias("n"), F.count("*").alias("item_count"), F.sum("l_quantity").alias("total_quantity"), F.count_distinct("l_partkey").alias("unique_products"), F.count_distinct("l_suppkey").alias("unique_merchants")
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey"), "c_nationkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select(
        F.col("o_orderkey").alias("payment_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("timestamp").alias("payment_timestamp"), F.col("o_totalprice").alias("amount_usd_equivalent"),
        (F.lit(1_000_000) + F.col("s")).alias("counterparty_account_id"), F.concat(F.lit("NATION_"), F.coalesce("n", "c_nationkey").cast("string")).alias("counterparty_country"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"), "total_quantity", F.coalesce("unique_products", F.lit(0)).alias("unique_products"), F.coalesce("unique_merchants", F.lit(0)).alias("unique_merchants"),
        F.col("c_mktsegment").alias("payment_method"), F.col("o_orderpriority").alias("transaction_channel"), F.concat(F.lit("DEV_"), F.col("o_orderpriority")).alias("device_id"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("payment_status"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transfer for each line item, every fifth one reversed so that some are reciprocal."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    c, s, swap = F.concat(F.lit("C_"), F.col("o_custkey").cast("string")), F.concat(F.lit("S_"), F.col("l_suppkey").cast("string")), F.col("l_linenumber") % 5 == 0
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(swap, s).otherwise(c).alias("from_node"), F.when(swap, c).otherwise(s).alias("to_node"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"), F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")).alias("day"), F.col("l_extendedprice").alias("amount_paid"),
        F.concat("l_returnflag", "l_linestatus").alias("payment_format"), ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08)).cast("int").alias("is_laundering"),
    )


def with_rule_name(df: DataFrame) -> DataFrame:
    """fraud_rule_name of rule-engine output: our own order of the rules that alerts name."""
    on = lambda c: F.col(c) == 1
    name = (
        F.when(on("sanctions_country_flag"), "sanctions_country").when(on("structuring_flag"), "structuring_flag").when(on("geo_mismatch_flag") & on("velocity_flag"), "geo_velocity")
        .when(on("high_risk_corridor_flag") & on("velocity_flag"), "corridor_velocity").when(on("threshold_exceeded_flag") & (F.col("transaction_frequency_24h") >= 2), "amount_frequency")
        .when(on("device_shared_flag") & (F.col("geo_risk_level") == "HIGH"), "device_geo_risk").otherwise("no_rule_triggered")
    )
    return df.withColumn("fraud_rule_name", name)
