"""One named query for each operator, over the benchmark tables as payments or transfers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.contract import ORDINAL, feature_columns
from quaylight.operators import anomaly, components, encode, fusion, graph, history, labels, metrics, rings, rules, split, stats, supervised, validate
from quaylight.plans.preprocess import preprocess, preprocess_report
from quaylight.sources import tables
from quaylight.sources.adapters import SETTINGS, edges, payments_events, payments_orders, with_rule_name

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ID = "payment_id"
TRAIN_DAY, TEST_DAY = 1500, 2000


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(*columns: str, digits: int = 6):
    return [F.round(F.col(c).cast("double"), digits).alias(c) for c in columns]


def _holed(spark, d):
    """Orders with NULLs put in by a rule of the key."""
    hole = lambda c, k: F.when(F.col(ID) % k != 0, F.col(c)).alias(c)
    return payments_orders(spark, d).select(ID, "customer_id", hole("payment_timestamp", 11), hole("amount_usd_equivalent", 7), hole("payment_method", 5), hole("transaction_channel", 2))


# Sources and profiles


@query
def scan_limit(spark, d):
    return tables.limited(payments_orders(spark, d).select(ID, "customer_id", "amount_usd_equivalent"), 100, [ID])


@query
def amount_units(spark, d):
    return tables.to_usd(payments_orders(spark, d).select(ID, "amount_usd_equivalent"), 1000.0).select(ID, *_r("amount_usd_equivalent", digits=2))


@query
def profile_nulls(spark, d):
    return validate.profile(_holed(spark, d)).select("column", "rows", "nulls")


@query
def pattern_parse(spark, d):
    """A pattern file made from all transfers: one attempt for each format, in order."""
    e = edges(spark, d)
    w = "partition by payment_format order by timestamp, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, amount_paid"
    formats = e.select("payment_format").distinct().withColumn("f", F.expr("dense_rank() over (order by payment_format)"))  # one row for each format
    rows = e.withColumn("n", F.expr(f"row_number() over ({w})")).join(formats, "payment_format")
    said = F.concat_ws(",", F.date_format("timestamp", "yyyy/MM/dd HH:mm"), F.split_part("from_node", F.lit("_"), F.lit(1)), F.split_part("from_node", F.lit("_"), F.lit(2)), F.split_part("to_node", F.lit("_"), F.lit(1)), F.split_part("to_node", F.lit("_"), F.lit(2)), F.lit("0"), F.lit("US Dollar"), F.format_string("%.2f", "amount_paid"))
    line = rows.select((F.col("f") * 1_000_000_000_000 + F.col("n")).alias("line_no"), said.alias("value"))
    heads = rows.select("f", "payment_format").distinct()
    begin = heads.select((F.col("f") * 1_000_000_000_000).alias("line_no"), F.concat(F.lit("BEGIN LAUNDERING ATTEMPT - FAN-"), F.substring("payment_format", 1, 1), F.lit(":  Max 3-degree")).alias("value"))
    end = heads.select((F.col("f") * 1_000_000_000_000 + 999_999_999_999).alias("line_no"), F.lit("END LAUNDERING ATTEMPT").alias("value"))
    found = tables.parse_patterns(line.union(begin).union(end))
    return found.groupBy("attempt_id", "typology").agg(F.count("*").alias("n"), F.round(F.sum("amount_paid"), 2).alias("amount"), F.count_distinct("from_node").alias("senders"), F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm").alias("first"))


# Validation


@query
def drop_missing_ts(spark, d):
    return split.drop_missing_timestamps(_holed(spark, d)).select(ID)


@query
def dup_rows(spark, d):
    return validate.duplicate_rows(payments_orders(spark, d).select("customer_id", "payment_timestamp", "payment_method"))


@query
def dup_keys(spark, d):
    return validate.duplicate_keys(payments_orders(spark, d).select(F.col("customer_id").alias(ID)))


def _odd(spark, d):
    k = F.col(ID)
    return payments_events(spark, d).withColumns({
        "amount_usd_equivalent": F.when(k % 13 == 0, -F.col("amount_usd_equivalent")).otherwise(F.col("amount_usd_equivalent")), "transaction_hour": (k % 26).cast("int") - 1,
        "ip_risk_score": F.col("ip_risk_score") + F.when(k % 17 == 0, 1.0).otherwise(0.0), "payment_timestamp": F.when(k % 19 != 0, F.col("payment_timestamp")),
    })


@query
def range_checks(spark, d):
    return validate.range_checks(_odd(spark, d))


@query
def missing_values(spark, d):
    return validate.missing_values(_holed(spark, d))


@query
def validation_report(spark, d):
    return validate.validate(_odd(spark, d)).where("check not in ('missing_column', 'wrong_type')")


# History and derived features


def _history(*columns, source=payments_events):
    return lambda spark, d: history.customer_history(source(spark, d)).select(ID, *columns)


for _name, _columns in {
    "hist_txn_count_30d": ["customer_txn_count_30d"], "hist_unique_devices_30d": ["customer_unique_devices_30d"], "hist_unique_countries_30d": ["customer_unique_countries_30d"],
    "hist_merchant_exposure_30d": ["customer_unique_merchants_30d"], "hist_failed_7d": ["customer_failed_payments_7d"], "freq_24h_7d": ["transaction_frequency_24h", "transaction_frequency_7d"],
    "new_device_flag": ["new_device_flag"], "new_country_flag": ["new_country_flag"],
}.items():
    QUERIES[_name] = _history(*_columns)
QUERIES["hist_avg_amount_30d"] = lambda spark, d: history.customer_history(payments_events(spark, d)).select(ID, *_r("customer_avg_amount_30d", digits=4))
QUERIES["hist_ties_orders"] = _history("customer_txn_count_30d", "customer_unique_devices_30d", "customer_failed_payments_7d", "new_device_flag", source=payments_orders)


@query
def derived_ratios(spark, d):
    df = payments_events(spark, d)
    df = df.withColumns({"ip_risk_score": F.when(F.col(ID) % 3 != 0, F.col("ip_risk_score"))})
    return history.derived_features(df).select(ID, *_r("product_diversity_ratio", "merchant_diversity_ratio", "account_instrument_age_ratio", "combined_risk_score"))


@query
def feature_pipeline(spark, d):
    return history.feature_engineering(payments_events(spark, d)).select(ID, *_r("amount_vs_customer_avg_ratio", "txn_frequency_ratio_24h_7d", "failed_payment_ratio_7d", "combined_risk_score", digits=4))


# Rules


@query
def structuring_rule(spark, d):
    out = rules.structuring_rule(payments_events(spark, d), SETTINGS)
    return out.select(ID, *_r("trailing_24h_amount_sum", "trailing_24h_amount_max", digits=2), "applicable_threshold_usd", "near_threshold_flag", "structuring_flag")


@query
def structuring_orders(spark, d):
    return rules.structuring_rule(payments_orders(spark, d), SETTINGS).select(ID, *_r("trailing_24h_amount_sum", digits=2), "near_threshold_flag", "structuring_flag")


@query
def threshold_rule(spark, d):
    return rules.threshold_rule(payments_events(spark, d), SETTINGS).select(ID, "threshold_exceeded_flag")


@query
def near_threshold(spark, d):
    return rules.structuring_rule(payments_events(spark, d), SETTINGS).where("near_threshold_flag = 1").select(ID, "applicable_threshold_usd")


@query
def sanctions_tier(spark, d):
    return rules.sanctions_rule(payments_events(spark, d), SETTINGS).select(ID, "country_risk_tier", "country_risk_score", "sanctions_country_flag")


@query
def tier_counts(spark, d):
    return rules.tier_counts(rules.sanctions_rule(payments_events(spark, d), SETTINGS))


@query
def geo_mismatch(spark, d):
    return rules.geo_risk_rules(history.customer_history(payments_events(spark, d)), SETTINGS).select(ID, "geo_mismatch_flag")


@query
def high_risk_corridor(spark, d):
    return rules.geo_risk_rules(payments_events(spark, d), SETTINGS).select(ID, "high_risk_corridor_flag")


@query
def velocity_score(spark, d):
    return rules.velocity_score(history.customer_history(payments_events(spark, d)), SETTINGS).select(ID, "velocity_score", "velocity_flag")


@query
def simple_flags(spark, d):
    return rules.simple_flags(payments_events(spark, d), SETTINGS).select(ID, "ip_risk_flag", "young_account_flag")


def _ruled(spark, d):
    return with_rule_name(rules.rule_engine(history.feature_engineering(payments_events(spark, d)), SETTINGS))


@query
def rule_engine(spark, d):
    return _ruled(spark, d).select(ID, *rules.FLAGS, "fraud_rule_name")


@query
def rule_report(spark, d):
    return rules.rule_report(_ruled(spark, d))


# Preprocessing


def _split(spark, d):
    return split.time_based_split(payments_orders(spark, d))


@query
def time_split(spark, d):
    return _split(spark, d).select(ID, "split")


@query
def impute_median_mode(spark, d):
    rows = split.time_based_split(split.drop_missing_timestamps(_holed(spark, d)))
    return encode.Imputer.fit(rows.where("split = 'train'")).apply(rows).select(ID, "amount_usd_equivalent", "payment_method", "transaction_channel")


@query
def ordinal_encode(spark, d):
    return encode.ordinal_encode(payments_events(spark, d)).select(ID, *ORDINAL)


@query
def one_hot(spark, d):
    rows = _split(spark, d).select(ID, "split", "payment_method")
    return encode.OneHot.fit(rows.where("split = 'train'")).apply(rows).drop("split")


@query
def frequency_encode(spark, d):
    rows = _split(spark, d).select(ID, "split", "counterparty_country", "device_id")
    return encode.frequency_encode(rows, rows.where("split = 'train'")).select(ID, *_r("counterparty_country", "device_id"))


@query
def log_transform(spark, d):
    return encode.log_transform(_odd(spark, d).select(ID, "amount_usd_equivalent", "item_count")).select(ID, *_r("amount_usd_equivalent", "item_count"))


@query
def timestamp_features(spark, d):
    return encode.timestamp_features(payments_events(spark, d)).select(ID, "transaction_hour", "day_of_week", "day_of_month", "month", "is_weekend", "is_night", "is_business_hour")


@query
def preprocess_pipeline(spark, d):
    out = preprocess(payments_events(spark, d))
    return out.select(ID, "split", "amount_usd_equivalent_raw", *_r("amount_usd_equivalent", "customer_txn_count_30d", "device_id", digits=5), "kyc_level", "transaction_channel_MOBILE", "is_weekend")


@query
def preprocess_counts(spark, d):
    return preprocess_report(preprocess(payments_events(spark, d))).select("split", "rows")


# Statistics


def _parts(spark, d):
    rows = _split(spark, d).withColumn("amount_usd_equivalent_raw", F.col("amount_usd_equivalent"))
    return rows.where("split = 'train'"), rows


@query
def double_mad(spark, d):
    return stats.statistical_detection(*_parts(spark, d)).select(ID, *_r("amount_usd_equivalent_raw_mad_score"))


@query
def stat_flags(spark, d):
    return stats.statistical_detection(*_parts(spark, d), threshold=1.2).select(ID, "amount_usd_equivalent_raw_mad_flag", "statistical_anomaly_flag")


@query
def zscore_flags(spark, d):
    return stats.zscore_flags(*_parts(spark, d), "amount_usd_equivalent", 1.5).select(ID, "amount_usd_equivalent_zscore_flag")


@query
def iqr_flags(spark, d):
    return stats.iqr_flags(*_parts(spark, d), "amount_usd_equivalent", 0.4).select(ID, "amount_usd_equivalent_iqr_flag")


@query
def percentile_flags(spark, d):
    return stats.percentile_flags(*_parts(spark, d), "amount_usd_equivalent").select(ID, "amount_usd_equivalent_percentile_flag")


@query
def standard_scale(spark, d):
    train, rows = _parts(spark, d)
    return stats.Scaler.fit(train, ["amount_usd_equivalent", "item_count"]).apply(rows).select(ID, *_r("amount_usd_equivalent", "item_count"))


@query
def minmax_invert(spark, d):
    train, rows = _parts(spark, d)
    low, high = train.agg(F.min("amount_usd_equivalent"), F.max("amount_usd_equivalent")).first()
    return stats.minmax_invert(rows, "amount_usd_equivalent", low, high, "score").select(ID, *_r("score"))


# Labels, metrics, fusion


@query
def risk_multiplier(spark, d):
    return labels.risk_multiplier(payments_events(spark, d)).select(ID, "risk_multiplier")


@query
def analyst_labels(spark, d):
    return labels.analyst_confirmation(_ruled(spark, d), SETTINGS).select(ID, "fraud_rule_name", "analyst_confirmed_label")


@query
def label_report(spark, d):
    return labels.label_report(labels.analyst_confirmation(_ruled(spark, d), SETTINGS))


def _scored(spark, d):
    """Transfers with a fixed score, many of them tied."""
    return edges(spark, d).select(F.col("is_laundering").alias("y"), (F.floor(F.col("amount_paid") / 500) / 200 + F.col("is_laundering") * 0.05).alias("score"))


@query
def confirmation_rates(spark, d):
    return labels.confirmation_rates(labels.analyst_confirmation(_ruled(spark, d), SETTINGS)).select("rule", *_r("rate"))


@query
def scale_pos_weight(spark, d):
    return metrics.scale_pos_weight(_scored(spark, d), "y").select(*_r("scale_pos_weight"))


@query
def best_f1_threshold(spark, d):
    return metrics.best_threshold(_scored(spark, d), "y", "score").select(*_r("threshold", "f1"))


@query
def classification_metrics(spark, d):
    return metrics.classification_metrics(_scored(spark, d), "y", "score", 0.5).select(*_r("precision", "recall", "f1", "roc_auc", "average_precision"))


SIGNALS = {"rules": "ip_risk_score", "xgboost": "amount_risk_score", "unsupervised": "device_risk_score"}


@query
def risk_fusion(spark, d):
    rows = payments_events(spark, d).withColumn("ip_risk_score", F.when(F.col(ID) % 3 != 0, F.col("ip_risk_score")))
    return fusion.risk_fusion(rows, SIGNALS).select(ID, *_r("risk_score", digits=9))


@query
def alert_severity(spark, d):
    rows = fusion.risk_fusion(payments_events(spark, d), SIGNALS).withColumn("risk_score", F.round("risk_score", 3) + 0.0001)
    return fusion.alert_severity(rows).select(ID, "alert_severity")


# Graphs

EDGE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query
def edge_features(spark, d):
    out = graph.transaction_features(edges(spark, d), start="1995-01-01")
    return out.select(*EDGE, F.col("day").cast("int").alias("day"), *_r("log_amount"), F.col("payment_format_code").cast("int").alias("payment_format_code"), "cross_bank")


def _graph(*columns, days=4):
    return lambda spark, d: graph.graph_features(edges(spark, d), days).select(*EDGE, "day", "amount_paid", *columns)


QUERIES["trailing_degrees"] = _graph("src_out_degree", "src_out_count", "src_in_degree", "dst_in_degree", "dst_in_count", "dst_out_degree")
QUERIES["reciprocal_edge"] = lambda spark, d: graph.reciprocal_edges(edges(spark, d), 90).select(*EDGE, "day", "amount_paid", "reciprocal_edge")
QUERIES["reciprocal_edge_4d"] = _graph("reciprocal_edge")
QUERIES["passthrough"] = _graph("src_passthrough", "dst_passthrough", days=30)


@query
def attempt_recall(spark, d):
    """Recall on the test days, which are a split of the operator's own."""
    e = split.day_split(edges(spark, d), "day", TRAIN_DAY, TEST_DAY).where("split = 'test'")
    flagged = e.select("timestamp", "from_node", "to_node", "amount_paid", (F.col("l_orderkey") % 7 == 0).cast("int").alias("flag"))
    patterns = e.where("is_laundering = 1").select((F.col("l_orderkey") % 97).alias("attempt_id"), F.col("payment_format").alias("typology"), "timestamp", "from_node", "to_node", "amount_paid")
    return graph.attempt_recall(flagged, patterns).select("typology", "caught", "total", *_r("rate"))


@query
def ring_edges(spark, d):
    return rings.benchmark_edges(spark).where("true_ring_id is not null")


@query
def connected_components(spark, d):
    """All transfers, linking accounts within a day."""
    at = lambda c: F.concat_ws("@", c, F.col("day").cast("string"))
    return components.connected_components(edges(spark, d).select(at("from_node").alias("src"), at("to_node").alias("dst")))


@query
def account_components(spark, d):
    """The account graph over all transfers: one node for each account, whatever the day."""
    return components.connected_components(edges(spark, d).select(F.col("from_node").alias("src"), F.col("to_node").alias("dst")))


@query
def ring_benchmark(spark, d):
    return rings.ring_recovery(rings.benchmark_edges(spark))


@query
def false_groups(spark, d):
    """Customers paying an account of their nation; every fifth nation is a ring."""
    customer = spark.read.parquet(f"{d}/customer.parquet")
    pays = customer.select(F.col("c_custkey").cast("long").alias("customer_id"), (F.col("c_nationkey") + 1_000_000).cast("long").alias("counterparty_account_id"), F.expr("if(c_nationkey % 5 = 0, c_nationkey, null)").alias("true_ring_id"))
    return rings.false_groups(pays)


@query
def transfer_file(spark, d):
    """All transfers written as a transfer file and read back."""
    part = lambda c, i: F.split_part(F.col(c), F.lit("_"), F.lit(i))
    e = edges(spark, d).select(
        F.date_format("timestamp", "yyyy/MM/dd HH:mm").alias("Timestamp"), part("from_node", 1).alias("From Bank"), part("from_node", 2).alias("Account"), part("to_node", 1).alias("To Bank"), part("to_node", 2).alias("Account.1"),
        F.col("amount_paid").alias("Amount Received"), F.lit("Euro").alias("Receiving Currency"), F.col("amount_paid").alias("Amount Paid"), F.lit("Euro").alias("Payment Currency"), F.col("payment_format").alias("Payment Format"), F.col("is_laundering").cast("int").alias("Is Laundering"),
    )
    path = f"{components.shared_folder(spark)}/quaylight-transfers-{uuid.uuid4().hex}"
    e.write.option("header", True).csv(path)
    return tables.read_transfers(spark, path).select(F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("at"), "from_node", "to_node", *_r("amount_paid", digits=2), "payment_format", "is_laundering")


# Models: results of a fit, checked for rows only


def _modelled(spark, d):
    labelled = labels.analyst_confirmation(_ruled(spark, d), SETTINGS).select(ID, "analyst_confirmed_label")
    rows = preprocess(payments_events(spark, d)).join(labelled, ID)
    features = [c for c in feature_columns(rows.schema) if c != "analyst_confirmed_label" and c != "amount_usd_equivalent_raw"]
    return rows.na.fill(0.0, features).cache(), features


@query
def isolation_forest(spark, d):
    rows, features = _modelled(spark, d)
    forest = anomaly.IsolationForest.fit_table(rows.where("split = 'train'"), features)
    return anomaly.score_with(rows, forest, features, "isolation_forest_score").select(ID, "isolation_forest_score")


@query
def one_class(spark, d):
    rows, features = _modelled(spark, d)
    scaled = stats.Scaler.fit(rows.where("split = 'train'"), features).apply(rows)
    machine = anomaly.OneClass.fit_table(scaled.where("split = 'train'"), features)
    return anomaly.score_with(scaled, machine, features, "ocsvm_score").select(ID, "ocsvm_score")


@query
def unsupervised_ensemble(spark, d):
    rows, features = _modelled(spark, d)
    return anomaly.unsupervised_detection(rows.where("split = 'train'"), rows, features).select(ID, "unsupervised_anomaly_score", "unsupervised_anomaly_flag")


@query
def gbt_scores(spark, d):
    rows, features = _modelled(spark, d)
    booster = supervised.fit_booster(rows.where("split = 'train'"), features, "analyst_confirmed_label")
    return supervised.predict(rows.where("split = 'test'"), booster).select(ID, "fraud_probability")


@query
def random_forest_scores(spark, d):
    rows, features = _modelled(spark, d)
    return supervised.predict(rows.where("split = 'test'"), supervised.fit_random_forest(rows.where("split = 'train'"), features, "analyst_confirmed_label"), "random_forest_probability").select(ID, "random_forest_probability")


@query
def logistic_scores(spark, d):
    rows, features = _modelled(spark, d)
    return supervised.predict(rows.where("split = 'test'"), supervised.fit_logistic(rows.where("split = 'train'"), features, "analyst_confirmed_label"), "logistic_probability").select(ID, "logistic_probability")


@query
def model_properties(spark, d):
    """For each model its test rows, and how many of them lack a probability or have one out of 0..1; for the explanations those that don't add up to the margin."""
    rows, features = _modelled(spark, d)
    train, test, label = rows.where("split = 'train'"), rows.where("split = 'test'"), "analyst_confirmed_label"
    booster = supervised.fit_booster(train, features, label)
    models = {"boosted_trees": booster, "random_forest": supervised.fit_random_forest(train, features, label), "logistic": supervised.fit_logistic(train, features, label)}
    wrong = "count_if(p is null or not p between 0 and 1)"
    out = [supervised.predict(test, m, "p").agg(F.lit(name).alias("model"), F.count("*").alias("scored"), F.expr(wrong).alias("wrong")) for name, m in models.items()]
    base = booster.margin_base()
    off = F.abs(F.expr("aggregate(shap_values, 0D, (a, x) -> a + x)") + base - F.log(F.col("p") / (1 - F.col("p")))) > 1e-6
    out.append(supervised.shap_values(supervised.predict(test, booster, "p"), booster).agg(F.lit("shap").alias("model"), F.count("*").alias("scored"), F.count_if(off).alias("wrong")))
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query
def shap_top_features(spark, d):
    rows, features = _modelled(spark, d)
    scored, _ = supervised.supervised_detection(rows.where("split = 'train'"), rows.where("split = 'test'"), features)
    return scored.select(ID, "fraud_probability", "fraud_prediction_flag", "top_shap_features")


@query
def graph_ablation(spark, d):
    """(model, precision, recall, f1, roc_auc, average_precision) with and without graph features, tuned on validation days."""
    plain = ["log_amount", "payment_format_code", "cross_bank"]
    more = ["src_out_degree", "src_out_count", "src_in_degree", "dst_in_degree", "dst_in_count", "dst_out_degree", "src_passthrough", "dst_passthrough", "reciprocal_edge"]
    # Only what the models read goes through the joins, with the keys, by which sampled rows are told apart; other columns would be sent with it.
    slim = graph.transaction_features(edges(spark, d), start="1995-01-01").select("l_orderkey", "l_linenumber", "from_node", "to_node", "day", "is_laundering", *plain)
    rows = split.day_split(graph.graph_features(slim), "day", TRAIN_DAY, TEST_DAY).drop("from_node", "to_node").na.fill(0)
    rows = components.stored(rows, "transfers")
    scored = lambda part, booster: components.stored(supervised.predict(rows.where(f"split = '{part}'"), booster).select("is_laundering", "fraud_probability"), "scores")  # noqa: E731  metrics take several passes
    out = None
    for name, features in (("transaction", plain), ("transaction_graph", plain + more)):
        booster = supervised.fit_booster(rows.where("split = 'train'"), features, "is_laundering", trees=300, depth=6)
        tuned = metrics.best_threshold(scored("validation", booster), "is_laundering", "fraud_probability").first()
        found = metrics.classification_metrics(scored("test", booster), "is_laundering", "fraud_probability", tuned.threshold if tuned else 0.5)
        found = found.select(F.lit(name).alias("model"), "*")
        out = found if out is None else out.unionByName(found)
    return out
