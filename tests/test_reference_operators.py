"""The payment operators on small fixtures with results worked out by hand."""

import datetime as dt
import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight import config, contract
from quaylight.functions import quantiles, windows
from quaylight.operators import anomaly, blocks, components, encode, fusion, graph, history, labels, metrics, rings, rules, split, stats, supervised, trees, validate
from quaylight.plans import queries
from quaylight.plans.preprocess import preprocess
from quaylight.sources import tables
from quaylight.sources.adapters import edges, payments_events
from quaylight.streaming import rules as streams


def ts(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def rows(df, *columns, order="payment_id"):
    return [tuple(r) for r in df.orderBy(order).select(*columns).collect()]


PAY = "payment_id long, customer_id long, payment_timestamp timestamp, amount_usd_equivalent double, counterparty_country string"


def test_structuring_fixture(spark):
    us = "United States"
    df = spark.createDataFrame([(1, 1, ts(1, 8), 4000.0, us), (2, 1, ts(1, 14), 4000.0, us), (3, 1, ts(1, 20), 4000.0, us), (4, 2, ts(1, 9), 9800.0, us), (5, None, ts(1), 1.0, us)], PAY)
    got = rows(rules.structuring_rule(df), "trailing_24h_amount_sum", "near_threshold_flag", "structuring_flag")
    assert got == [(4000.0, 0, 0), (8000.0, 0, 0), (12000.0, 0, 1), (9800.0, 1, 0)]


def test_frames_include_their_bound_and_earlier_ties(spark):
    df = spark.createDataFrame([(1, 1, ts(1), 1.0, "a"), (2, 1, ts(2), 2.0, "a"), (3, 1, ts(2), 4.0, None), (4, 1, ts(2), 8.0, None), (5, 1, ts(3, 0, 1), 16.0, "b"), (6, 2, ts(2), 9.0, "a")], PAY)
    df = df.withColumns({"device_id": F.lit("d"), "payment_status": F.when(F.col("payment_id") == 2, "failed").otherwise("ok")})
    got = history.customer_history(df)
    assert rows(got, "transaction_frequency_24h", "customer_txn_count_30d", "customer_avg_amount_30d", "customer_unique_countries_30d", "customer_failed_payments_7d", "new_device_flag", "new_country_flag") == [
        (0, 0, 0, 0, 0, 1, 1), (1, 1, 1, 1, 0, 0, 0), (2, 2, 1.5, 1, 1, 0, 1), (3, 3, 7 / 3, 2, 1, 0, 0), (0, 4, 3.75, 2, 1, 0, 1), (0, 0, 0, 0, 0, 1, 1),
    ]
    assert rows(rules.trailing_24h(df), "trailing_24h_amount_sum", "trailing_24h_amount_max") == [(1, 1), (3, 2), (7, 4), (15, 8), (16, 16), (9, 9)]
    again = history.customer_history(df.repartition(3)).select("payment_id", "customer_avg_amount_30d").orderBy("payment_id").collect()
    assert again == got.select("payment_id", "customer_avg_amount_30d").orderBy("payment_id").collect()


def test_rule_fixtures(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 10.0), (2, 12.0, 30.0), (3, 20.0, 60.0), (4, None, 1.0)], "payment_id long, transaction_frequency_24h double, transaction_frequency_7d double")
    assert rows(rules.velocity_score(v), "velocity_score", "velocity_flag") == [(0.0, 0), (0.3929, 0), (0.8286, 1), (0.9571, 1), (None, 0)]
    c = spark.createDataFrame([(0, "Iran"), (1, "China"), (2, "United Arab Emirates"), (3, "India"), (4, "Germany"), (5, None)], "payment_id long, counterparty_country string")
    assert rows(rules.sanctions_rule(c), "country_risk_score", "sanctions_country_flag") == [(1.0, 1), (0.45, 0), (0.35, 0), (0.2, 0), (0.2, 0), (0.2, 0)]
    t = spark.createDataFrame([(i, x) for i, x in enumerate([50.0, 5000.0, 1e6, None])], "payment_id long, amount_usd_equivalent double")
    assert rows(rules.threshold_rule(t), "threshold_exceeded_flag") == [(0,), (0,), (1,), (0,)]
    g = spark.createDataFrame([(0, "Iran", 1, "INBOUND", 1000.0), (1, "India", 1, "outbound", 20000.0), (2, "Iran", 0, "outbound", 20000.0), (3, "Iran", 0, None, 20000.0)], "payment_id long, counterparty_country string, new_country_flag int, transaction_direction string, amount_usd_equivalent double")
    assert rows(rules.geo_risk_rules(g), "geo_mismatch_flag", "high_risk_corridor_flag") == [(1, 0), (0, 0), (0, 1), (0, 0)]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "train", 100.0, "HIGH", "UPI", "India"), (2, "train", None, None, "CARD", "India"), (3, "train", 100.0, "LOW", None, "China"), (4, "test", None, "ODD", "NETBANKING", "Germany")], "payment_id long, split string, amount_usd_equivalent double, kyc_level string, payment_method string, counterparty_country string")
    train = df.where("split = 'train'")
    assert rows(encode.Imputer.fit(train).apply(df), "amount_usd_equivalent", "kyc_level")[1] == (100.0, "HIGH")
    assert rows(encode.ordinal_encode(df), "kyc_level") == [(2,), (None,), (0,), (None,)]
    hot = encode.OneHot.fit(train, ["payment_method"]).apply(df)
    assert rows(hot, "payment_method_CARD", "payment_method_UPI") == [(0, 1), (1, 0), (0, 0), (0, 0)] and "payment_method" not in hot.columns
    assert [x[0] for x in rows(encode.frequency_encode(df, train), "counterparty_country")] == pytest.approx([2 / 3, 2 / 3, 1 / 3, 0.0])
    assert rows(encode.log_transform(df.withColumn("amount_usd_equivalent", F.lit(-30.0))), "amount_usd_equivalent")[0] == (0.0,)
    times = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 2)), (2, dt.datetime(2024, 1, 1, 14)), (3, dt.datetime(2024, 1, 6, 20))], "payment_id long, payment_timestamp timestamp")
    assert rows(encode.timestamp_features(times), "is_night", "is_business_hour", "is_weekend", "day_of_week") == [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 5)]


def test_splits(spark):
    df = spark.createDataFrame([(i, ts(1 + i // 4)) for i in range(10)], "payment_id long, payment_timestamp timestamp")
    assert [r[0] for r in rows(split.time_based_split(df, test_size=0.3), "split")] == ["train"] * 7 + ["test"] * 3
    assert {r[0] for r in rows(split.time_based_split(df, test_size=0.0), "split")} == {"train"}
    with pytest.raises(split.PreprocessingError):
        split.time_based_split(df, ts="absent")
    days = split.day_split(spark.createDataFrame([(i, i) for i in range(8)], "payment_id long, day int"))
    assert [r[0] for r in rows(days, "split")] == ["train"] * 5 + ["validation"] + ["test"] * 2


def test_validation(spark):
    df = spark.createDataFrame([(1, -5.0, 25, 0.5), (1, -5.0, 25, 1.5), (2, 10.0, -1, None), (None, 1.0, 3, None)], "payment_id long, amount_usd_equivalent double, transaction_hour int, ip_risk_score double")
    report = {(r["check"], r["column"]): (r["value"], r["failed"]) for r in validate.validate(df).collect()}
    assert report["negative_amount_usd_equivalent", ""] == (2, True) and report["invalid_transaction_hour", ""] == (3, True) and report["invalid_ip_risk_score", ""] == (1, True)
    assert report["duplicate_keys", "payment_id"] == (1, True) and report["missing_values", "ip_risk_score"] == (2, True) and report["missing_values", "payment_id"] == (1, False) and report["duplicate_rows", ""] == (0, False)
    assert len(contract.LOGICAL) == 47 and len(validate.missing_columns(df)) == 43 and not validate.passed(validate.validate(df))
    assert validate.wrong_types(df.withColumn("device_id", F.lit(1))) == {"device_id": ("string", "numeric")}


def test_quantiles_narrow_like_percentile(spark):
    rng = np.random.default_rng(1)
    values = [float(x) for x in np.round(rng.lognormal(size=3000), 3)] + [7.0] * 2000 + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = np.array(values[:-1])
    for q in (0.0, 0.25, 0.5, 0.9, 0.999, 1.0):
        assert quantiles.quantile(df, "x", q, small=100) == pytest.approx(np.quantile(known, q)) == pytest.approx(quantiles.quantile(df, "x", q))
    assert quantiles.quantile(df.where("x is null"), "x", 0.5) is None


def test_double_mad_and_scaling(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 2.0, 3.0, 4.0, 100.0, None])], "payment_id long, x double")
    mad = stats.DoubleMad.fit(df, "x")
    assert (mad.median, mad.below, mad.above) == (3.0, 1.0, 1.0)
    assert rows(mad.apply(df, "x"), "x_mad_flag") == [(0,), (0,), (0,), (0,), (1,), (0,)]
    flat = stats.DoubleMad.fit(df.withColumn("x", F.lit(5.0)), "x")
    assert rows(flat.apply(df.withColumn("x", F.lit(5.0)), "x"), "x_mad_score")[0] == (0.0,)
    assert stats.Scaler.fit(df.withColumn("x", F.lit(5.0)), ["x"]).stats == {"x": (5.0, 1.0)}
    assert rows(stats.minmax_invert(df, "x", 1.0, 1.0, "s"), "s")[0] == (1.0,)


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    s, y = np.round(rng.random(400), 2), (rng.random(400) < 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    cuts = np.unique(s)[::-1]
    p, r = np.array([y[s >= c].mean() for c in cuts]), np.array([y[s >= c].sum() / y.sum() for c in cuts])
    got = metrics.classification_metrics(df, "y", "s", 0.5).first()
    assert got.roc_auc == pytest.approx(auc) and got.average_precision == pytest.approx((np.diff(r, prepend=0) * p).sum())
    f1 = 2 * p * r / (p + r)
    best = metrics.best_threshold(df, "y", "s").first()
    assert best.f1 == pytest.approx(np.nanmax(f1)) and best.threshold == cuts[np.flatnonzero(np.isclose(f1, np.nanmax(f1)))].min()
    none = metrics.classification_metrics(df.withColumn("y", F.lit(0)), "y", "s", 0.5).first()
    assert none.f1 == 0 and none.roc_auc is None and metrics.scale_pos_weight(df.withColumn("y", F.lit(0)), "y").first()[0] == 1.0


def test_rings_and_components(spark):
    assert {(r.ring, r.status) for r in rings.ring_recovery(rings.benchmark_edges(spark)).collect()} == {(1, "full"), (2, "full"), (3, "full")}
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (300, 300), (None, 1)], "src long, dst long")
    got = {r.node: r.component for r in components.connected_components(chain).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200, 300: 300}


def test_graph_before_day_zero(spark):
    df = spark.createDataFrame([("a", "b", -1), ("a", "b", 0), ("b", "a", 3), ("a", "c", 4), ("a", "c", 4)], "from_node string, to_node string, day int")
    got = graph.graph_features(df).orderBy("day").select("day", "src_out_degree", "src_out_count", "reciprocal_edge", "src_passthrough").collect()
    assert [tuple(r) for r in got] == [(-1, None, None, None, None), (0, 1, 1, 0, 0), (3, 1, 1, 1, 1), (4, 1, 2, 0, 1), (4, 1, 2, 0, 1)]


def test_shap_adds_up_and_models_rank(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + 0.2 * rng.normal(size=400) > 0.8).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "payment_id long, a double, b double, c double, d double, y int")
    names = ["a", "b", "c", "d"]
    booster = supervised.fit_booster(df, names, "y", trees=6, depth=3)
    got = supervised.shap_values(supervised.predict(df, booster), booster).collect()
    for r in got:
        assert sum(r.shap_values) + booster.margin_base() + sum(leaf["value"] for leaf in booster.leaves if not leaf["feature"]) * 0 == pytest.approx(np.log(r.fraud_probability / (1 - r.fraud_probability)), abs=1e-6)
    scored, found = supervised.supervised_detection(df.where("payment_id < 300"), df.where("payment_id >= 300"), names, "y", trees=6, depth=3)
    assert found.first().roc_auc > 0.8 and scored.first().top_shap_features.count("(") == 3
    assert supervised.global_top_features(supervised.shap_values(df, booster), names, 1).first().feature == "a"
    for other in (supervised.fit_random_forest(df, names, "y", trees=10), supervised.fit_logistic(df, names, "y")):
        assert metrics.classification_metrics(supervised.predict(df, other), "y", "fraud_probability", 0.5).first().roc_auc > 0.8
    odd = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.vstack([rng.normal(size=(300, 2)), [[9.0, 9.0], [-9.0, 8.0]]]))], "payment_id long, a double, b double")
    top = anomaly.unsupervised_detection(odd, odd, ["a", "b"]).orderBy(F.desc("unsupervised_anomaly_score")).limit(2).collect()
    assert {r.payment_id for r in top} == {300, 301} and all(0 <= r.unsupervised_anomaly_score <= 1 for r in top)


def test_anomaly_models_cover_all_training_rows(spark):
    """A group that a bounded sample by hash would see little of counts in the fit; trees draw from all rows."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(9000, 2)), rng.normal(6, 0.3, size=(3000, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "payment_id long, a double, b double").repartition(3)
    assert len(anomaly.sample(df, ["a", "b"], 500)) == 500 and len(anomaly.sample(df, ["a", "b"], 50_000)) == 12_000
    assert (anomaly.sample(df, ["a", "b"], 500) == anomaly.sample(df.repartition(7), ["a", "b"], 500)).all()
    machine = anomaly.OneClass.fit_table(df, ["a", "b"], nu=0.1)
    scores = machine.score(x)
    assert abs((scores < 0).mean() - 0.1) < 1e-3  # the offset is the exact quantile over all rows
    assert machine.score(np.array([[30.0, -30.0]]))[0] < 0 < machine.score(np.array([[6.0, 6.0], [0.0, 0.0]])).min()
    n, total = machine.outside(df, ["a", "b"])
    assert abs(n - (scores < 0).sum()) <= 1 and np.allclose(total, machine.features(x)[scores < 0].sum(0), atol=0.2)
    forest = anomaly.IsolationForest.fit_table(df, ["a", "b"])
    assert forest.score(np.array([[30.0, -30.0]]))[0] > forest.score(x).mean() + 0.1
    empty = df.where("payment_id < 0")
    assert anomaly.OneClass.fit_table(empty, ["a", "b"]).rho == 0.0 and len(anomaly.IsolationForest.fit_table(empty, ["a", "b"]).roots) == anomaly.TREES


def test_labels_and_fusion(spark):
    df = spark.createDataFrame([(i, 1, 100.0, "HIGH", 1, 1, "sanctions_country" if i % 2 else None) for i in range(2000)], "payment_id long, customer_id long, amount_usd_equivalent double, customer_risk_segment string, device_shared_flag int, repeated_beneficiary_flag int, fraud_rule_name string")
    out = labels.analyst_confirmation(df)
    assert out.first().risk_multiplier == 2.5
    share = out.where("payment_id % 2 = 1").agg(F.avg("analyst_confirmed_label")).first()[0]
    assert 0.15 < share < 0.25 and out.where("payment_id % 2 = 0 and analyst_confirmed_label = 1").count() == 0
    s = spark.createDataFrame([(1, 0.5, None), (2, 1.0, 0.0), (3, None, None)], "payment_id long, r double, u double")
    got = fusion.alert_severity(fusion.risk_fusion(s, {"rules": "r", "unsupervised": "u"}))
    assert rows(got, "alert_severity") == [("medium",), ("medium",), (None,)]


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("rules:\n  large_transaction: 5\n")
    assert config.load(config.Thresholds, tmp_path / "a.yaml", "rules").large_transaction == 5
    for name, text in (("b.yaml", ""), ("c.yaml", "a: ["), ("d.yaml", "x: 1")):
        (tmp_path / name).write_text(text)
        with pytest.raises(config.ConfigError):
            config.load(config.Thresholds, tmp_path / name)
    with pytest.raises(config.ConfigError):
        config.Thresholds(fusion_weights={"rules": 0.5})
    with pytest.raises(config.ConfigError):
        config.load_yaml(tmp_path / "none.yaml")


def test_sources(spark, tmp_path):
    good = tmp_path / "t.csv"
    good.write_text("payment_id;x\n1;2.5\n2;NaN\n")
    assert [tuple(r) for r in tables.read_csv(spark, config.CsvConfig(str(good), delimiter=";")).collect()] == [(1, 2.5), (2, None)]
    (tmp_path / "empty.csv").write_text("")
    for bad in (tmp_path, tmp_path / "none.csv", tmp_path / "empty.csv"):
        with pytest.raises(tables.IngestionError):
            tables.read_csv(spark, config.CsvConfig(str(bad)))
    with pytest.raises(ValueError):
        tables.limited(spark.range(3), 0)
    with pytest.raises(tables.IngestionError):
        tables.jdbc_url(config.JdbcConfig(trusted_connection=False))
    transfers = tmp_path / "trans.csv"
    transfers.write_text("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n2022/09/01 00:20,010,8000,010,8000,1,US Dollar,1,US Dollar,Reinvestment,0\n2022/09/01 00:21,010,8000,03208,8001,1,US Dollar,1.5,US Dollar,Cheque,1\n")
    got = tables.read_transfers(spark, str(transfers)).collect()
    assert [(r.from_node, r.to_node, r.amount_paid, r.timestamp) for r in got] == [("010_8000", "03208_8001", 1.5, dt.datetime(2022, 9, 1, 0, 21))]
    assert tables.read_transfers(spark, str(transfers), drop_self_transfers=False).count() == 2
    patterns = tmp_path / "p.txt"
    patterns.write_text("BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 2\n2022/09/01 00:06,021174,800737690,012,80011F990,2848.96,Euro,2848.96,Euro,ACH,1\nEND LAUNDERING ATTEMPT - FAN-OUT\n\nBEGIN LAUNDERING ATTEMPT - CYCLE\n2022/09/02 00:06,1,a,2,b,1,Euro,3.5,Euro,ACH,1\n")
    assert [tuple(r)[:2] + (r.from_node, r.amount_paid) for r in tables.read_patterns(spark, str(patterns)).orderBy("attempt_id").collect()] == [(0, "FAN-OUT", "021174_800737690", 2848.96), (1, "CYCLE", "1_a", 3.5)]


def test_rest_source(spark):
    answers = {"/list": [{"a": 1}, {"a": 2}], "/keyed": {"records": [{"a": 3}]}, "/one": {"a": 4}, "/bad": None}
    tries = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path = self.path.split("?")[0]
            tries.append(path)
            self.send_response(503 if path == "/down" or path == "/flaky" and tries.count("/flaky") == 1 else 404 if path == "/none" else 200)
            self.end_headers()
            self.wfile.write(b"{" if path == "/bad" else json.dumps(answers.get(path, [{"a": 5}])).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    ask = lambda path, **k: tables.read_api(spark, config.ApiConfig(url + path, backoff_factor=0.01, **k), "a int")
    assert [r.a for r in ask("/list", params={"q": "x y"}).collect()] == [1, 2] and ask("/keyed").first().a == 3 and ask("/one").first().a == 4 and ask("/flaky").first().a == 5
    for path, more in (("/none", {}), ("/down", {}), ("/bad", {}), ("/keyed", {"data_key": "absent"})):
        with pytest.raises(tables.IngestionError):
            ask(path, **more)
    assert tries.count("/down") == 4 and tries.count("/none") == 1
    server.shutdown()


def test_preprocess_legacy_switches(spark):
    from quaylight.sources.adapters import payments_events

    df = payments_events(spark, "/root/testdata/sf0.001")
    new, old = preprocess(df), preprocess(df, legacy_drop_engineered=True, log_passes=2)
    assert "customer_txn_count_30d" in new.columns and "customer_txn_count_30d" not in old.columns
    assert new.where("split = 'train'").count() == 800 and new.count() == 1000
    raw, once = new.select("amount_usd_equivalent_raw", "amount_usd_equivalent").first()
    assert once == pytest.approx(np.log1p(raw))


def test_streams_equal_batch(spark, tmp_path):
    us = "United States"
    data = [(i, i % 3, ts(1 + i // 5, i % 5 * 4), 3000.0 + i, us) for i in range(30)]
    df = spark.createDataFrame(data, PAY)
    for k in range(3):
        df.where(f"payment_id div 10 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(frame, name):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = run(streams.stateless_rules(source), "stateless")
    assert rows(got, "near_threshold_flag", "country_risk_tier") == rows(streams.stateless_rules(df), "near_threshold_flag", "country_risk_tier")
    got = run(streams.structuring_stream(source, lateness="40 days"), "structuring")
    assert rows(got, "trailing_24h_amount_sum", "structuring_flag") == rows(rules.structuring_rule(df), "trailing_24h_amount_sum", "structuring_flag")


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1000


def test_border_rows_over_a_million_places_back_stay_in_the_frame(spark):
    last = 1_000_001
    time = F.when(F.col("id") == last, F.lit(ts(2))).otherwise(F.when(F.col("id") == 0, F.lit(ts(1))).otherwise(F.lit(ts(1, 12))))
    keyed = windows.with_order_key(spark.range(last + 1).select(F.lit(1).alias("customer_id"), F.col("id").alias("payment_id"), time.alias("t")), "customer_id", "t", "payment_id")
    ends = keyed.where(F.col("payment_id").isin(0, last))
    assert rows(ends.withColumn("n", windows.trailing("count(*)", "customer_id", windows.DAY)), "n") == [(0,), (1,)]
    assert rows(ends.withColumn("n", windows.trailing("count(*)", "customer_id", windows.DAY - 1)), "n") == [(0,), (0,)]


def test_account_components_span_days(spark):
    d = "/root/testdata/sf0.001"
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges(spark, d).select("from_node", "to_node").distinct().collect():
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert dict(queries.QUERIES["account_components"](spark, d).collect()) == {x: find(x) for x in root}


@pytest.mark.parametrize("name, model, size", [("gbt_scores", "GBTClassifier", (100, 5)), ("random_forest_scores", "RandomForestClassifier", (100, 5)), ("shap_top_features", "GBTClassifier", (100, 5)), ("graph_ablation", "GBTClassifier", (300, 6))])
def test_model_queries_fit_the_surveyed_size(spark, monkeypatch, name, model, size):
    class Asked(Exception):
        pass

    def asked(**given):
        raise Asked(given.get("maxIter", given.get("numTrees")), given["maxDepth"])

    monkeypatch.setattr(supervised, model, asked)
    with pytest.raises(Asked) as got:
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.value.args == size


class Held:
    """A customer's state between two batches of a stream."""

    def __init__(self, watermark=0):
        self.value, self.exists, self.hasTimedOut, self.watermark = None, False, False, watermark

    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.exists = value, True

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark


def test_late_payments_within_the_watermark_keep_their_history():
    """Jan 1 00:10, Jan 2 00:30, then late Jan 2 00:05, whose day holds the first payment."""
    import pandas as pd

    batch = lambda *given: pd.DataFrame([(i, 1, t, a, "X") for i, t, a in given], columns=["payment_id", "customer_id", "payment_timestamp", "amount_usd_equivalent", "counterparty_country"])
    state, said = Held(), []
    for rows_in, mark in ((batch((1, ts(1, 0, 10), 6000.0), (2, ts(1, 0, 10), 1.0)), 0), (batch((3, ts(2, 0, 30), 6000.0)), 0), (batch((4, ts(2, 0, 5), 6000.0)), ts(1, 23, 30)), (batch((5, ts(4), 1.0)), ts(3, 23))):
        state.watermark = int(mark.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) if mark else 0
        for out in streams._trailing((1,), iter([rows_in]), state):
            said += list(out[["payment_id", "trailing_24h_amount_sum", "trailing_24h_amount_max"]].itertuples(index=False, name=None))
    assert said == [(1, 6000.0, 6000.0), (2, 6001.0, 6000.0), (3, 6000.0, 6000.0), (4, 12001.0, 6000.0), (5, 1.0, 1.0)]
    assert state.value[1] == [5]


def test_labelled_rows_are_fetched_under_a_bound(spark, monkeypatch):
    """Of a table of many partitions the driver gets little more rows than the sample has, and they are those of lowest hash."""
    df = spark.range(20_000, numPartitions=8).selectExpr("id as payment_id", "cast(id % 37 as double) as a", "cast(id % 11 as double) as b", "cast(id % 5 = 0 as int) as y")
    want = df.select(F.xxhash64(*df.columns).alias("h"), "y", "a", "b").orderBy("h").limit(1000).drop("h").collect()
    fetched, whole = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: fetched.append(table := whole(self)) or table)
    x, y, weight = supervised._sample(df, ["a", "b"], "y", 1000)
    assert np.array_equal(np.column_stack([y, x]), np.array(want, float)) and set(weight) == {1.0, 4.0}
    assert 1000 <= sum(t.num_rows for t in fetched) < 1300
    assert len(supervised._sample(df, ["a", "b"], "y", 30_000)[0]) == 20_000 and supervised._sample(df.where("a < 0"), ["a", "b"], "y", 10)[0].shape == (0, 2)


@pytest.fixture(scope="module")
def odd_labels(spark):
    """Few positives; features of few values, of a long tail, with many zeros, and far from zero; copies of rows."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 7, 6000), np.exp(rng.normal(0, 4, 6000)), rng.normal(size=6000) * (rng.random(6000) < 0.3), 1.7e9 + rng.integers(0, 900, 6000)]).astype(float)
    y = (x[:, 0] + 2 * (x[:, 2] > 0.5) + rng.normal(size=6000) > 7).astype(int)
    x, y = np.vstack([x, x[:500]]), np.append(y, y[:500])
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "payment_id long, a double, b double, c double, d double, y int")
    return df.repartition(5).cache(), ["a", "b", "c", "d"], x, y


def test_cuts_are_quantiles_of_all_rows(spark, odd_labels):
    df, names, x, _ = odd_labels
    for column, cuts in zip(x.T, blocks.quantile_cuts(df.select(*names), 4)):
        if len(np.unique(column)) <= trees.BINS:
            assert np.array_equal(cuts, trees.cuts_of(column))
        else:
            shares = np.bincount(np.searchsorted(cuts, column), minlength=len(cuts) + 1) / len(column)
            single = np.array([np.sum(column == v) for v in cuts]) / len(column)
            assert len(cuts) > 60 and (shares[:-1] <= 1 / trees.BINS + single + 3 / blocks.FINE).all()  # a bin ends with its cut's own rows


def test_boosted_trees_are_fitted_on_all_rows(spark, odd_labels, monkeypatch):
    """Beyond what the driver holds, rows stay on the executors, equal ones as one entry; the trees are those of one matrix of all rows."""
    df, names, x, y = odd_labels
    cuts = blocks.quantile_cuts(df.select(*names), 4)
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    whole = trees.GBTClassifier(maxIter=5, maxDepth=4).fit(trees.bins_of(x, cuts), cuts, y.astype(float), weight)
    monkeypatch.setattr(trees, "HELD", 2)
    monkeypatch.setattr(supervised, "blocks", lambda table, width, n: blocks.blocks(table, width, n, size=700))
    for rows_in, cells in ((df, 100), (df.repartition(2, "payment_id"), 100), (df, 25_500)):  # the last: fewer than all rows, not than different ones
        got = supervised.fit_booster(rows_in, names, "y", trees=5, depth=4, cells=cells)
        assert all(np.array_equal(getattr(a, part), getattr(b, part)) for a, b in zip(got.trees, whole) for part in ("feature", "cut", "left", "right", "value", "cover"))
    assert whole[0].cover[0] == pytest.approx(weight.sum() / 4)


def test_random_forest_is_fitted_on_all_rows(spark, odd_labels, monkeypatch):
    """Each tree draws as many rows as there are; blocks on the executors rank as well as one matrix."""
    df, names, x, y = odd_labels
    monkeypatch.setattr(trees, "TOGETHER", 4)
    monkeypatch.setattr(supervised, "blocks", lambda table, width, n: blocks.blocks(table, width, n, size=700))
    one = (y == 0).sum() / (y == 1).sum()
    found = [supervised.fit_random_forest(df, names, "y", trees=10, cells=cells) for cells in (100, 25_500, supervised.CELLS)]
    for forest in found:
        assert all(abs(t.cover[0] - 2 * (y == 0).sum()) < 6 * one * np.sqrt(y.sum()) for t in forest.trees) and len({float(t.cover[0]) for t in forest.trees}) > 5
    far, near = (f.probability(x) for f in (found[0], found[2]))
    assert np.corrcoef(far, near)[0, 1] > 0.95
    again = supervised.fit_random_forest(df.repartition(2, "payment_id"), names, "y", trees=10, cells=100)
    assert all(np.array_equal(a.value, b.value) for a, b in zip(found[0].trees, again.trees))


def test_logistic_regression_is_fitted_on_all_rows(spark, odd_labels):
    df, names, x, _ = odd_labels
    far, near = (supervised.fit_logistic(df, names, "y", cells=cells) for cells in (100, supervised.CELLS))
    assert far.probability(x) == pytest.approx(near.probability(x), abs=1e-6)


def test_models_ask_for_every_labelled_row(spark, monkeypatch):
    """Fits stopped at 100,000 rows of lowest hash."""
    df = spark.range(130_000, numPartitions=4).selectExpr("id as payment_id", "cast(id % 37 as double) as a", "cast(id % 5 = 0 as int) as y")
    seen = []
    monkeypatch.setattr(trees.GBTClassifier, "fit", lambda self, bins, cuts, y, weight: seen.append(weight.sum()) or [])
    monkeypatch.setattr(trees.RandomForestClassifier, "fit", lambda self, bins, cuts, y, weight: seen.append(weight.sum()) or [])
    monkeypatch.setattr(supervised, "_newton", lambda p, z, y, weight: seen.append(weight.sum()) or np.vstack([np.zeros(2), np.eye(2)]))
    for fit in (supervised.fit_booster, supervised.fit_random_forest, supervised.fit_logistic):
        fit(df, ["a"], "y")
    assert seen == [104_000 + 26_000 * 4.0] * 3


def test_preprocessing_computes_history_once(spark):
    plan = preprocess(payments_events(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_anomaly_scores_are_computed_once_for_quantiles(spark, monkeypatch):
    """Beyond what one aggregate does, a quantile narrows in many passes; those read scores that are stored."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(3000, 2)))], "payment_id long, a double, b double")
    plans, whole = [], quantiles.quantile
    monkeypatch.setattr(anomaly, "quantile", lambda rows, column, q: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or whole(rows, column, q, small=100))
    got = anomaly.unsupervised_detection(df, df, ["a", "b"]).agg(F.count("*"), F.sum("unsupervised_anomaly_flag")).first()
    assert got[0] == 3000 and 290 <= got[1] <= 310
    assert len(plans) == 2 and not any("Python" in p for p in plans)


def test_graph_ablation_stores_what_its_models_read(spark, monkeypatch):
    """The joins carried all columns of a transfer, and each pass of the metrics scored all rows again."""
    real, stored, read = supervised.fit_booster, {}, []
    monkeypatch.setattr(supervised, "fit_booster", lambda train, features, label, **k: read.append((train.columns, train._jdf.queryExecution().optimizedPlan().toString())) or real(train, features, label, trees=2, depth=2))
    whole = components.stored
    monkeypatch.setattr(components, "stored", lambda df, tag="components": stored.setdefault(tag, []).append(df.columns) or whole(df, tag))
    got = queries.QUERIES["graph_ablation"](spark, "/root/testdata/sf0.001").collect()
    assert [r.model for r in got] == ["transaction", "transaction_graph"] and all(0 <= r.roc_auc <= 1 for r in got)
    assert stored["scores"] == [["is_laundering", "fraud_probability"]] * 4
    assert all(not {"from_node", "timestamp", "payment_format", "l_partkey"} & {*c} and "Join" not in plan and "InMemory" not in plan for c, plan in read)


def test_trailing_degrees_take_two_exchanges(spark):
    df = spark.createDataFrame([("a", "b", 0), ("b", "a", 3), ("a", "c", 4), ("a", "c", 4)], "from_node string, to_node string, day int")
    node = graph._node_days(df, 4)
    assert node.count() == 6 and node._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
