"""DuckDB SQL of the queries' results, stated independently: self-joins, quantiles and recursion instead of window plans."""

from __future__ import annotations

_LEVEL = "case {0} % 3 when 0 then 'LOW' when 1 then 'MEDIUM' else 'HIGH' end"
EV = f"""p as (
  select event_id payment_id, user_id customer_id, ts payment_timestamp, round(value * 100, 2) amount, 'DEV_' || (k % 10) device_id, 'NATION_' || (k % 25) country, k % 25 nation,
    event_type in ('purchase', 'error') outbound, case when event_type = 'error' then 'failed' else 'success' end status, case when event_type in ('view', 'click') then 'MOBILE' else 'WEB' end channel,
    {_LEVEL.format('user_id')} kyc_level, {_LEVEL.format('(user_id + 1)')} segment, {_LEVEL.format('k')} geo_risk_level, (k % 10) / 10.0::double ip, least(value / 500, 1) amt, (k % 7) / 10.0::double dev,
    user_id * 7 % 900 account_age, k * 5 instrument_age, 1 + k % 4 merchants, 1 + k % 6 item_count, 1 + k % 5 products, k % 2 shared, (k % 5 = 0)::int beneficiary, k
  from (select *, cast(json_extract(props, '$.k') as int) k from events)
)"""
OR = """p as (
  select o_orderkey payment_id, o_custkey customer_id, o_orderdate payment_timestamp, o_totalprice amount, 'DEV_' || o_orderpriority device_id, coalesce(n, c_nationkey) nation,
    'NATION_' || coalesce(n, c_nationkey) country, case when o_orderstatus = 'F' then 'failed' else 'success' end status, coalesce(item_count, 0) item_count, c_mktsegment payment_method, o_orderpriority channel
  from orders left join customer on o_custkey = c_custkey
  left join (select l_orderkey, min(s_nationkey) n, count(*) item_count from lineitem left join supplier on l_suppkey = s_suppkey group by 1) on o_orderkey = l_orderkey
)"""
HOLED = "h as (select payment_id, customer_id, case when payment_id % 11 <> 0 then payment_timestamp end payment_timestamp, case when payment_id % 7 <> 0 then amount end amount_usd_equivalent, case when payment_id % 5 <> 0 then payment_method end payment_method, case when payment_id % 2 <> 0 then channel end transaction_channel from p)"
ODD = "q as (select * replace (case when payment_id % 13 = 0 then -amount else amount end as amount, ip + case when payment_id % 17 = 0 then 1 else 0 end as ip, case when payment_id % 19 <> 0 then payment_timestamp end as payment_timestamp), payment_id % 26 - 1 as hour from p)"
_EARLIER = "b.customer_id = a.customer_id and (b.payment_timestamp, b.payment_id) < (a.payment_timestamp, a.payment_id)"
HIST = f"""hist as (
  select a.payment_id, count(b.payment_id)::double n30, coalesce(avg(b.amount), 0) avg30, count(distinct b.device_id)::double dev30, count(distinct b.country)::double country30,
    count(*) filter (b.status = 'failed' and b.payment_timestamp >= a.payment_timestamp - interval 7 day)::double failed7,
    count(*) filter (b.payment_timestamp >= a.payment_timestamp - interval 1 day)::double n1, count(*) filter (b.payment_timestamp >= a.payment_timestamp - interval 7 day)::double n7
  from p a left join p b on {_EARLIER} and b.payment_timestamp >= a.payment_timestamp - interval 30 day group by a.payment_id
), new as (select a.payment_id, (count(*) filter (b.device_id = a.device_id) = 0)::int new_device, (count(*) filter (b.country = a.country) = 0)::int new_country from p a left join p b on {_EARLIER} group by 1)"""
THRESHOLD = "case when nation = 16 then 12000.0::double when nation between 9 and 14 then 15000.0::double else 10000.0::double end"
TRAIL = f"""trail as (
  select a.payment_id, any_value(a.amount) amount, any_value(a.nation) nation, any_value({THRESHOLD.replace('nation', 'a.nation')}) limit_usd, sum(b.amount) total, max(b.amount) top
  from p a join p b on b.customer_id = a.customer_id and (b.payment_timestamp, b.payment_id) <= (a.payment_timestamp, a.payment_id) and b.payment_timestamp >= a.payment_timestamp - interval 1 day group by 1
)"""
TIER = "case when nation in (0, 1) then 'sanctioned' when nation between 2 and 6 then 'grey_list' when nation in (7, 8) then 'moderate' when nation between 9 and 14 then 'gcc_baseline' else 'baseline' end"
NEAR, STRUCT = "(amount / limit_usd >= 0.9 and amount / limit_usd < 1)::int", "(total > limit_usd and top <= limit_usd)::int"
VELOCITY = "round_even(0.7 * least(n1 / 3.0, 1) + 0.3 * least(n7 / 21.0, 1), 4)"
RULED = f"""{EV}, {HIST}, {TRAIL}, cut as (select quantile_cont(amount, 0.9) c from p), ruled as (
  select p.*, n1, (p.amount >= 30000)::int over_flag, {NEAR.replace('amount', 'trail.amount')} near_flag, {STRUCT} structuring, (p.nation in (0, 1))::int sanctioned,
    (new_country = 1 and p.nation <= 8)::int mismatch, (outbound and p.nation <= 8 and p.amount >= c)::int corridor, ({VELOCITY} >= 0.8)::int velocity
  from p join hist using (payment_id) join new using (payment_id) join trail using (payment_id), cut
), named as (
  select *, case when sanctioned = 1 then 'sanctions_country' when structuring = 1 then 'structuring_flag' when mismatch = 1 and velocity = 1 then 'geo_velocity' when corridor = 1 and velocity = 1 then 'corridor_velocity'
    when over_flag = 1 and n1 >= 2 then 'amount_frequency' when shared = 1 and geo_risk_level = 'HIGH' then 'device_geo_risk' else 'no_rule_triggered' end rule from ruled
)"""
MULT = "least(1 + 0.5 * ((case when mean = 0 then false else amount / mean > 2 end)::int + (segment = 'HIGH')::int + shared + beneficiary), 3)"
LABELLED = f"""{RULED}, rated as (
  select named.*, {MULT} * case rule when 'sanctions_country' then 0.08 when 'structuring_flag' then 0.08 when 'geo_velocity' then 0.03 when 'corridor_velocity' then 0.03 when 'amount_frequency' then 0.03 when 'device_geo_risk' then 0.05 else 0.0015 end rate
  from named join (select customer_id, avg(amount) mean from p group by 1) using (customer_id)
), labelled as (select *, (('0x' || substr(md5('42:' || payment_id), 1, 8))::ubigint / 4294967296.0 < rate)::int label from rated)"""
SPLIT = "s as (select *, case when row_number() over (order by payment_timestamp, payment_id) <= floor((select count(*) from p) * 0.8) then 'train' else 'test' end split from p)"
EDGES = """e as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, case when l_linenumber % 5 = 0 then 'S_' || l_suppkey else 'C_' || o_custkey end from_node, case when l_linenumber % 5 = 0 then 'C_' || o_custkey else 'S_' || l_suppkey end to_node,
    l_shipdate ts, date_diff('day', date '1995-01-01', l_shipdate::date)::int as day, l_extendedprice amount_paid, l_returnflag || l_linestatus payment_format, (l_returnflag = 'R' and l_discount >= 0.08)::int is_laundering
  from lineitem join orders on l_orderkey = o_orderkey
)"""
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


def _degrees(days: int) -> str:
    """Distinct neighbours and rows of each (node, day) by range joins."""
    near = f"b.day between a.day - {days - 1} and a.day"
    return f"""{EDGES}, nd as (select distinct from_node node, day from e union select distinct to_node, day from e),
outs as (select a.node, a.day, count(distinct b.to_node) degree, count(*) n from nd a join e b on b.from_node = a.node and {near} group by 1, 2),
ins as (select a.node, a.day, count(distinct b.from_node) degree, count(*) n from nd a join e b on b.to_node = a.node and {near} group by 1, 2)"""


def _spread(days: int) -> str:
    """The same by one row for each day that a distinct edge counts for, so that the time grows with the rows."""
    return f"""{EDGES}, once as (select from_node, to_node, day, count(*) n from e group by all), act as (select from_node, to_node, unnest(range(day, day + {days})) as day, n from once),
pair as (select from_node, to_node, day, sum(n) n from act group by all),
outs as (select from_node node, day, count(*) degree, sum(n) n from pair group by all), ins as (select to_node node, day, count(*) degree, sum(n) n from pair group by all)"""


SCORED = f"{EDGES}, sc as (select is_laundering y, floor(amount_paid / 500) / 200 + is_laundering * 0.05::double score from e)"
ORACLES = {
    "scan_limit": f"with {OR} select payment_id, customer_id, amount amount_usd_equivalent from p order by payment_id limit 100",
    "amount_units": f"with {OR} select payment_id, round(amount * 1000, 2) amount_usd_equivalent from p",
    "profile_nulls": f"with {OR}, {HOLED} " + " union all ".join(f"select '{c}' as column, count(*) as rows, count(*) - count({c}) nulls from h" for c in ("payment_id", "customer_id", "payment_timestamp", "amount_usd_equivalent", "payment_method", "transaction_channel")),
    "pattern_parse": f"with {EDGES} select dense_rank() over (order by payment_format) - 1 attempt_id, 'FAN-' || payment_format[1] typology, count(*) n, round(sum(amount_paid), 2) amount, count(distinct from_node) senders, strftime(min(ts), '%Y-%m-%d %H:%M') as first from e group by payment_format",
    "drop_missing_ts": f"with {OR}, {HOLED} select payment_id from h where payment_timestamp is not null",
    "dup_rows": f"with {OR} select (select count(*) from p) - count(*) duplicate_rows from (select distinct customer_id, payment_timestamp, payment_method from p)",
    "dup_keys": "select count(*) - count(distinct o_custkey) duplicate_keys from orders",
    "range_checks": f"with {EV}, {ODD} select 'negative_amount_usd_equivalent' as check, count(*) filter (amount < 0) as value from q union all select 'invalid_transaction_hour', count(*) filter (hour not between 0 and 23) from q union all select 'invalid_ip_risk_score', count(*) filter (ip not between 0 and 1) from q union all select 'invalid_amount_risk_score', count(*) filter (amt not between 0 and 1) from q union all select 'invalid_device_risk_score', count(*) filter (dev not between 0 and 1) from q union all select 'invalid_payment_timestamp', count(*) filter (payment_timestamp is null) from q",
    "missing_values": f"with {OR}, {HOLED} select * from (" + " union all ".join(f"select '{c}' as column, count(*) - count({c}) missing, count(*) - count({c}) > 0.3 * count(*) failed from h" for c in ("payment_timestamp", "amount_usd_equivalent", "payment_method", "transaction_channel")) + ") where missing > 0",
    "hist_txn_count_30d": f"with {EV}, {HIST} select payment_id, n30 customer_txn_count_30d from hist",
    "hist_avg_amount_30d": f"with {EV}, {HIST} select payment_id, round(avg30, 4) customer_avg_amount_30d from hist",
    "hist_unique_devices_30d": f"with {EV}, {HIST} select payment_id, dev30 customer_unique_devices_30d from hist",
    "hist_unique_countries_30d": f"with {EV}, {HIST} select payment_id, country30 customer_unique_countries_30d from hist",
    "hist_merchant_exposure_30d": f"with {EV} select a.payment_id, coalesce(sum(b.merchants), 0)::double customer_unique_merchants_30d from p a left join p b on {_EARLIER} and b.payment_timestamp >= a.payment_timestamp - interval 30 day group by 1",
    "hist_failed_7d": f"with {EV}, {HIST} select payment_id, failed7 customer_failed_payments_7d from hist",
    "freq_24h_7d": f"with {EV}, {HIST} select payment_id, n1 transaction_frequency_24h, n7 transaction_frequency_7d from hist",
    "new_device_flag": f"with {EV}, {HIST} select payment_id, new_device new_device_flag from new",
    "new_country_flag": f"with {EV}, {HIST} select payment_id, new_country new_country_flag from new",
    "hist_ties_orders": f"with {OR}, {HIST} select payment_id, n30 customer_txn_count_30d, dev30 customer_unique_devices_30d, failed7 customer_failed_payments_7d, new_device new_device_flag from hist join new using (payment_id)",
    "derived_ratios": f"with {EV} select payment_id, round(products / item_count, 6) product_diversity_ratio, round(merchants / item_count, 6) merchant_diversity_ratio, round(case when instrument_age = 0 then 1 else account_age / instrument_age end, 6) account_instrument_age_ratio, round(list_avg(list_filter([case when payment_id % 3 <> 0 then ip end, amt, dev], lambda x: x is not null)), 6) combined_risk_score from p",
    "feature_pipeline": f"with {EV}, {HIST} select payment_id, round(case when avg30 = 0 then 1 else amount / avg30 end, 4) amount_vs_customer_avg_ratio, round(case when n7 = 0 then 0 else n1 / n7 end, 4) txn_frequency_ratio_24h_7d, round(case when n30 = 0 then 0 else failed7 / n30 end, 4) failed_payment_ratio_7d, round((ip + amt + dev) / 3, 4) combined_risk_score from p join hist using (payment_id)",
    "structuring_rule": f"with {EV}, {TRAIL} select payment_id, round(total, 2) trailing_24h_amount_sum, round(top, 2) trailing_24h_amount_max, limit_usd applicable_threshold_usd, {NEAR} near_threshold_flag, {STRUCT} structuring_flag from trail",
    "structuring_orders": f"with {OR}, {TRAIL} select payment_id, round(total, 2) trailing_24h_amount_sum, {NEAR} near_threshold_flag, {STRUCT} structuring_flag from trail",
    "threshold_rule": f"with {EV} select payment_id, (amount >= 30000)::int threshold_exceeded_flag from p",
    "near_threshold": f"with {EV}, {TRAIL} select payment_id, limit_usd applicable_threshold_usd from trail where {NEAR} = 1",
    "sanctions_tier": f"with {EV} select payment_id, {TIER} country_risk_tier, case {TIER} when 'sanctioned' then 1.0 when 'grey_list' then 0.65 when 'moderate' then 0.45 when 'gcc_baseline' then 0.35 else 0.2 end::double country_risk_score, (nation in (0, 1))::int sanctions_country_flag from p",
    "tier_counts": f"with {EV} select {TIER} country_risk_tier, count(*) n from p group by 1",
    "geo_mismatch": f"with {EV}, {HIST} select payment_id, (new_country = 1 and nation <= 8)::int geo_mismatch_flag from p join new using (payment_id)",
    "high_risk_corridor": f"with {EV}, cut as (select quantile_cont(amount, 0.9) c from p) select payment_id, (outbound and nation <= 8 and amount >= c)::int high_risk_corridor_flag from p, cut",
    "velocity_score": f"with {EV}, {HIST} select payment_id, {VELOCITY} velocity_score, ({VELOCITY} >= 0.8)::int velocity_flag from hist",
    "simple_flags": f"with {EV} select payment_id, (ip >= 0.7)::int ip_risk_flag, (account_age < 30)::int young_account_flag from p",
    "rule_engine": f"with {RULED} select payment_id, over_flag threshold_exceeded_flag, near_flag near_threshold_flag, structuring structuring_flag, sanctioned sanctions_country_flag, mismatch geo_mismatch_flag, corridor high_risk_corridor_flag, velocity velocity_flag, rule fraud_rule_name from named",
    "rule_report": f"with {RULED} " + " union all ".join(f"select '{m}' metric, {x}::bigint as value from ruled" for m, x in {"rows": "count(*)", "threshold_exceeded_flag": "sum(over_flag)", "near_threshold_flag": "sum(near_flag)", "structuring_flag": "sum(structuring)", "sanctions_country_flag": "sum(sanctioned)", "geo_mismatch_flag": "sum(mismatch)", "high_risk_corridor_flag": "sum(corridor)", "velocity_flag": "sum(velocity)"}.items()),
    "time_split": f"with {OR}, {SPLIT} select payment_id, split from s",
    "impute_median_mode": f"with {OR}, {HOLED}, s as (select *, row_number() over (order by payment_timestamp, payment_id) <= floor((select count(*) from h where payment_timestamp is not null) * 0.8) train from h where payment_timestamp is not null), modes as (select (select median(amount_usd_equivalent) from s where train) m, (select payment_method from s where train and payment_method is not null group by 1 order by count(*) desc, 1 limit 1) a, (select transaction_channel from s where train and transaction_channel is not null group by 1 order by count(*) desc, 1 limit 1) b) select payment_id, coalesce(amount_usd_equivalent, m) amount_usd_equivalent, coalesce(payment_method, a) payment_method, coalesce(transaction_channel, b) transaction_channel from s, modes",
    "ordinal_encode": f"with {EV} select payment_id, list_position(['LOW', 'MEDIUM', 'HIGH'], kyc_level) - 1 kyc_level, list_position(['LOW', 'MEDIUM', 'HIGH'], geo_risk_level) - 1 geo_risk_level, list_position(['LOW', 'MEDIUM', 'HIGH'], segment) - 1 customer_risk_segment from p",
    "one_hot": f"with {OR} select payment_id, " + ", ".join(f"(payment_method = '{v}')::int payment_method_{v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from p",
    "frequency_encode": f"with {OR}, {SPLIT}, n as (select count(*) n from s where split = 'train'), c as (select country, count(*) k from s where split = 'train' group by 1), v as (select device_id, count(*) k from s where split = 'train' group by 1) select payment_id, round(coalesce(c.k, 0) / n, 6) counterparty_country, round(coalesce(v.k, 0) / n, 6) device_id from s left join c using (country) left join v using (device_id), n",
    "log_transform": f"with {EV}, {ODD} select payment_id, round(ln(1 + greatest(amount, 0)), 6) amount_usd_equivalent, round(ln(1 + item_count), 6) item_count from q",
    "timestamp_features": f"with {EV}, t as (select payment_id, hour(payment_timestamp) h, isodow(payment_timestamp) w, day(payment_timestamp) d, month(payment_timestamp) m from p) select payment_id, h::int transaction_hour, (w - 1)::int day_of_week, d::int day_of_month, m::int as month, (w >= 6)::int is_weekend, (h >= 23 or h < 5)::int is_night, (h >= 9 and h < 17 and w < 6)::int is_business_hour from t",
    "preprocess_pipeline": f"with {EV}, {HIST}, {SPLIT}, n as (select count(*) n from s where split = 'train'), v as (select device_id, count(*) k from s where split = 'train' group by 1) select payment_id, split, amount amount_usd_equivalent_raw, round(ln(1 + amount), 5) amount_usd_equivalent, round(ln(1 + n30), 5) customer_txn_count_30d, round(coalesce(v.k, 0) / n, 5) device_id, list_position(['LOW', 'MEDIUM', 'HIGH'], kyc_level) - 1 kyc_level, (channel = 'MOBILE')::int \"transaction_channel_MOBILE\", (isodow(payment_timestamp) >= 6)::int is_weekend from s join hist using (payment_id) left join v using (device_id), n",
    "preprocess_counts": f"with {EV}, {SPLIT} select split, count(*) as rows from s group by 1",
    "double_mad": f"with {OR}, {SPLIT}, m as (select median(amount) m from s where split = 'train'), w as (select m, (select median(m - amount) from s, m where split = 'train' and amount <= m) lo, (select median(amount - m) from s, m where split = 'train' and amount >= m) hi from m) select payment_id, round((amount - m) / (1.4826 * case when amount <= m then lo else hi end), 6) amount_usd_equivalent_raw_mad_score from s, w",
    "stat_flags": f"with {OR}, {SPLIT}, m as (select median(amount) m from s where split = 'train'), w as (select m, (select median(m - amount) from s, m where split = 'train' and amount <= m) lo, (select median(amount - m) from s, m where split = 'train' and amount >= m) hi from m), f as (select payment_id, (abs((amount - m) / (1.4826 * case when amount <= m then lo else hi end)) >= 1.2)::int f from s, w) select payment_id, f amount_usd_equivalent_raw_mad_flag, f statistical_anomaly_flag from f",
    "zscore_flags": f"with {OR}, {SPLIT}, w as (select avg(amount) a, stddev_pop(amount) b from s where split = 'train') select payment_id, (abs((amount - a) / b) >= 1.5)::int amount_usd_equivalent_zscore_flag from s, w",
    "iqr_flags": f"with {OR}, {SPLIT}, w as (select quantile_cont(amount, 0.25) a, quantile_cont(amount, 0.75) b from s where split = 'train') select payment_id, (amount < a - 0.4 * (b - a) or amount > b + 0.4 * (b - a))::int amount_usd_equivalent_iqr_flag from s, w",
    "percentile_flags": f"with {OR}, {SPLIT}, w as (select quantile_cont(amount, 0.99) a from s where split = 'train') select payment_id, (amount > a)::int amount_usd_equivalent_percentile_flag from s, w",
    "standard_scale": f"with {OR}, {SPLIT}, w as (select avg(amount) a, stddev_pop(amount) b, avg(item_count) c, stddev_pop(item_count) d from s where split = 'train') select payment_id, round((amount - a) / b, 6) amount_usd_equivalent, round((item_count - c) / d, 6) item_count from s, w",
    "minmax_invert": f"with {OR}, {SPLIT}, w as (select min(amount) a, max(amount) b from s where split = 'train') select payment_id, round(1 - least(greatest((amount - a) / (b - a), 0), 1), 6) score from s, w",
    "risk_multiplier": f"with {EV} select payment_id, {MULT}::double risk_multiplier from p join (select customer_id, avg(amount) mean from p group by 1) using (customer_id)",
    "analyst_labels": f"with {LABELLED} select payment_id, rule fraud_rule_name, label analyst_confirmed_label from labelled",
    "label_report": f"with {LABELLED} select rule, count(*) filter (rule <> 'no_rule_triggered') alerts, sum(label)::bigint confirmed from labelled group by 1",
    "confirmation_rates": f"with {LABELLED} select rule, round(avg(label), 6) rate from labelled group by 1",
    "model_properties": f"with {EV}, {SPLIT} select model, count(*) scored, 0::bigint wrong from s, (values ('boosted_trees'), ('random_forest'), ('logistic'), ('shap')) m(model) where split = 'test' group by 1",
    "false_groups": "select min(c_custkey)::bigint component, count(*) + 1 size from customer where c_nationkey % 5 <> 0 group by c_nationkey having count(*) >= 2",
    "transfer_file": f"with {EDGES} select strftime(ts, '%Y-%m-%d %H:%M') as \"at\", from_node, to_node, round(amount_paid, 2) amount_paid, payment_format, is_laundering from e",
    "scale_pos_weight": f"with {SCORED} select round(count(*) filter (y = 0) / count(*) filter (y = 1), 6) scale_pos_weight from sc",
    "best_f1_threshold": f"with {SCORED}, n as (select sum(y) n from sc), t as (select score, sum(count(*)) over (order by score desc) f, sum(sum(y)) over (order by score desc) tp from sc group by score) select round(score, 6) threshold, round(2 * tp / (f + n), 6) f1 from t, n order by 2 * tp / (f + n) desc, score limit 1",
    "classification_metrics": f"with {SCORED}, n as (select sum(y) pos, count(*) - sum(y) neg, sum(y) filter (score >= 0.5) tp, count(*) filter (score >= 0.5) f from sc), g as (select score, count(*) n, sum(y) y from sc group by 1), t as (select *, sum(n) over (order by score desc) cn, sum(y) over (order by score desc) cy, sum(n - y) over (order by score) - (n - y) less from g) select round(any_value(tp / f), 6) \"precision\", round(any_value(tp / pos), 6) recall, round(any_value(2 * tp / (f + pos)), 6) f1, round(sum(t.y * (less + (t.n - t.y) / 2)) / any_value(pos * neg), 6) roc_auc, round(sum(t.y / pos * cy / cn), 6) average_precision from t, n",
    "risk_fusion": f"with {EV} select payment_id, round(case when payment_id % 3 <> 0 then (0.3 * ip + 0.3 * amt + 0.2 * dev) / 0.8 else (0.3 * amt + 0.2 * dev) / 0.5 end, 9) risk_score from p",
    "alert_severity": f"with {EV}, r as (select payment_id, round((0.3 * ip + 0.3 * amt + 0.2 * dev) / 0.8, 3) + 0.0001 r from p) select payment_id, case when r <= 0.3 then 'low' when r <= 0.6 then 'medium' when r <= 0.8 then 'high' when r <= 1 then 'critical' end alert_severity from r",
    "edge_features": f"with {EDGES} select {KEY}, day, round(ln(1 + amount_paid), 6) log_amount, list_position(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], payment_format) - 1 payment_format_code, 1 cross_bank from e",
    "trailing_degrees": f"with {_degrees(4)} select {KEY}, e.day, amount_paid, a.degree src_out_degree, a.n src_out_count, coalesce(b.degree, 0) src_in_degree, c.degree dst_in_degree, c.n dst_in_count, coalesce(d.degree, 0) dst_out_degree from e join outs a on a.node = from_node and a.day = e.day left join ins b on b.node = from_node and b.day = e.day join ins c on c.node = to_node and c.day = e.day left join outs d on d.node = to_node and d.day = e.day",
    "passthrough": f"with {_spread(30)} select {KEY}, e.day, amount_paid, least(a.degree, coalesce(b.degree, 0)) src_passthrough, least(c.degree, coalesce(d.degree, 0)) dst_passthrough from e join outs a on a.node = from_node and a.day = e.day left join ins b on b.node = from_node and b.day = e.day join ins c on c.node = to_node and c.day = e.day left join outs d on d.node = to_node and d.day = e.day",
    **{name: f"with {EDGES} select {KEY}, day, amount_paid, (exists (select 1 from e b where b.from_node = e.to_node and b.to_node = e.from_node and b.day between e.day - {n - 1} and e.day))::int reciprocal_edge from e" for name, n in (("reciprocal_edge", 90), ("reciprocal_edge_4d", 4))},
    "attempt_recall": f"with {EDGES}, t as (select * from e where day >= 2000), a as (select b.payment_format typology, b.l_orderkey % 97 attempt, max((f.l_orderkey % 7 = 0)::int) caught from t b join t f on b.ts = f.ts and b.from_node = f.from_node and b.to_node = f.to_node and b.amount_paid::decimal(18, 2) = f.amount_paid::decimal(18, 2) where b.is_laundering = 1 group by 1, 2) select typology, sum(caught)::bigint caught, count(*) total, round(avg(caught), 6) rate from a group by 1",
    "ring_edges": "select * from (values (1001::bigint, 9001::bigint, 1), (1002, 9001, 1), (1003, 9001, 1), (1004, 9001, 1), (2001, 2002, 2), (2002, 2003, 2), (2003, 2001, 2), (3001, 3002, 3), (3001, 3003, 3), (3002, 3004, 3), (3003, 3004, 3)) t(customer_id, counterparty_account_id, true_ring_id)",
    "connected_components": f"with recursive {EDGES}, x as (select distinct from_node || '@' || day a, to_node || '@' || day b from e), y as (select a, b from x union select b, a from x), reach as (select a node, a other from y union select reach.node, y.b from reach join y on y.a = reach.other) select node, min(other) component from reach group by 1",
    "account_components": f"with recursive {EDGES}, y as (select from_node a, to_node b from e union select to_node, from_node from e), reach as (select a node, a other from y union select reach.node, y.b from reach join y on y.a = reach.other) select node, min(other) component from reach group by 1",
    "ring_benchmark": "select * from (values (1, 5::bigint, 1::bigint, 'full'), (2, 3, 1, 'full'), (3, 4, 1, 'full')) t(ring, members, components, status)",
}
ORACLES["validation_report"] = (
    f"with {EV}, {ODD}, r as (select 'negative_amount_usd_equivalent' c, count(*) filter (amount < 0) v from q union all select 'invalid_transaction_hour', count(*) filter (hour not between 0 and 23) from q union all select 'invalid_ip_risk_score', count(*) filter (ip not between 0 and 1) from q"
    " union all select 'invalid_amount_risk_score', count(*) filter (amt not between 0 and 1) from q union all select 'invalid_device_risk_score', count(*) filter (dev not between 0 and 1) from q union all select 'invalid_payment_timestamp', count(*) filter (payment_timestamp is null) from q)"
    " select c as check, '' as column, v as value, v > 0 failed from r union all select 'missing_values', 'payment_timestamp', count(*) filter (payment_timestamp is null), count(*) filter (payment_timestamp is null) > 0.3 * count(*) from q"
    " union all select 'duplicate_rows', '', 0, false union all select 'duplicate_keys', 'payment_id', 0, false"
)
