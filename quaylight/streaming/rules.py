"""Rules over a stream of payments: stateless ones unchanged, trailing sums with per-customer state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quaylight.config import Thresholds
from quaylight.functions.columns import flag
from quaylight.operators.rules import applicable_threshold, sanctions_rule, threshold_rule

DEFAULTS = Thresholds()
DAY_US = 86_400_000_000
_STATE = "times array<long>, ids array<long>, amounts array<double>"
_OUT = "payment_id long, customer_id long, payment_timestamp timestamp, amount_usd_equivalent double, counterparty_country string, trailing_24h_amount_sum double, trailing_24h_amount_max double"


def stateless_rules(payments: DataFrame, settings: Thresholds = DEFAULTS) -> DataFrame:
    """Threshold, near-threshold and country rules; works on streams and tables alike."""
    out = sanctions_rule(threshold_rule(payments, settings), settings).withColumn("applicable_threshold_usd", applicable_threshold(F.col("counterparty_country"), settings))
    ratio = F.col("amount_usd_equivalent") / F.col("applicable_threshold_usd")
    return out.withColumn("near_threshold_flag", flag((ratio >= settings.near_ratio) & (ratio < 1.0)))


def _trailing(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Each new payment with the sum and maximum of its customer's last 24 hours.

    The state holds the payments from a day before the watermark on, in order: Spark drops rows older than the watermark,
    so no row that comes can have a history that reaches further back.
    """
    if state.hasTimedOut:
        state.remove()
        return
    old = pd.DataFrame(dict(zip(("time", "payment_id", "amount"), state.get if state.exists else ([], [], []))))
    new = pd.concat(batches).sort_values(["payment_timestamp", "payment_id"])
    fresh = pd.DataFrame({"time": new["payment_timestamp"].astype("datetime64[us]").astype("int64").to_numpy(), "payment_id": new["payment_id"].to_numpy(), "amount": new["amount_usd_equivalent"].to_numpy(float), "place": range(len(new))})
    known = pd.concat([old.astype({"time": "int64", "payment_id": "int64", "amount": float}).assign(place=-1), fresh]).sort_values(["time", "payment_id"], kind="stable")
    times, amounts, place = known["time"].to_numpy(), known["amount"].to_numpy(), known["place"].to_numpy()
    begin, ends = np.searchsorted(times, times - DAY_US), np.flatnonzero(place >= 0)
    frames = [amounts[begin[k] : k + 1] for k in ends]
    sums, tops = [float(x.sum()) for x in frames], [float(x.max()) for x in frames]
    watermark = state.getCurrentWatermarkMs()
    kept = known[times >= watermark * 1000 - DAY_US]
    state.update(tuple(kept[c].tolist() for c in ("time", "payment_id", "amount")))
    state.setTimeoutTimestamp(max(int(times[-1]) // 1000 + DAY_US // 1000 + 1, watermark + 1))
    yield new.assign(trailing_24h_amount_sum=sums, trailing_24h_amount_max=tops)[[c.split()[0] for c in _OUT.split(", ")]]


def structuring_stream(payments: DataFrame, settings: Thresholds = DEFAULTS, lateness: str = "1 hour") -> DataFrame:
    """Payments of a stream with trailing sums and structuring_flag. A customer's state goes a day after the last payment."""
    rows = payments.where("customer_id is not null").withWatermark("payment_timestamp", lateness).select(*[c.split()[0] for c in _OUT.split(", ")[:5]])
    out = rows.groupBy("customer_id").applyInPandasWithState(_trailing, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    limit = applicable_threshold(F.col("counterparty_country"), settings)
    return out.withColumn("structuring_flag", flag((F.col("trailing_24h_amount_sum") > limit) & (F.col("trailing_24h_amount_max") <= limit)))


def velocity_windows(payments: DataFrame, width: str = "1 day", slide: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """(customer_id, start, end, n, amount): payments of each customer in sliding windows, late ones up to the watermark."""
    windowed = payments.withWatermark("payment_timestamp", lateness).groupBy("customer_id", F.window("payment_timestamp", width, slide).alias("w"))
    return windowed.agg(F.count("*").alias("n"), F.sum("amount_usd_equivalent").alias("amount")).select("customer_id", "w.start", "w.end", "n", "amount")
