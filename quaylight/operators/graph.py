"""Transaction graph features: trailing distinct degrees, reciprocal edges, pass-through, attempt recall.

A window (d - w, d] is read as changes at its borders with running sums, so all features are equi-joins, partial aggregations
and ordered sums within a node or an edge; there is no range join, and nothing is exploded into days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.columns import flag

WINDOW_DAYS = 4


def transaction_features(edges: DataFrame, start: str = "2022-09-01") -> DataFrame:
    """day (from `start`), hour, log_amount, payment_format_code (place in alphabetical order), cross_bank."""
    codes = edges.select("payment_format").where("payment_format is not null").distinct()
    table = codes.select("payment_format", F.expr("dense_rank() over (order by payment_format) - 1").alias("payment_format_code"))  # one row for each format
    bank = lambda c: F.split_part(F.col(c), F.lit("_"), F.lit(1))
    out = edges.join(table, "payment_format", "left")  # a small table is broadcast by its size
    return out.withColumns({
        "day": F.datediff(F.to_date("timestamp"), F.lit(start).cast("date")), "hour": F.hour("timestamp"), "log_amount": F.log1p("amount_paid"),
        "payment_format_code": F.coalesce("payment_format_code", F.lit(-1)), "cross_bank": flag(bank("from_node") != bank("to_node")),
    })


def _node_days(edges: DataFrame, days: int) -> DataFrame:
    """(node, day, out_degree, out_count, in_degree, in_count) of the last `days` days, for each day with an edge of the node.

    An edge counts from its day on and no longer `days` days later, and of an edge's overlapping spans the inner borders
    cancel. So each distinct edge and day gives two changes at most, however long the window is, and running sums over a
    node's changes, added up by day before, are the features.
    """
    # One exchange by edge and one by node serve both the sums by day and the frames.
    known = edges.where("day >= 0").select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"), F.col("day").cast("long").alias("day")).repartition("src", "dst")
    once = known.groupBy("src", "dst", "day").agg(F.count("*").alias("n"))
    order = Window.partitionBy("src", "dst").orderBy("day")
    begins, ends = (F.coalesce(gap >= days, F.lit(True)).cast("long") for gap in (F.col("day") - F.lag("day").over(order), F.lead("day").over(order) - F.col("day")))
    spans = once.select("src", "dst", "day", "n", begins.alias("begins"), ends.alias("ends"))
    at = lambda node, day, out, back: f"struct({node} as node, {day} as day, {out[0]} as out_degree, {out[1]} as out_count, {back[0]} as in_degree, {back[1]} as in_count, day = {day} as asked)"
    none, more, less = ("0L", "0L"), ("begins", "n"), ("-ends", "-n")
    changes = [at("src", "day", more, none), at("dst", "day", none, more), at("src", f"day + {days}", less, none), at("dst", f"day + {days}", none, less)]
    each = spans.select(F.inline(F.expr(f"array({', '.join(changes)})"))).repartition("node")
    names = ["out_degree", "out_count", "in_degree", "in_count"]
    by_day = each.groupBy("node", "day").agg(*[F.sum(c).alias(c) for c in names], F.max("asked").alias("asked"))
    running = Window.partitionBy("node").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by_day.select("node", "day", "asked", *[F.sum(c).over(running).alias(c) for c in names]).where("asked").drop("asked")


def reciprocal_edges(edges: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """edges with reciprocal_edge: whether the reverse edge occurs in the last `days` days, the day itself included; NULL before day 0.

    The days of an edge and of its reverse meet in one ordered group, where the latest reverse day is a running maximum;
    nothing is exploded, however long the window is.
    """
    once = edges.where("day >= 0").select("from_node", "to_node", "day").distinct()
    met = once.select("from_node", "to_node", "day", F.lit(None).cast("int").alias("back")).union(once.select("to_node", "from_node", "day", F.col("day").cast("int")))
    latest = F.max("back").over(Window.partitionBy("from_node", "to_node").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    known = met.withColumn("latest", latest).where("back is null").select("from_node", "to_node", "day", flag(F.col("latest") > F.col("day") - days).alias("reciprocal_edge"))
    return edges.join(known, ["from_node", "to_node", "day"], "left")


def graph_features(edges: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """The edges (from_node, to_node, day, ...) with eight features of the last `days` days, the day itself included. Days before 0 get NULL."""
    node = _node_days(edges, days)
    src = node.select(F.col("node").alias("from_node"), "day", F.col("out_degree").alias("src_out_degree"), F.col("out_count").alias("src_out_count"), F.col("in_degree").alias("src_in_degree"))
    dst = node.select(F.col("node").alias("to_node"), "day", F.col("in_degree").alias("dst_in_degree"), F.col("in_count").alias("dst_in_count"), F.col("out_degree").alias("dst_out_degree"))
    out = reciprocal_edges(edges.join(src, ["from_node", "day"], "left").join(dst, ["to_node", "day"], "left"), days)
    return out.withColumns({
        "src_passthrough": F.least("src_in_degree", "src_out_degree"), "dst_passthrough": F.least("dst_in_degree", "dst_out_degree"),
    })


def attempt_recall(flagged: DataFrame, patterns: DataFrame) -> DataFrame:
    """(typology, caught, total, rate): attempts of which at least one test transaction is flagged.

    flagged: timestamp, from_node, to_node, amount_paid, flag. Amounts meet as cents, so no floats are compared.
    """
    cents = F.col("amount_paid").cast("decimal(18,2)")
    keys = ["timestamp", "from_node", "to_node", "cents"]
    test = flagged.withColumn("cents", cents).groupBy(*keys).agg(F.max("flag").alias("flag"))
    met = patterns.withColumn("cents", cents).join(test, keys, "left")
    attempts = met.groupBy("typology", "attempt_id").agg(F.max(F.coalesce("flag", F.lit(0))).alias("caught"))
    return attempts.groupBy("typology").agg(F.sum("caught").cast("long").alias("caught"), F.count("*").alias("total"), F.avg("caught").alias("rate"))
