"""Synthetic payment rings and how well connected components recover them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions.columns import hash_uniform
from quaylight.operators.components import connected_components

SCHEMA = "customer_id long, counterparty_account_id long, true_ring_id int"


def background_noise(spark: SparkSession, n_customers: int, seed: int = 42) -> DataFrame:
    """Customers 1..n, each paying one account of a far range."""
    ids = spark.range(1, n_customers + 1).withColumnRenamed("id", "customer_id")
    return ids.select("customer_id", (F.floor(hash_uniform(seed, "customer_id") * 899_999) + 100_000).alias("counterparty_account_id"), F.lit(None).cast("int").alias("true_ring_id"))


def fan_in_ring(spark: SparkSession, ring: int, hub: int, senders: list[int]) -> DataFrame:
    return spark.createDataFrame([(s, hub, ring) for s in senders], SCHEMA)


def cycle_ring(spark: SparkSession, ring: int, nodes: list[int]) -> DataFrame:
    return spark.createDataFrame([(a, b, ring) for a, b in zip(nodes, [*nodes[1:], nodes[0]])], SCHEMA)


def stack_ring(spark: SparkSession, ring: int, source: int, mules: list[int], sink: int) -> DataFrame:
    return spark.createDataFrame([(source, m, ring) for m in mules] + [(m, sink, ring) for m in mules], SCHEMA)


def benchmark_edges(spark: SparkSession, seed: int = 42) -> DataFrame:
    """300 background payments and three planted rings."""
    out = background_noise(spark, 300, seed)
    for ring in (fan_in_ring(spark, 1, 9001, [1001, 1002, 1003, 1004]), cycle_ring(spark, 2, [2001, 2002, 2003]), stack_ring(spark, 3, 3001, [3002, 3003], 3004)):
        out = out.unionByName(ring)
    return out


def ring_recovery(edges: DataFrame) -> DataFrame:
    """(ring, members, components, status): full if a ring is within one component, missed if each member has its own, else partial."""
    labels = connected_components(edges.select(F.col("customer_id").alias("src"), F.col("counterparty_account_id").alias("dst")))
    members = edges.where("true_ring_id is not null").select("true_ring_id", F.explode(F.array("customer_id", "counterparty_account_id")).alias("node")).distinct()
    found = members.join(labels, "node").groupBy(F.col("true_ring_id").alias("ring")).agg(F.count("*").alias("members"), F.count_distinct("component").alias("components"))
    return found.withColumn("status", F.when(F.col("components") == 1, "full").when(F.col("components") == F.col("members"), "missed").otherwise("partial"))


def false_groups(edges: DataFrame) -> DataFrame:
    """(component, size) of components of three nodes or more with background customers and no customer of a ring."""
    labels = connected_components(edges.select(F.col("customer_id").alias("src"), F.col("counterparty_account_id").alias("dst")))
    ring = edges.where("true_ring_id is not null").select(F.col("customer_id").alias("node")).distinct().withColumn("ring", F.lit(1))
    noise = edges.where("true_ring_id is null").select(F.col("customer_id").alias("node")).distinct().withColumn("noise", F.lit(1))
    found = labels.join(ring, "node", "left").join(noise, "node", "left").groupBy("component").agg(F.count("*").alias("size"), F.count("ring").alias("rings"), F.count("noise").alias("background"))
    return found.where("size >= 3 and rings = 0 and background > 0").select("component", "size")
