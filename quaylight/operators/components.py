"""Connected components of an edge table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share; our own one where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="quaylight-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, tag: str = "components") -> DataFrame:
    """df through a table in the shared folder, which goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quaylight-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (src, dst) reaches, edges taken both ways.

    Every node points to the smallest label among its neighbours, then pointers are followed once (so paths halve), until
    no label changes. Labels are longs or strings; self-links name a node without neighbours; NULLs are left out.
    """
    known = edges.where("src is not null and dst is not null").select("src", "dst")
    both = stored(known.union(known.select("dst", "src")).distinct())
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        # A root that one of its members can leave for a smaller label leaves, too.
        roots = hooked.where("component < old").groupBy(F.col("old").alias("node")).agg(F.min("component").alias("via"))
        moved = hooked.join(roots, "node", "left").select("node", "old", F.least("component", F.coalesce("via", "component")).alias("component"))
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = stored(moved.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")))
        labels = new.select("node", "component")
        if new.where("component < old").isEmpty():
            return labels
