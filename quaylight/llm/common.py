"""Shared storage, streaming groups and connected components for the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quaylight.operators.components import shared_folder

#: Rows of a table of a few numbers that may be broadcast.
SMALL_ROWS = 500_000


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return shared_folder(spark)


def at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts the lineage and survives lost executors.

    The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quaylight-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def sweep(spark: SparkSession) -> None:
    """Let the driver collect its garbage, upon which Spark deletes the shuffle files of stored tables' jobs, which nothing reads again."""
    spark._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote for df. Only for tables that no later result reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unclash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def rows_without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, whose keys aren't in `gone`; keys: its columns by the expression over docs. Null keys are equal."""
    own = docs.select(F.struct("*").alias("row"), *[e.alias(f"key{i}") for i, e in enumerate(keys.values())])
    other = gone.select(*[F.col(c).alias(f"gone{i}") for i, c in enumerate(keys)])
    same = [F.col(f"key{i}").eqNullSafe(F.col(f"gone{i}")) for i in range(len(keys))]
    kept = own.join(other, same, "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, a stored table of a few numbers a row, to be broadcast if it has at most `most` rows (some 30 MB); beyond that joins shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by keys: tables of whole groups, with the offsets of the groups in each table.

    Holds the current batch and the rows of one unfinished group.
    """
    held: list[pa.RecordBatch] = []

    def borders(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(k)[-1] == batch.column(k)[0] == batch.column(k)[-1] for k in keys):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        at = borders(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at
        held = table.slice(at[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(borders(table), table.num_rows)


def spanning_edges(n: int, linked: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join the rows 0..n-1 into the connected groups of the relation `linked`.

    linked(x, ys) is a mask over ys. Every linked pair ends in one group, yet a row that has been reached is never
    compared again with rows reached before it, so a group of near copies costs few rows times its size.
    With `side`, only pairs of different sides count.
    """
    open_rows, edges = np.arange(n), []
    while open_rows.size:
        stack, open_rows = [int(open_rows[0])], open_rows[1:]
        while stack and open_rows.size:
            x = stack.pop()
            ok = np.ones(open_rows.size, bool) if side is None else side[open_rows] != side[x]
            if not ok.any():
                continue
            ok[ok] = linked(x, open_rows[ok])
            if ok.any():
                hit = open_rows[ok]
                edges += [(x, int(y)) for y in hit]
                stack += hit.tolist()
                open_rows = open_rows[~ok]
    return edges


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (src, dst: long) can reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a partial aggregation and a join, until
    the edges stay the same. Every round is written to the shared folder. Nulls and self-links are ignored.
    """
    pairs = edges.where("src is not null and dst is not null and src <> dst")

    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges as a table, and their number and the sum of their hashes, which are observed while they are written."""
        seen = Observation()
        out = materialize(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), tag)
        return out, (seen.get["n"], seen.get["sum"])

    now, before = stored(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last = now
        now, after = stored(small)
        release(last)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
