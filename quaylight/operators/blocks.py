"""Training rows of any number for models that fit in passes: cuts from all rows, and blocks of bins that stay on the executors.

Rows of equal bins and label are one entry with a count, which changes no sum. Entries are ordered by their bytes within
buckets of their hash, so blocks don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.operators.components import stored
from quaylight.operators.trees import BINS, bins_of

#: Entries of a block; the share of rows, as 1/FINE, above which a range of different values is divided further; bits of the first ranges and of each division.
ENTRIES, FINE, FIRST_BITS, MORE_BITS = 32_768, 4096, 16, 8


def summed(df: DataFrame, add: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of add(batch as a matrix), `size` numbers, over all batches of df; partial sums are made on the executors."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            total += add(batch.to_numpy(float))
        yield pd.DataFrame({"at": np.arange(size), "value": total})

    total = np.zeros(size)
    for at, value in df.mapInPandas(sums, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        total[at] = value
    return total


def _ordered(column: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order."""
    bits = np.ascontiguousarray(column + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _ranges(x: np.ndarray, bits: int, open_: list[np.ndarray] | None) -> Iterator[tuple]:
    """(feature, range, rows, smallest, largest) of the values of x in ranges of equal leading bits, inside the open ranges."""
    for f, column in enumerate(x.T):
        u = _ordered(column)
        if open_ is not None:
            if not len(open_[f]):
                continue
            before = u >> np.uint64(64 - bits + MORE_BITS)
            inside = open_[f][np.minimum(np.searchsorted(open_[f], before), len(open_[f]) - 1)] == before
            column, u = column[inside], u[inside]
        order = np.argsort(u)
        key, first, n = np.unique(u[order] >> np.uint64(64 - bits), return_index=True, return_counts=True)
        if len(key):
            values = column[order] + 0.0
            yield np.full(len(key), f), key.astype(np.int64), n, values[first], values[first + n - 1]


def quantile_cuts(df: DataFrame, width: int) -> list[np.ndarray]:
    """The cuts of each of df's `width` columns, doubles, at quantiles of all rows.

    Rows are counted in ranges of values, and ranges that hold different values and more than 1 in FINE of the rows are
    divided until none is left, so ranks are exact but for what such a range holds. Of up to BINS values each has a bin.
    """
    found: list[list[np.ndarray]] = [[] for _ in range(width)]
    bits, open_, n = FIRST_BITS, None, None
    while True:

        def counted(batches: Iterator[pd.DataFrame], bits=bits, open_=open_) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            merged = lambda: pd.concat(held).groupby(["f", "k"], as_index=False).agg({"n": "sum", "low": "min", "high": "max"})
            for batch in batches:
                held += [pd.DataFrame(dict(zip(("f", "k", "n", "low", "high"), r))) for r in _ranges(batch.to_numpy(float), bits, open_)]
                if sum(map(len, held)) > 500_000:
                    held = [merged()]
            if held:
                yield merged()

        table = df.mapInPandas(counted, "f long, k long, n long, low double, high double").groupBy("f", "k").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        f, k, count, low, high = (table.column(c).to_numpy() for c in ("f", "k", "n", "low", "high"))
        if n is None:
            n = int(count[f == 0].sum())
        again = []
        for i in range(width):
            own = f == i
            wide = (low < high) & (count > n / FINE if own.sum() > BINS else count > 0) & own & (bits < 64)
            again.append(np.sort(k[wide]).astype(np.uint64))
            done = own & ~wide
            found[i].append(np.column_stack([low[done], high[done], count[done]]))
        bits, open_ = bits + MORE_BITS, again
        if not any(map(len, again)):
            break
    cuts = []
    for parts in found:
        all_ = np.concatenate(parts)
        low, high, count = all_[all_[:, 0].argsort()].T
        if len(low) <= BINS and (low == high).all():
            cuts.append((low[:-1] + low[1:]) / 2)
        else:
            seen = count.cumsum()
            at = np.searchsorted(seen, np.arange(1, BINS) / BINS * seen[-1])
            cuts.append(np.unique(high[at[at < len(high) - 1]]))
    return cuts


@dataclass(frozen=True)
class Block:
    """Entries as bins (features, entries), label, count, and margin of the trees so far; at: the block's number."""

    at: int
    bins: np.ndarray
    y: np.ndarray
    times: np.ndarray
    margin: np.ndarray

    @staticmethod
    def read(row) -> Block:
        times = np.frombuffer(row["times"], np.int64)
        bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, len(times))
        return Block(row["at"], bins, np.frombuffer(row["y"], np.uint8), times, np.frombuffer(row["margin"], np.float64))

    def weight(self, positive: float) -> np.ndarray:
        return np.where(self.y == 1, positive, 1.0)

    def moved(self, steps: list) -> np.ndarray:
        """The margins after further trees, given as shape and values."""
        margin = self.margin.copy()
        for shape, values in steps:
            margin += values[shape.find(self.bins)]
        return margin


@dataclass(frozen=True)
class Blocks:
    """A stored table of blocks, its counts of training rows by label, and those of each block."""

    table: DataFrame
    negatives: int
    positives: int
    sizes: np.ndarray

    @cached_property
    def rows(self) -> RDD:
        return self.table.rdd

    def total(self, add: Callable[[Block], np.ndarray]) -> np.ndarray:
        """The sum of add(block) over all blocks, added up on the executors: within tasks, and beyond a few tasks in a tree."""

        def part(rows: Iterator) -> Iterator[np.ndarray]:
            total = None
            for row in rows:
                own = add(Block.read(row))
                total = own if total is None else total + own
            if total is not None:
                yield total

        parts = self.rows.mapPartitions(part)
        return (parts.reduce if self.rows.getNumPartitions() <= 8 else parts.treeReduce)(lambda a, b: a + b)

    def advanced(self, steps: list) -> Blocks:
        """The blocks with the margins after further trees, stored anew in place of these."""

        def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    row["margin"] = Block.read(row).moved(steps).tobytes()
                    yield pa.RecordBatch.from_pylist([row], batch.schema)

        new = stored(self.table.mapInArrow(forward, self.table.schema), "blocks")
        dropped(self.table)
        return replace(self, table=new)

    def dropped(self) -> None:
        dropped(self.table)


def dropped(table: DataFrame) -> None:
    """Deletes the folder of a stored table that nothing reads any more."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def entries(df: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(bins, y, times): the different rows of bins and label of df, whose columns are the label and the features, stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
            bins = np.ascontiguousarray(bins_of(x[:, 1:], cuts).T)
            buffers = [None, pa.py_buffer((np.arange(len(x) + 1) * len(cuts)).astype(np.int32)), pa.py_buffer(bins)]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(x), buffers), pa.array((x[:, 0] == 1).astype(np.int16))], ["bins", "y"])

    return stored(df.mapInArrow(cut, "bins binary, y short").groupBy("bins", "y").agg(F.count("*").alias("times")), "entries")


def matrix(table: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries as one matrix of bins (features, entries), labels and counts, in the order of their bytes."""
    found = table.orderBy("bins", "y").toArrow()
    bins = np.frombuffer(b"".join(found.column("bins").to_pylist()), np.uint8).reshape(-1, width).T
    return np.ascontiguousarray(bins), found.column("y").to_numpy().astype(np.uint8), found.column("times").to_numpy()


def blocks(table: DataFrame, width: int, n: int, size: int = ENTRIES) -> Blocks:
    """Entries, n of them, as blocks."""
    buckets = -(-n // size)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, count = None, [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            bins = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(-1, width).T
            y, times = t.column("y").to_numpy().astype(np.uint8), t.column("times").to_numpy().astype(np.int64)
            row = {"at": at, "bins": bins.tobytes(), "y": y.tobytes(), "times": times.tobytes(), "margin": np.zeros(len(y)).tobytes(), "negatives": int(times[y == 0].sum()), "positives": int(times[y == 1].sum())}
            return pa.RecordBatch.from_pylist([row], pa.schema([("at", pa.int64()), *[(c, pa.binary()) for c in ("bins", "y", "times", "margin")], ("negatives", pa.int64()), ("positives", pa.int64())]))

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                if len(part):
                    if at is not None and bucket[part[0]] != at:
                        yield block()
                        held = []
                    at = int(bucket[part[0]])
                    held.append(batch.slice(int(part[0]), len(part)))
        if held:
            yield block()

    own = table.select(F.pmod(F.xxhash64("bins", "y"), F.lit(buckets)).alias("at"), "bins", "y", "times")
    dealt = own.repartition("at").sortWithinPartitions("at", "bins", "y")
    made = stored(dealt.mapInArrow(packed, "at long, bins binary, y binary, times binary, margin binary, negatives long, positives long"), "blocks")
    sizes, no, yes = np.zeros(buckets), 0, 0
    for at, a, b in made.select("at", "negatives", "positives").collect():
        sizes[at], no, yes = a + b, no + a, yes + b
    return Blocks(made, no, yes, sizes)
