"""Embedding near-dedup by an epsilon grid order join (Boehm et al., 2001).

Unit vectors link if their cosine is t or more, that is, if their distance is at most eps = sqrt(2 - 2t). They are put
into grid cells of that width on their leading principal dimensions and sorted by cell, in lexicographic order. The
sequence is cut into intervals (blocks) of bounded size, and blocks carry the box of their vectors in the principal
dimensions. Blocks whose cells are neighbours meet, and pairs whose boxes are provably farther apart than eps
are skipped. Tasks read the blocks where they are stored, so pairs take no disk, however many there are. A pair of
blocks is one matrix product in double precision, cut into halves
recursively while the halves' boxes can still meet. A pair emits the number of links of each vector and the edges of a
spanning forest, never all pairs. Equal vectors are one class, so copies cost nothing more.

The principal axes only order and prune, so they are fitted on a bounded sample (AXES_SAMPLE vectors, by hash); the
result doesn't depend on them.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do rows
with a null vec_id. Vectors of different lengths don't link. Rows with the same vec_id count as vectors of their own.
Other columns, labels among them, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.llm.common import components, materialize, release, spanning_edges, sweep, unclash

AXES_SAMPLE, AXES, CELL_AXES = 4096, 8, 3
BLOCK_BYTES, LEAF = 1 << 20, 256
_PLAIN = {pa.float64(): np.float64, pa.float32(): np.float32}


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the usable vectors, for each length, in double precision."""
    lists = column.cast(pa.large_list(pa.float64()))
    at, known = np.frombuffer(lists.buffers()[1], np.int64, len(lists) + 1, lists.offset * 8), lists.is_valid().to_numpy(zero_copy_only=False)
    values = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(at) * known
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        m = values[at[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore"):
            scale = np.abs(m).max(1)
        ok = np.isfinite(scale) & np.isfinite(m).all(1) & (scale > 0)
        yield rows[ok], m[ok]


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square over- or underflows."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, digest of the vector (null if unusable), its length and its bytes."""
    for batch in batches:
        n = batch.num_rows
        digest, dim, vector = [None] * n, [0] * n, [None] * n
        for rows, m in _matrices(batch.column("embedding")):
            m = m + 0.0  # one zero
            for i, v in zip(rows.tolist(), m):
                vector[i], dim[i] = v.tobytes(), v.size
                digest[i] = hashlib.blake2b(vector[i], digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(digest, pa.binary()), pa.array(dim, pa.int32()), pa.array(vector, pa.binary())], ["vec_id", "digest", "dim", "vector"])


def _stack(vectors: list[bytes], dim: int) -> np.ndarray:
    return unit(np.frombuffer(b"".join(vectors), np.float64).reshape(-1, dim))


def fit_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the leading principal axes (length, axes) of a bounded sample."""
    sample = classes.select("dim", "vector").orderBy(F.xxhash64("vector"), "vector").limit(AXES_SAMPLE).collect()
    axes = {}
    for d in {r.dim for r in sample}:
        m = _stack([r.vector for r in sample if r.dim == d], d)
        m = m - m.mean(0)
        axes[d] = np.linalg.eigh(m.T @ m)[1][:, ::-1][:, :AXES].copy()
    return axes


def _place(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], eps: float) -> Iterator[pa.RecordBatch]:
    """Adds the grid cell of each vector."""
    for batch in batches:
        dims, raw = batch.column("dim").to_numpy(), batch.column("vector").to_pylist()
        cells = np.zeros((batch.num_rows, CELL_AXES), np.int32)
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            if d in axes:
                p = _stack([raw[i] for i in rows], d) @ axes[d][:, :CELL_AXES]
                cells[rows, : p.shape[1]] = np.floor(p / eps)
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, k]) for k in range(CELL_AXES)]], [*batch.schema.names, *[f"c{k}" for k in range(CELL_AXES)]])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's partition and its place there."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(np.arange(n, n + batch.num_rows))], [*batch.schema.names, "part", "place"])
        n += batch.num_rows


def _cut(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Intervals of the sorted sequence, with their boxes. Rows come by interval."""
    names = ["block", "dim", "c0", "d0", "c1", "d1", "low", "high", "reps", "counts", "vectors"]
    held: list[dict] = []

    def block() -> pa.RecordBatch:
        d = held[0]["dim"]
        m = _stack([r["vector"] for r in held], d)
        p = m @ axes[d] if d in axes else np.zeros((len(m), 1))
        p = np.pad(p, ((0, 0), (0, AXES - p.shape[1])))
        c = [(min(r[k] for r in held), max(r[k] for r in held)) for k in ("c0", "c1")]
        row = [held[0]["block"], d, *c[0], *c[1], p.min(0).tolist(), p.max(0).tolist(), np.array([r["rep"] for r in held], np.int64).tobytes(), np.array([r["n"] for r in held], np.int64).tobytes(), m.tobytes()]
        held.clear()
        types = [pa.int64(), *[pa.int32()] * 5, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    for batch in batches:
        for r in batch.to_pylist():
            if held and r["block"] != held[0]["block"]:
                yield block()
            held.append(r)
    if held:
        yield block()


def _join(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], least: float, eps: float) -> Iterator[pa.RecordBatch]:
    """(src, dst, links): links of a vector within a pair of blocks (dst null), and edges of a spanning forest (links null)."""
    for batch in batches:
        for row in batch.to_pylist():
            d, same = row["dim"], row["a"] == row["b"]
            m, reps, counts = zip(*[(np.frombuffer(row[f"vectors_{k}"], np.float64).reshape(-1, d), np.frombuffer(row[f"reps_{k}"], np.int64), np.frombuffer(row[f"counts_{k}"], np.int64)) for k in "ab"])
            p = [x @ axes[d] if d in axes else np.zeros((len(x), 1)) for x in m]
            found = []

            def recurse(i, j, k, n):
                """Intervals [i, j) of a and [k, n) of b."""
                gap = np.maximum(0, np.maximum(p[0][i:j].min(0) - p[1][k:n].max(0), p[1][k:n].min(0) - p[0][i:j].max(0)))
                if gap @ gap > eps * eps or (same and k + 1 >= n and i >= k) or (same and n <= i):
                    return
                if max(j - i, n - k) > LEAF:
                    h, q = (i + j) // 2 if j - i > LEAF else j, (k + n) // 2 if n - k > LEAF else n
                    for x, y in ((i, h), (h, j)):
                        for z, w in ((k, q), (q, n)):
                            if x < y and z < w:
                                recurse(x, y, z, w)
                    return
                x, y = np.nonzero(m[0][i:j] @ m[1][k:n].T >= least)
                x, y = x + i, y + k
                if same:
                    x, y = x[x < y], y[x < y]
                if x.size:
                    found.append((x, y))

            recurse(0, len(reps[0]), 0, len(reps[1]))
            if not found:
                continue
            x, y = (np.concatenate(z) for z in zip(*found))
            links = [np.bincount(x, counts[1][y], len(reps[0])), np.bincount(y, counts[0][x], len(reps[1]))]
            edges = _forest(x, y if same else y + len(reps[0]))
            every = reps[0] if same else np.concatenate(reps)
            src, dst, n = [every[[e for e, _ in edges]]], [every[[e for _, e in edges]]], [np.full(len(edges), -1)]
            for own, l in zip(reps, links):
                src, dst, n = [*src, own[l > 0]], [*dst, np.full((l > 0).sum(), -1)], [*n, l[l > 0].astype(np.int64)]
            n = np.concatenate(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst), mask=n >= 0), pa.array(n, mask=n < 0)], ["src", "dst", "links"])


def _forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of the pairs (x, y)."""
    order = np.argsort(np.concatenate([x, y]), kind="stable")
    nodes, first = np.unique(np.concatenate([x, y])[order], return_index=True)
    to = np.searchsorted(nodes, np.concatenate([y, x])[order])
    ends = np.append(first, to.size)
    mark = np.zeros(nodes.size, bool)

    def linked(i, js):
        mark[to[ends[i] : ends[i + 1]]] = True
        out = mark[js]
        mark[to[ends[i] : ends[i + 1]]] = False
        return out

    return [(int(nodes[i]), int(nodes[j])) for i, j in spanning_edges(nodes.size, linked)]


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of embeddings (vec_id long, embedding array<float or double>).

    n_links counts the other vectors with a cosine of at least `cosine`; component_id is the smallest vec_id that links
    reach, itself included.
    """
    eps = (2 - 2 * cosine) ** 0.5 + 1e-9
    each = materialize(unclash(embeddings, ["vec_id", "embedding"]).mapInArrow(_digest, "vec_id long, digest binary, dim int, vector binary"), "vectors")
    usable = each.where("digest is not null and vec_id is not null")
    classes = materialize(usable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("vector").alias("vector")), "classes")
    axes = fit_axes(classes)
    cells = [f"c{k}" for k in range(CELL_AXES)]
    placed = classes.select("rep", "n", "dim", "vector").mapInArrow(lambda it: _place(it, axes, eps), "rep long, n long, dim int, vector binary, " + ", ".join(f"{c} int" for c in cells))
    placed = materialize(placed, "cells")
    schema = "block long, dim int, c0 int, d0 int, c1 int, d1 int, low array<double>, high array<double>, reps binary, counts binary, vectors binary"
    ordered = placed.repartitionByRange("dim", *cells, "rep").sortWithinPartitions("dim", *cells, "rep")
    ordered = materialize(ordered.mapInArrow(_number, T.StructType([*placed.schema, T.StructField("part", T.LongType()), T.StructField("place", T.LongType())])), "ordered")
    # A row's place in the whole sequence: partitions before it are added from one row for each. So intervals have their
    # full size however many partitions there are.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = ordered.join(base, "part").withColumn("place", F.col("base") + F.col("place")).drop("base", "part")
    size = f"greatest(1L, cast({BLOCK_BYTES} div (8 * dim) as long))"
    numbered = numbered.withColumn("block", F.expr(f"cast(dim as long) * {1 << 40} + place div {size}"))
    blocks = materialize(numbered.repartition("block").sortWithinPartitions("block", "place").mapInArrow(lambda it: _cut(it, axes), schema), "blocks")
    for table in (placed, ordered):
        release(table)
    sweep(embeddings.sparkSession)

    def side(k):
        return blocks.select(F.col("block").alias(k), *([F.col("dim")] if k == "a" else [F.col("dim").alias("dim_b")]), *[F.col(c).alias(f"{c}_{k}") for c in ("c0", "d0", "c1", "d1", "low", "high", "reps", "counts", "vectors")])

    # Each task reads its blocks from the stored table: a block that meets many others is never written for each of them.
    near = "c0_a - 1 <= d0_b and c0_b <= d0_a + 1 and c1_a - 1 <= d1_b and c1_b <= d1_a + 1"
    gap = "aggregate(zip_with(zip_with(low_a, high_b, (p, q) -> p - q), zip_with(low_b, high_a, (p, q) -> p - q), (p, q) -> power(greatest(p, q, 0D), 2)), 0D, (s, v) -> s + v)"
    todo = side("a").join(side("b").hint("shuffle_replicate_nl"), F.expr(f"a <= b and dim <=> dim_b and {near} and {gap} <= {eps * eps!r}D"))
    todo = todo.select("a", "b", "dim", *[f"{c}_{k}" for k in "ab" for c in ("reps", "counts", "vectors")])
    found = materialize(todo.mapInArrow(lambda it: _join(it, axes, cosine, eps), "src long, dst long, links long"), "found")
    release(blocks)
    links = found.where("dst is null").groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"))
    grouped = components(found.where("dst is not null").select("src", "dst"), "near").withColumnRenamed("node", "rep")
    known = classes.select("digest", "rep", "n").join(links, "rep", "left").join(grouped, "rep", "left")
    out = each.select("vec_id", F.expr("if(vec_id is null, null, digest)").alias("digest")).join(known, "digest", "left")
    out = out.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.expr("vec_id is null or vec_id = component_id"))
