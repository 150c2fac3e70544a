"""MinHash near-dedup with SetSketch registers (Ertl, 2021).

A document's set is its distinct word shingles. A sketch holds, for each of m hash functions, the exponentially
spaced truncated minimum of the set: floor(1 - log_b(x)) of the smallest exponential variate x, within 0..q+1, in
one byte. Registers are mergeable by maximum and agree with a probability that grows with the Jaccard similarity.

1. One scan gives each document its set size, a digest of the set and the sketch. Documents with equal sets form a
   class, and only one representative of a class goes on, so copies cost nothing more.
2. Bands of registers are hashed to buckets. Within a bucket the joint likelihood of two sketches, given both set
   sizes, tells whether the estimate of the similarity may reach the threshold less a margin. The survivors' connected
   groups are clusters.
3. Within a cluster, full sets are compared exactly. Sets are re-read from the texts of clustered documents only.
4. Links form components.

No bucket or cluster meets in one task: both are cut into blocks of bounded size and each pair of blocks is a task
of its own, which emits the edges of a spanning forest, never all pairs.

Defined results: a null, empty or blank text has no shingles, links with nothing and is kept. Rows with the same
doc_id are one document if their texts are equal; otherwise their texts' links all count for that doc_id. Rows with
a null doc_id are returned with a null component and kept. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.llm.common import components, materialize, rows_without, sorted_groups, spanning_edges, unclash
from quaylight.llm.textset import mix64, shingle_sets

BASE, Q, RATE = 1.1, 254, 20.0
BANDS = 24
#: Sketches of one block of a bucket; shingles of one block of a cluster.
BUCKET_BLOCK, CLUSTER_BLOCK = 2048, 1 << 21


def band_rows(threshold: float, bands: int = BANDS, miss: float = 1e-5) -> int:
    """The most registers in a band for which a pair at the threshold shares no band with a probability of at most `miss`."""
    r = 1
    while (1 - threshold ** (r + 1)) ** bands <= miss:
        r += 1
    return r


def sketch(shingles: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; all 0 for the empty set."""
    if not shingles.size:
        return np.zeros(m, np.uint8)
    a = mix64(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    c = mix64(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    low = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, shingles.size, 512):
        np.minimum(low, (shingles[i : i + 512, None] * a + c).min(axis=0), out=low)
    x = -np.log1p(-((low >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint8)


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """(documents, bands) 64-bit bucket keys of (documents, m) registers."""
    r = registers.shape[1] // bands
    rows = registers[:, : bands * r].reshape(len(registers), bands, r).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(r):
        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + rows[:, :, j])
    return key.view(np.int64)


def may_reach(low: float, greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Whether the maximum-likelihood similarity of pairs of sketches is at least `low`.

    greater, less, equal count the registers of u over, under and equal to those of v. The log-likelihood is concave in
    the similarity, so it is enough to look at the sign of its derivative at `low`.
    """
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    top = np.minimum(u / v, v / u)
    at = np.minimum(low, top * (1 - 1e-9))
    k = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-x * k) / np.log(BASE)
    d = lambda x: k / (1 - x * k) / np.log(BASE)
    a, b = np.maximum(u - v * at, 1e-12), np.maximum(v - u * at, 1e-12)
    slope = -greater * v * d(a) / p(a) - less * u * d(b) / p(b) + equal * (v * d(a) + u * d(b)) / np.maximum(1 - p(a) - p(b), 1e-12)
    return (slope >= 0) & (top >= low)


def _profile(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, digest of the set, registers."""
    for batch in batches:
        sizes, digests, sketches = [], [], []
        for s in shingle_sets(batch.column("text"), width):
            sizes.append(s.size)
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sketches.append(sketch(s, bands * rows).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])


def _add_keys(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    """(key, rep) for each band of each representative."""
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        keys = band_keys(regs, bands).ravel() if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("rep").to_numpy(), bands))], ["key", "rep"])


def _edges(src: list, dst: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _bucket_edges(batches: Iterator[pa.RecordBatch], low: float) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the pairs in a bucket whose estimate may reach `low`."""
    for table, at in sorted_groups(batches, ["key", "lo", "hi"]):
        rep, n = table.column("rep").to_numpy(), table.column("n_shingles").to_numpy().astype(float)
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        side, cross = table.column("side").to_numpy(), table.column("lo").to_numpy() != table.column("hi").to_numpy()

        def close(x, ys, regs=regs, n=n):
            d = regs[x].astype(np.int16) - regs[ys].astype(np.int16)
            more, less = (d > 0).sum(-1), (d < 0).sum(-1)
            return may_reach(low, more, less, regs.shape[1] - more - less, n[x], n[ys])

        size = np.diff(at)
        two = at[:-1][(size == 2)]
        two = two[~cross[two] | (side[two] != side[np.minimum(two + 1, len(side) - 1)])]
        two = two[close(two, two + 1)] if two.size else two
        src, dst = [rep[two]], [rep[two + 1]]
        for s, k in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
            found = spanning_edges(k, lambda x, ys, s=s: close(s + x, s + ys), side[s : s + k] if cross[s] else None)
            if found:
                i = np.array(found) + s
                src.append(rep[i[:, 0]])
                dst.append(rep[i[:, 1]])
        yield _edges(np.concatenate(src), np.concatenate(dst))


def _with_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Puts a text's set of shingles in the place of the text."""
    for batch in batches:
        sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), width)], pa.binary())
        k = batch.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([sets if i == k else c for i, c in enumerate(batch.columns)], [*batch.schema.names[:k], "shingles", *batch.schema.names[k + 1 :]])


def _cluster_edges(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the pairs in a cluster with 100 * intersection >= percent * union."""
    for table, at in sorted_groups(batches, ["cluster", "lo", "hi"]):
        rep, sets = table.column("rep").to_numpy(), table.column("shingles")
        side, cross = table.column("side").to_numpy(), table.column("lo").to_numpy() != table.column("hi").to_numpy()
        src, dst = [], []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets[s:e]]
            n = np.array([x.size for x in own])
            first = np.concatenate([[0], np.cumsum(n)])
            values, ids = np.unique(np.concatenate(own), return_inverse=True)
            mark = np.zeros(values.size, np.int64)

            def linked(x, ys, n=n, first=first, ids=ids, mark=mark):
                ok = 100 * np.minimum(n[x], n[ys]) >= percent * np.maximum(n[x], n[ys])
                if ok.any():
                    some = ys[ok]
                    mine = ids[first[x] : first[x + 1]]
                    mark[mine] = 1
                    both = np.array([mark[ids[first[y] : first[y + 1]]].sum() for y in some.tolist()])
                    mark[mine] = 0
                    ok[ok] = 100 * both >= percent * (n[x] + n[some] - both)
                return ok

            found = spanning_edges(e - s, linked, side[s:e] if cross[s] else None)
            src += rep[[s + i for i, _ in found]].tolist()
            dst += rep[[s + j for _, j in found]].tolist()
        yield _edges(src, dst)


def _block_pairs(df: DataFrame, key: str) -> DataFrame:
    """One row for each pair of blocks (lo, hi) of its group that a row belongs to; `side` tells its own block. Needs block and blocks."""
    pairs = F.expr("transform(sequence(0, blocks - 1), b -> struct(least(b, block) as lo, greatest(b, block) as hi))")
    return df.withColumn("pair", F.explode(pairs)).select("*", "pair.lo", "pair.hi", F.col("block").alias("side")).drop("pair", "block", "blocks")


def profile(docs: DataFrame, width: int = 5, bands: int = BANDS, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, digest, registers) of every document, in one scan."""
    return unclash(docs, ["doc_id", "text"]).mapInArrow(lambda it: _profile(it, width, bands, rows), "doc_id long, n_shingles long, digest binary, registers binary")


def links(docs: DataFrame, classes: DataFrame, percent: int, width: int = 5, bands: int = BANDS, rows: int = 5) -> DataFrame:
    """(src, dst): edges that span the components of representatives with 100 * intersection >= percent * union.

    classes: rep, n_shingles, registers; a set for each rep, which is the doc_id of a text with that set.
    """
    low = percent / 100 - 4.5 * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5
    in_bucket = Window.partitionBy("key")
    buckets = (
        classes.select("rep", "registers").mapInArrow(lambda it: _add_keys(it, bands), "key long, rep long")
        .withColumn("n", F.count("*").over(in_bucket)).where("n > 1")
        .withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
        .select("key", "rep", "blocks", "block")
    )
    buckets = _block_pairs(buckets, "key").join(classes, "rep").select("key", "lo", "hi", "side", "rep", "n_shingles", "registers")
    near = buckets.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(lambda it: _bucket_edges(it, low), "src long, dst long")
    clusters = components(near.distinct(), "clusters").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))

    in_cluster = Window.partitionBy("cluster")
    sized = (
        clusters.join(classes.select("rep", "n_shingles"), "rep")
        .withColumn("block", F.floor(F.sum("n_shingles").over(in_cluster.orderBy("n_shingles", "rep")) / CLUSTER_BLOCK).cast("int"))
        .withColumn("blocks", F.max("block").over(in_cluster) + 1)
    )
    texts = unclash(docs, ["doc_id", "text"]).withColumnRenamed("doc_id", "rep")
    sets = sized.join(texts, "rep").select("cluster", "block", "blocks", "rep", "text").mapInArrow(lambda it: _with_sets(it, width), "cluster long, block int, blocks int, rep long, shingles binary")
    return _block_pairs(sets, "cluster").repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(lambda it: _cluster_edges(it, percent), "src long, dst long")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id long, text string).

    component_id is the smallest doc_id that links of a similarity of percent / 100 or more reach; kept marks it.
    """
    rows = band_rows(percent / 100, bands)
    each = materialize(profile(docs, width, bands, rows), "profile")
    alike = each.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(alike.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "classes")
    # A doc_id with several texts stands for several sets: its classes are linked as well.
    ids = alike.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest")
    found = materialize(links(docs, classes, percent, width, bands, rows), "links")
    grouped = components(found.union(ids.select(F.col("rep").alias("src"), F.col("doc_id").alias("dst")).where("src <> dst")), "near")
    out = each.select("doc_id", "n_shingles").join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.expr("doc_id is null or doc_id = component_id"))


def deduplicated(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs with one document of each component, all columns."""
    gone = near_duplicates(docs, percent, width).where("not kept").select("doc_id").distinct()
    return rows_without(docs, gone, {"doc_id": docs["doc_id"]})
