"""Token counts of flat, unindexed token files by a separator scan.

A file is nothing but token ids of a fixed width; an end-of-document id closes each document. Files are cut into blocks
of bytes regardless of documents. A task searches its block for separators with one vectorised comparison and gives
their places. A prefix scan over the blocks of a file then stitches documents across block borders: it carries the
number of separators before a block and the place of the last one.

write_token_files() makes such files from texts: each task writes one file under a temporary name and renames it, so a
task that is run again replaces its own file. It returns which document is at which place of which file.

Defined results: a null or empty text is a document of 0 tokens. Tokens after a file's last separator are one more
document. An empty file has none. Repeated rows and ids are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.llm.common import at_end, materialize, scratch_root

#: The public byte-level pre-tokenizer pattern, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES, CHUNK_CHARS = 8 << 20, 1 << 21
_encoders: dict[str, object] = {}


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _encoder(ranks: Broadcast):
    import tiktoken

    key = str(hash(ranks.value))
    if key not in _encoders:
        _encoders.clear()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def _write(batches: Iterator[pa.RecordBatch], ranks: Broadcast, folder: str, eod: int, dtype: str) -> Iterator[pa.RecordBatch]:
    encode = _encoder(ranks).encode_ordinary
    system, root = _file_system(folder)
    name = f"shard-{TaskContext.get().partitionId():06d}.bin"
    part = f"{root}/_{name}-{uuid.uuid4().hex}"
    n = 0
    with system.open_output_stream(part) as out:
        for batch in batches:
            for text in batch.column("text").fill_null("").to_pylist():
                out.write(np.array([*encode(text), eod], dtype).tobytes())
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(np.arange(n, n + len(ids))), ids], ["file", "ordinal", "doc_id"])
            n += len(ids)
    if system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound and not isinstance(system, fs.LocalFileSystem):
        system.delete_file(f"{root}/{name}")
    system.move(part, f"{root}/{name}")


def write_token_files(docs: DataFrame, ranks_path: str, eod: int, folder: str | None = None, dtype: str = "<u2") -> tuple[str, DataFrame]:
    """Encode each whole text into flat token files in a folder; the folder, and (file, ordinal, doc_id)."""
    spark = docs.sparkSession
    own = folder is None
    folder = folder or f"{scratch_root(spark)}/quaylight-tokens-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    if own:
        at_end(spark, folder)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    order = rows.mapInArrow(lambda it: _write(it, ranks, folder, eod, dtype), "file string, ordinal long, doc_id long")
    return folder, materialize(order, "order")


def _scan(batches: Iterator[pa.RecordBatch], folder: str, eod: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """(file, block, place): places, in tokens from the file's start, of the separators of each block."""
    system, root = _file_system(folder)
    width = np.dtype(dtype).itemsize
    for batch in batches:
        for row in batch.to_pylist():
            with system.open_input_file(f"{root}/{row['file']}") as f:
                tokens = np.frombuffer(f.read_at(row["size"], row["start"]), dtype)
            places = np.flatnonzero(tokens == eod) + row["start"] // width
            yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(places), pa.string()), pa.array(np.full(len(places), row["block"])), pa.array(places.astype(np.int64))], ["file", "block", "place"])


def count_tokens(spark: SparkSession, folder: str, eod: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the token files in a folder."""
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    files = [(x.getPath().getName(), x.getLen() // width * width) for x in listed if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    sizes = spark.createDataFrame(files, "file string, bytes long").where("bytes > 0")
    blocks = sizes.select("file", "bytes", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {block_bytes})")).alias("block"))
    blocks = blocks.select("file", "block", F.expr(f"block * {block_bytes}").alias("start"), F.expr(f"least(bytes - block * {block_bytes}, {block_bytes}L)").alias("size"))
    found = materialize(blocks.repartition("file", "block").mapInArrow(lambda it: _scan(it, folder, eod, dtype), "file string, block long, place long"), "places")
    # The prefix scan runs over one row for each block.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("place").alias("last"))
    scan = sums.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"))
    inside = Window.partitionBy("file", "block").orderBy("place")
    own = found.select("file", "block", "place", (F.row_number().over(inside) - 1).alias("k"), F.lag("place").over(inside).alias("previous"))
    closed = own.join(scan, ["file", "block"]).select("file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("place") - F.coalesce("previous", "carry") - 1).alias("n_tokens"))
    ends = sizes.join(sums.groupBy("file").agg(F.sum("n").alias("n"), F.max("last").alias("last")), "file", "left")
    rest = ends.select("file", F.coalesce("n", F.lit(0)).alias("ordinal"), F.expr(f"bytes div {width} - coalesce(last, -1) - 1").alias("n_tokens")).where("n_tokens > 0")
    return closed.union(rest)


def document_tokens(docs: DataFrame, ranks_path: str, eod: int) -> DataFrame:
    """(doc_id, n_tokens) of each row of docs, counted in token files written for it."""
    folder, order = write_token_files(docs, ranks_path, eod)
    return order.join(count_tokens(docs.sparkSession, folder, eod), ["file", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
