"""The training-data pipeline: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and gives the columns of documents; the
last gives token ids. run() writes each stage's documents as Parquet in the shared folder and reads them again.
SQL cannot express the first and third stage (a fitted model, sketches), so the tests hold run() against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.llm import bpe, cumulative_link, decontaminate, line_dedup, minhash_dedup
from quaylight.llm.common import materialize
from quaylight.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted model doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = {c: f"_own{i}_{c}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # so that no name clashes with the scores
    kept = cumulative_link.toxicity(docs.withColumnsRenamed(own), labels).where("not toxic")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur earlier; n_chars follows the text."""
    kept = line_dedup.deduplicated(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a similarity of 0.8 or more over five-word shingles."""
    return minhash_dedup.deduplicated(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each whole text."""
    return bpe.encode_and_check(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_deduplication),
    ("near dedup", near_deduplication),
    ("decontamination", decontamination),
    ("bpe", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
