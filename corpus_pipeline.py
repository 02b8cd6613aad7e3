"""The corpus pipeline: toxic documents out, copies out, near copies out, sources mixed, the rest packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewind.llm import exact_dedup, mixing, packing, simhash, toxicity
from tradewind.llm.common import Stage, arrow_batches


#: Text parts that a worker keeps; fewer than in packing alone, because workers live on between stages.
CACHE_PARTS = 150_000
#: Bytes of an Arrow batch while the stages run.
BATCH_BYTES = 8 << 20


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each text."""
    return exact_dedup.kept_documents(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash group, with the shingle length and bit distance of op10."""
    return simhash.kept_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in token sequences."""
    return packing.pack(docs, cache_parts=CACHE_PARTS)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("mixing", mixed),
    ("packing", packed),
]

#: Fingerprints and token ids have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with arrow_batches(spark, BATCH_BYTES):
        for number, (name, step) in enumerate(STAGES):
            docs = stage.put(step(spark, docs, sf_dir), f"{number}-{name}")
    return docs
