"""Corpus pipeline over ``documents``: language, near duplicates, benchmark items, private data, tokens."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, language, nearcopies, queries, surrogates


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go."""
    return language.keep_identified(docs, queries.language_models(docs), raw_text="text", file_id="doc_id", host="source")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8) stays."""
    return nearcopies.keep_one_of_each(docs, raw_text="text", file_id="doc_id")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items, raw_text="text", file_id="doc_id", item_id="item_id", item_text="text")


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data become surrogates; the length follows the text."""
    fresh = surrogates.replace_private_data(docs, queries.SURROGATE_KEY, raw_text="text", file_id="doc_id")
    return fresh.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(fresh.schema["n_chars"].dataType)))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    coded = bpe.encode_documents(docs, queries.tokenizer_file(), raw_text="text", file_id="doc_id", decoded=False)
    return coded.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("pii_surrogates", replace_private_data),
    ("bpe_tokens", encode_tokens),
]

# The stages use fitted models, hashes and merges that SQL does not express; they are tested against brute force.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A fresh folder for what the stages write, in the shared folder that the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
        base = tempfile.mkdtemp(prefix="corpus-pipeline-")
    return f"{base.rstrip('/')}/pipeline-{os.urandom(8).hex()}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again as the next one's input."""
    folder = _folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
