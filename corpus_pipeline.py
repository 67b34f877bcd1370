"""A training-corpus pipeline over `documents`: reject, deduplicate, decontaminate, pack.

Each stage works on all that the stage before it kept, as written to Parquet and read
again, and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoebox.llm import chunks, decontaminate, minhash, packing, quality
from shoebox.llm.queries import table, tokenizer_path
from shoebox.llm.spark_tools import forget, saved


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest id."""
    return minhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier place has; texts of which nothing is left go."""
    cut = chunks.cut_repeats(docs)
    return cut.where("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: No stage but the filters of the last two could be SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = saved(stage(spark, docs, sf_dir), name)
        if k:  # nothing reads the stage before any more
            forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
