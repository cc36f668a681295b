"""The corpus pipeline: five stages from raw documents to a mix, each by one operator of ``tallyloom.llm``.

Every stage works on all rows that its predecessor kept, and is written as Parquet before the next one reads it, in
the shared folder of ``spark.checkpoint.dir``. No documents give no rows; NULL texts and rows are treated as the
operator of each stage says. All stages but the last return the columns of ``documents``, further ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, mixing, ngram_join, quality, secret_scan
from tallyloom.llm.storage import fresh_folder, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose n-grams are like those of documents labelled good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_documents(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: a row with the smallest id."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and ``n_chars`` counted anew where that changed the text.

    Findings come from a ledger that the stage stores; each run starts a new one, so that runs do not depend on each other.
    """
    found = secret_scan.scan_with_ledger(docs, fresh_folder(spark, "secret-ledger"))
    text = secret_scan.redact(F.col("text"), F.col("findings"))
    chars = F.when(F.size("findings") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": chars}).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
]
#: The weights of hashed n-grams and the permutations of the mix are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
