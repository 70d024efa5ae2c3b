"""A corpus pipeline of five stages: toxicity, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return documents with all their columns. Documents are dropped by the first three, changed by the
fourth, which hides secrets, and laid out in sequences by the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, packing, secrets, simhash, toxicity
from quern.llm.common import staged, table
from quern.llm.tokens import encoder_of, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic. The model learns from the labelled rows of documents as they came."""
    model = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with marks in place of secrets."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences and offsets."""
    path = tokenizer_path("byte_bpe_50k.json")
    return packing.packed(docs, lambda: encoder_of(path, spaced=True))


STAGES = [("toxicity", toxicity_stage), ("simhash_near_dedup", near_dedup_stage), ("benchmark_decontamination", decontamination_stage), ("secret_scans", secrets_stage), ("best_fit_packing", packing_stage)]

#: SQL can't express the tokenizer, the toxicity model or XXH64; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
