"""The corpus pipeline: five stages over ``documents``, each working on all that the one before it kept.

Quality rules, toxicity and decontamination drop rows, near-duplicate removal
keeps one row of each group, packing returns the pieces of the final sequences.

All stages take every row: NULL, empty and blank texts have no words, so quality
rules drop them; texts of any length are read whole; rows with NULL ids are judged
like others. Repeated rows and ids are copies, of which near-duplicate removal
keeps one (ties: smallest fingerprint, then smallest hash of the text). Further
columns, also of clashing names, stay as they are up to the last stage. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.llm import decontamination, packing, quality_rules, simhash, toxicity
from tidegate.llm.queries import tokenizer
from tidegate.llm.tables import table
from tidegate.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=3, distance=3)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer(), packing.Capacity(), end_id=2)


STAGES = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", uncontaminated),
    ("best-fit packing", packed),
]

# Learned rules, trained scores, alignments and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
