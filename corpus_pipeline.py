"""Corpus pipeline over documents: language, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.

Defined cases: documents with a null text or without a letter go at the first stage; rows of null or repeated doc_id are told apart by
their texts, and of equal rows one stays; a null source is the queue ""; columns of other names are carried along up to packing; an
empty table, or an empty benchmark, gives what is left: no pieces, or all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, jaccard, language, packing, pii
from seqloom.llm.common import table, written


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or of no clear learned language."""
    return language.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of linked documents."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of what is left into sequences."""
    return packing.pack(docs)


STAGES = [("language", keep_language), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal data", mask_personal_data), ("packing", pack)]

#: The stages learn a model, find components and tokenize: SQL can't state their rows. Tests compare the pipeline with its rules in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
