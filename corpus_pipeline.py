"""A corpus pipeline over ``documents``: each stage works on all rows its predecessor kept.

Quality rules drop what they reject, the first document of each group of near
copies (by SimHash and MinHash keys, then five-word Jaccard of 0.8 or more) stays, decontamination drops documents
with benchmark passages, personal numbers become pseudonyms, and what is left is
packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import near_copies, packing, pseudonyms, quality, templates
from plumbline.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Candidates from op6's fingerprint trees, and from keys for what four bits miss; whole shingle sets decide."""
    return near_copies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text: an address may change its length."""
    return pseudonyms.rewritten(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_rows(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("pack_sequences", pack_sequences),
]

#: Fingerprints, keyed permutations and token ids are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
