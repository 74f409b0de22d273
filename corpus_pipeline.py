"""A training corpus from `documents`: quality, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of `documents`.

Defined results: rows with a null or repeated doc_id are rows like others, told apart by numbers that
last for a stage; of equal or near-equal texts one row stays; a null text counts as empty; texts
without words are never taken into the mix; columns beyond those used go along, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandel.llm import exact_dedup, minhash_dedup, mixing, packing, quality_classifier
from strandel.llm.common import give_back, passing_cuts, remove, scratch_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    give_back(spark)
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    give_back(spark)
    return exact_dedup.one_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share most five-word shingles."""
    give_back(spark)
    return minhash_dedup.one_of_each(docs, minhash_dedup.Rule())


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    give_back(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in training sequences."""
    give_back(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed),
]

#: The classifier, the mix's draws and the packing have no SQL form; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`, each written to the shared folder and read again.

    What a stage has read is deleted once its result is written, and so are its checkpoints.
    """
    folder = scratch_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with passing_cuts(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
