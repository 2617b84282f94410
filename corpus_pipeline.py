"""A corpus pipeline in five stages; each takes the documents that the one before has kept.

Quality rules drop documents; of near duplicates (five-word shingles, similarity 0.8) one stays;
documents with a benchmark passage go; personal data is masked in the texts; the last stage encodes
what is left and gives the digests of ids and decoded text. Nulls, empty tables, repeated rows and
further columns are treated as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, near_dedup, pii, quality
from ledgerloom.llm.common import free_name, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "hits")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), name=name)
    return found.where(F.col(f"{name}.n_hit") == 0).drop(name)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("benchmark passages", drop_contaminated),
    ("personal data", mask_personal),
    ("byte pair encoding", encode),
]

#: Fitted cutoffs, hashes and merges are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
