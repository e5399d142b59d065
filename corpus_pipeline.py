"""From documents to packed training sequences.

Each stage works on all that the one before it kept, and its decisions take
effect: rejected documents go, one document of each class of near-duplicates
stays, personal data is masked in the text, and what is left is packed.  A stage
that changes texts keeps ``n_chars`` true.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import neardup, packing, pii, quality
from weftline.llm.common import Scratch, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, keep_ids=True, remembered=120_000)  # the cluster also holds what the stages before it left


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("PII", personal_data), ("packing", packed)]

#: The rules' order, the sketches and the transducers have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
