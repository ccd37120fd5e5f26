"""The corpus pipeline: stages over the documents table, each written as Parquet and read again before the next.

Stages, each working on all that the one before kept:

1. toxicity: documents that the ordinal model rejects go. The model is fit on labelled documents of the input table.
2. near duplicates: of each component of the n-gram Jaccard join the document of the lowest id stays.
3. personal data: spans are replaced by the name of their kind; no document goes.
4. mixing: each document stands as often as the mix takes it; those that it doesn't take go.
5. packing: the texts as pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import jaccard_join, mixing, packing, personal_data, toxicity
from faultline.llm.shared import materialize


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, toxicity.grades(labels)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copies_of(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("personal data", private), ("mixing", mixed), ("packing", packed)]

#: A trained model, a sampled mix and a tokenizer: not for SQL. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
