"""The training-data pipeline: stages over documents, each written as Parquet and read again as the next one's input.

quality   rejected documents go (label model and hashed scorer, taught on the stage's own input and the labels)
jaccard   one document of each group of near duplicates stays
benchmark documents with a benchmark window go
secrets   secrets in the texts are replaced by a mark
bpe       token ids and decoded texts, as digests

Nulls, empty texts, repeated rows, empty tables and extra columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, quality, secrets, similar
from tidemark.llm.queries import table, word_bpe_json
from tidemark.session import shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.repository_of_source(), F.col("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(docs, word_bpe_json()))


STAGES = [
    ("quality", keep_quality),
    ("jaccard", keep_one_of_similar),
    ("benchmark", drop_benchmark),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: The classifier, the tokenizer and the redaction are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the cluster's shared folder and read by the next."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
