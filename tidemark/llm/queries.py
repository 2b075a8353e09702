"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, langid, licenses, lm, nearest, negatives, pivots, quality, repeats, secrets, similar, spelling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def word_bpe_json() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), word_bpe_json()))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles from two thirds of the documents, predictions for all."""
    docs = table(spark, sf_dir, "documents")
    part = langid.fold(F.col("doc_id"), 3)
    found = langid.predict(docs, langid.profiles(docs.filter(part != 1)))
    return found.select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score")


@query("op2_secrets", secrets.ORACLE)
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents"), secrets.repository_of_source(), F.col("source")))


@query("op4_decontaminate", decontaminate.ORACLE)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op1_jaccard", similar.ORACLE)
def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_repeats", repeats.ORACLE)
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove(table(spark, sf_dir, "documents")))


@query("op6_lm")
def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = langid.fold(F.col("doc_id"), 10)
    return lm.score(table(spark, sf_dir, "documents"), part == 0, part == 1)


@query("op3_licenses")
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its candidate blocks, the confirmed licenses and the blocks as start:end:license."""
    scanned = licenses.scan(table(spark, sf_dir, "documents"))
    named = F.filter(F.transform("blocks", lambda b: b["license"]), lambda x: x.isNotNull())
    written = F.transform("blocks", lambda b: F.concat_ws(":", b["start"].cast("string"), b["end"].cast("string"), F.coalesce(b["license"], F.lit("?"))))
    return scanned.select(
        "doc_id", F.size("blocks").cast("long").alias("n_blocks"), F.size(named).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("licenses"), F.array_join(written, ",").alias("blocks"),
    )


@query("op10_nearest", nearest.ORACLE)
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_topk", pivots.ORACLE)
def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op13_negatives", negatives.ORACLE)
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label in seven is wrong on purpose, as given labels are."""
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, noisy)


@query("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run in 97 of the given texts is misspelled on purpose before words are counted."""
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), typos=97))
