"""A corpus pipeline: documents go through five stages, each written as Parquet and read again.

1. language: documents without a letter, or whose spans are of no clear language (mean certainty under 0.5), go; one text may hold several languages. If no row has a lang to learn from, all with letters stay.
2. near_duplicates: of each group of rows that links of 0.8 or more on five-word shingles form, the one with the smallest id stays.
3. secrets: secrets in the texts are replaced by a mark; no document goes.
4. mixing: documents come in the order of a Pfair schedule of tempered source weights; when a source has run out, the others go on. No document goes.
5. tokens: the texts' token ids, with their decoded text's digest.

Defined cases: a null or empty text goes in the first stage. Rows without an id are documents like others; in a group they give way to rows with one. Different
texts under one id are different documents; of rows with equal id and text one stays. Other columns come along as they are, whatever their names, up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, language_id, ngram_join, pfair_mix, secrets
from tidemark.llm.common import fresh, read, work_path

LEAST_LANGUAGE_CERTAINTY = 0.5
MIX_WEIGHT_POWER = 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = fresh(docs, "_lang_pred", "_lang_score", "_lang_certainty")
    labelled, sure = language_id.identify_rows(docs, names), F.col(names[2])
    return labelled.where(sure.isNull() | (sure >= LEAST_LANGUAGE_CERTAINTY)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_classes(docs, k=5, threshold=80)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pfair_mix.mixed(docs, power=MIX_WEIGHT_POWER)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.encode(docs, path, decoded=True)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", no_secrets), ("mixing", mixing), ("tokens", tokens)]

#: Language models, signatures, Markov models and schedules can't be told in SQL; tests/llm/ holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
