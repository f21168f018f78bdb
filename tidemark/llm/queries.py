"""The queries opN_<name>: each applies one operator to its whole table and derives the columns that its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, knn_join, language_id, line_rules, ngram_join, pfair_mix, pii, quality_pu, secrets, sharding, turn_repair, vector_codes, warc_zip
from .common import read, work_path
from .oracle import ORACLE_SQL  # noqa: F401


def fold(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    """How many base spans have the kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def base_digest(spans: Column) -> Column:
    return F.sha2(joined(F.filter(spans, lambda s: s["base"])).cast("binary"), 256).alias("base_sha256")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    found = pii.personal_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *(counted(spans, k) for k in pii.BASE), base_digest(spans), joined(spans).alias("spans"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    found = secrets.secret_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *(counted(spans, k) for k in secrets.BASE), base_digest(spans), joined(spans).alias("spans"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(read(spark, sf_dir, "documents"), learn_from=fold(3) != 1)
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc_zip.archive_and_read(spark, read(spark, sf_dir, "pages"), work_path(spark, "warc"), least=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.encode(read(spark, sf_dir, "documents"), path, decoded=True)
    hex_of = lambda text: F.sha2(text.cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hex_of(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), hex_of(F.col("decoded")).alias("decoded_sha256"))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "place", "in_mix")


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(read(spark, sf_dir, "documents"), with_cleaned=False).drop("cleaned")


def op8_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.knn_join(read(spark, sf_dir, "embeddings"), is_query=F.col("id") % 50 == 0, k=5, scale=256.0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_pu.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), learn_from=fold(5) != 0)
    return found.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read(spark, sf_dir, "documents"), k=4, threshold=85)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(read(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096.0)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.pack(read(spark, sf_dir, "documents"), shards=16)


QUERIES = {"op1_pii": op1_pii, "op2_secrets": op2_secrets, "op3_language_id": op3_language_id, "op4_warc": op4_warc, "op5_bpe": op5_bpe, "op6_pfair_mix": op6_pfair_mix, "op7_line_rules": op7_line_rules, "op8_knn_join": op8_knn_join, "op9_quality": op9_quality, "op10_ngram_join": op10_ngram_join, "op11_turn_repair": op11_turn_repair, "op12_vector_codes": op12_vector_codes, "op13_sharding": op13_sharding}
