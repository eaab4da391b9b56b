"""Each operator of this subpackage over its whole table, as registered queries."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audio, bpe, chat, classifier, jaccard, language, licences, minhash, mixing, rules, substrings, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_turns(rows.unionByName(extra)))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classifier.score(docs, classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix_sources(documents(spark, sf_dir))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.learn(docs)).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(documents(spark, sf_dir))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time spans come as JSON; the tensors themselves are columns of media_columns() and blocks of tensor_blocks()."""
    d = audio.media_columns(documents(spark, sf_dir))
    return d.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.to_json("spans").alias("spans"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it doesn't fit in a long; the operator's own is a decimal of 38 digits."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(documents(spark, sf_dir))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_bpe": op3_bpe,
    "op4_licences": op4_licences,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_substrings": op7_substrings,
    "op8_language": op8_language,
    "op9_rules": op9_rules,
    "op10_audio": op10_audio,
    "op11_alignment": op11_alignment,
    "op12_whitening": op12_whitening,
    "op13_jaccard": op13_jaccard,
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE = {"op4_licences": licences.oracle(), "op9_rules": rules.oracle()}
