"""From raw documents to token ids in five stages. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`. A stage's result is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import bpe, language, minhash, mixing, substrings
from episodica.llm.util import shared_table

#: A document stays if at least this share of its letters is in one learned language and reads like it.
LEAST_SHARE = 0.5


def boxed(docs: DataFrame, *others) -> DataFrame:
    """All columns as one struct `row`, beside those that an operator reads: no name of a row can clash with a result's."""
    return docs.select(F.struct("*").alias("row"), *others)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are surely of one learned language. Null texts and texts without letters go.

    Repeated rows stay or go together, a null id or source changes nothing, an empty table gives an empty one; extra columns, whatever
    their names, pass through; texts are read whole.
    """
    rows = boxed(docs, "doc_id", "text")
    found = language.identify(rows, language.learn(docs), keep=("row",))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the one with the least id (none comes last), then the least digest of its text, then the least other columns.

    A document is what has one id and one text; either may be null. Rows that share an id only are different documents. Documents
    without words link with nothing and stay, once each if rows repeat. An empty table gives an empty one; extra columns, whatever
    their names, pass through (they must have an order, as any but maps do); texts are read whole.
    """
    keyed = boxed(docs, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("key"), "doc_id", "text")
    groups = minhash.near_duplicates(keyed, "key").select("key", "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("digest"), "key")
    stay = keyed.select("key", order.alias("order")).join(groups, "key").groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.key").alias("key"))
    return keyed.join(stay, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row")).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated passages; every row stays, n_chars (where there is one) is counted anew.

    A null text stays null, a text under 35 words stays as it is, repeated rows lose all words if they have 35 or more; an empty table
    gives an empty one; extra columns, whatever their names, pass through; texts are read whole.
    """
    others = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars"))).alias("row"), "text")
    out = substrings.remove_repeats(others, with_text=True, keep=("row",))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most.

    Null and empty texts weigh nothing; they stay once where their source is wanted in half or more. A null source is a source.
    Repeated rows share one decision; an empty table gives an empty one; extra columns, whatever their names, pass through.
    """
    return mixing.take(docs, mixing.decide(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: doc_id, lang, source, ids, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no ids; repeated rows and null ids pass through; an empty table gives an empty one; extra columns are left
    out; texts are read whole.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("lang", "source"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mix), ("bpe", encode)]
#: The stages learn, hash and draw; the tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
