"""From raw documents to packed training sequences.

Five stages, each over all that its predecessor kept.  A stage's result is written as Parquet
and read again as the next one's input, so a lost executor repeats one stage at most.

Defined results: an empty table passes every stage as an empty table; null ids are kept
like any other; rows that repeat an id and its text stay once; columns beyond those of
``documents`` do not pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialmill.llm import language, minhash, packing, secrets, suffixes
from trialmill.llm.common import cut, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes from which a repeated passage goes: fifty words of prose and their blanks are 250 bytes and more.
PASSAGE = 250


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letter (``und``); a missing language is filled in."""
    small_batches(spark)
    model = language.fit(docs, F.lit(True))
    found = language.identify(docs, model, keep=COLUMNS)
    kept = found.where(F.col("lang_pred") != language.UNKNOWN) if model.languages else found.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    return kept.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit(language.UNKNOWN)))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id (five words, similarity 0.8).

    Rows of one id stay or go together; the same id and text stays once.
    """
    small_batches(spark)
    found = minhash.near_duplicates(docs, words=5)
    kept = found.where(F.col("kept")).select("doc_id").distinct()
    gone = cut(found.where(~F.col("kept")).select("doc_id").distinct().join(kept, "doc_id", "left_anti"), "gone")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of ``PASSAGE`` bytes or more but for one copy of each; texts with nothing left go."""
    small_batches(spark)
    rest = suffixes.without_repeats(docs.select(*COLUMNS), PASSAGE, keep_first=True)
    return _measured(rest.where(F.col("text").rlike(r"\S")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; all documents stay."""
    small_batches(spark)
    return _measured(secrets.mask_secrets(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: No stage is expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
