"""From raw documents to token ids: toxicity, near duplicates, repeated passages, leaks, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, leaks, near, substring, toxicity
from keyloom.llm.common import scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. Null and wordless texts have no evidence and stay; equal texts score
    alike, so repeated rows stay or go together."""
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=COLUMNS)
    return scored.where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of texts. Documents without an id are judged alike; one
    stays where no document of its class has an id. Texts that share a doc_id are not copies by that."""
    return near.one_per_class(docs).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated words; those that lose all their words go. A document that
    loses none keeps its text as it is, null and empty ones too. A null id counts as the least, rows of one
    id as one document, whose rows do not remove each other's words at the same place."""
    done = substring.remove_repeats(docs, carry=("lang", "source"))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    left = done.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, by their texts: an id may be missing or stand for several. Null and
    empty texts hold none."""
    docs = docs.withColumn("digest", near.digest(F.col("text")))
    found = leaks.find_leaks(docs, table(spark, sf_dir, "benchmark"), key="digest").select("digest").distinct()
    return docs.join(found, "digest", "left_anti").select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to; null and empty texts have no ids and
    decode to the empty text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("leaks", drop_leaks),
    ("tokens", to_tokens),
]

#: No stage's search or model can be said in SQL; tests/llm/test_pipeline.py holds them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{scratch(spark)}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
