"""From raw documents to token ids: quality, lines, near-duplicates, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.

Null texts count as empty: they pass the classifier by their length class, hold one empty line, are in
no group, hold no item and have no token.  Null ids and repeated rows are rows like others, but of
repeated rows of one id and text one stays.  Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetrace.llm import bpe, decontaminate, lines, neardup, quality
from cinetrace.llm.common import Scratch, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.grade(docs, model).filter("accepted").select(docs.columns)


def without_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand in many documents; n_chars follows the text."""
    found = lines.drop_frequent_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to the very same bytes."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), RANKS, PATTERN), RANKS, PATTERN)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_frequent_lines),
    ("near-duplicates", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", encoded),
]

#: SQL cannot express the trained first stage; tests check every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        after = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            scratch.drop(written)
        docs = written = after
    return docs
