"""A training corpus from documents: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the documents that stay, with all their columns, clashing names or
not; the last returns the packed pieces.  run() writes each result as Parquet and
reads it again.  An empty table stays empty in every stage; rows with a null
doc_id are handled like others; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.llm import decontaminate, langid, neardup, packing, substrings
from corpuswright.llm.store import written

#: Bytes of a repeated passage: about fifty short words, so that passages over fifty words are found.
PASSAGE = 256


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a dominant language; their lang is the one found. Null and empty texts and texts without a letter have none and go; ties go to the first language; repeated rows are judged alike."""
    return langid.keep_known(docs, langid.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least doc_id (null last), then the least MD5 of the text; of rows that repeat both, one. All null and empty texts are one class."""
    return neardup.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated passages; those with nothing left go. Null and empty texts repeat nothing and stay; every copy of a passage goes, so ties don't arise; repeated rows repeat each other."""
    left = substrings.without_repeats(docs, match=PASSAGE)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows are judged alike; no benchmark items leave all."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. Null and empty texts are their end token; pieces of one length are taken in the order of their keys; repeated rows are packed each."""
    return packing.pack(written(packing.cut(docs), "pieces")[0])


STAGES = [
    ("language_id", language),
    ("minhash_neardup", near_copies),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("best_fit_packing", pack),
]

#: Learned weights, sampled hashes and packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return docs
