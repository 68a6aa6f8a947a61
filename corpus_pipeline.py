"""A corpus pipeline over ``documents``: five stages, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import materialize
from strandline.llm.decontamination import without_benchmark
from strandline.llm.jaccard import keep_one
from strandline.llm.langid import predict, train
from strandline.llm.packing import pack_documents
from strandline.llm.queries import read, vocabulary
from strandline.llm.suffixes import without_repeats

#: The least score of a language that is accepted.
LEAST_SCORE = 0.5


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter or without a clear language go.

    A null or empty text goes; repeated rows are judged each; with nothing to learn from, all go.
    """
    found = predict(docs, train(docs))
    return _documents(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies; equal rows count once.

    A null doc_id stays only where nothing in its group has an id.
    """
    return _documents(keep_one(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that occur earlier; what is then empty goes."""
    return _documents(without_repeats(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null texts hold none, and an empty benchmark lets all stay."""
    return _documents(without_benchmark(docs, read(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), length=1024, added=True)


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again. Columns beyond those of documents are not kept."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


#: Tokens, code lengths and alignments are beyond SQL: each operator is tested against brute force or its
#: definition, and the chain on a fixture in which the fate of every document is known.
ORACLE_SQL = None
