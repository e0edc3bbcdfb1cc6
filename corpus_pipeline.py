"""Corpus pipeline: the training-data operators as stages over ``documents``.

Each stage works on all documents that the one before kept, and its decisions take
effect: toxic documents go; of each group of near copies the document with the
smallest id stays; documents that hold a benchmark item go; sources are mixed to
their target weights (a document of a source above its size comes twice); the last
stage gives each row its shard and slot. All but the last return the columns of
``documents``. The rows cannot be stated in SQL (learned grammar, MinHash, walks), so
tests compare each stage with a brute-force version.

Defined results: a null text counts as the empty text, which is not toxic, holds no benchmark
item and has no near copy but other empty texts; rows without id are kept like any other, and
come after all ids where one of a group is chosen; repeated rows are copies of each other;
ties are decided by the operators' own orders; texts are read whole, however long; further
columns of ``documents`` stay, also under names that the operators use; empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carelake.llm.common import read_table, written
from carelake.llm.decontam import without_leaks
from carelake.llm.mixing import mix_documents
from carelake.llm.ngram_join import one_of_each
from carelake.llm.sharding import shard_documents
from carelake.llm.toxicity import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs)


STAGES = [("toxicity", toxicity), ("ngram_join", near_copies), ("decontaminate", decontaminate),
          ("mix", mix), ("shard", shards)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
