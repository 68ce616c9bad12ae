"""The corpus pipeline: quality rules, quality classifier, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; the
rows that a stage rejects are gone for the next. run() writes each stage's rows as Parquet into the shared folder and
rereads them, so that a stage starts from files and not from the work before it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hustings.llm import jaccard, ordinal, packing, quality
from hustings.llm.common import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence limits."""
    return quality.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade reaches the least; fitted on those of them that are labelled."""
    model = ordinal.fit(docs, ordinal.graded(table(spark, sf_dir, "labels")), 3)
    return ordinal.select(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return jaccard.first_of_each(docs, n=5, numerator=80, denominator=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of at most 1024 tokens."""
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), added=added)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("packing", pack)]

#: SQL can't express the fitted classifier nor the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
