"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluviant.llm._spark import shared_folder, table
from pluviant.llm.decontaminate import clean
from pluviant.llm.jaccard import one_of_each
from pluviant.llm.langid import keep_identified
from pluviant.llm.mixing import mixed_documents
from pluviant.llm.sharding import place


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language go: null, without a letter, or more like codes, disorder and unknown languages than the limit."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by runs of five words at a similarity of 0.8, the one with the smallest id stays, null ids last."""
    return one_of_each(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a run of ten words of a benchmark item, or all words of a shorter one, go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of each source by the mix's targets: a row for each time that words of a document are taken."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard: doc_id, source, n_chars, sha256 of the text, slot, shard."""
    return place(docs.select("doc_id", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The stages learn a network and draw a mix, which SQL can't; tests/llm/ holds each against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
