"""The corpus pipeline: from documents to packed batches.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return
the columns of documents. A stage's result is written as Parquet and read again before the next one.

1. language: documents without a letter go, and those that no learned language's phrases explain.
2. near_duplicates: of each group of documents linked by similar 5-word shingles the one of least id stays.
3. repeats: windows of 20 words that an earlier document (or place) has are cut out of the texts.
4. decontamination: documents that contain a benchmark item go.
5. packing: the rest is dealt to length buckets and token-budget batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tsveil.llm import decontamination, jaccard, langid, packing, repeats
from tsveil.llm.base import Workspace, documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # it keeps documents, not predictions, so all labelled ones may be learned from
    return langid.keep_identified(docs, langid.training_texts(docs, "text", "lang", "doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_firsts(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express suffix automata or connected components of similar documents; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), name)
        if k:
            space.drop(STAGES[k - 1][0])
    return docs
