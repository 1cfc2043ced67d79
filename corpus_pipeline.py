"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Quality rules reject documents; of each group of near duplicates one document stays; documents with a benchmark
passage go; the rest is mixed, each document as often as its source's share takes it; what comes out is tokenised and
written in training order, one result row per sequence. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import decontaminate, jaccard, mixing, quality, tokens
from logweave.llm.queries import table
from logweave.llm.session import delete, new_folder, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.materialise(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: The model's verdicts, the random search and the permutation have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's input, and what it stored on the way, is deleted once its result is stored; the
    shards and their index stay, as the rows are read from there."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        source, path = path, new_folder(spark, name)
        with scratch(spark):
            if name == STAGES[-1][0]:
                docs = stage(spark, docs, sf_dir)
            else:
                out = stage(spark, docs, sf_dir)
                out.write.parquet(path)
                docs = spark.read.schema(out.schema).parquet(path)
        if source:
            delete(spark, source)
    return docs
