"""A training-data pipeline of five operators: language identification, near-duplicate removal, benchmark
decontamination, redaction of secrets, and mixing of sources.

Each stage gets ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept, with the columns of
``documents``; the last one adds what the mix takes of each document. :func:`run` writes every stage's rows to
the shared folder and reads them again, so that a lost executor repeats tasks of one stage at most; what a stage
wrote on its way, and its input, are deleted then.

In every stage null texts, empty ones, repeated rows and ties have the result that its operator's docstring gives; an
empty table stays empty; columns besides those of ``documents``, whatever their names, are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm import decontamination, language_id, mixing, secret_scan, simhash
from signalspark.llm.shared import drop_written, free_names, new_folder, scratch, table

#: A document nearer to no language than this (score of the operator) is rejected, as is one without letters.
LEAST_LANGUAGE_SCORE = 0.2


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text is in one of the learned languages; null and empty texts and those without a letter
    go; the columns stay as they are. With nothing to learn from there is nothing to reject."""
    profiles = language_id.learn(docs, language_id.remainder(F.col("i"), 3) != 1)
    if not profiles.languages:
        return docs
    language, score = free_names(docs, "language_found", "language_score")
    found = language_id.predict(docs, profiles, keep=tuple(docs.columns), names=(language, score))
    return found.where((F.col(language) != language_id.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(language, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of documents linked by their fingerprints, the one with the smallest id (one row of
    it, if it is repeated). A document with a null id stays only in a group of such documents, once."""
    return simhash.first_of_groups(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, with all their repeats; null and empty texts hold none."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.without(docs, found)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts; no document is dropped, null and empty texts stay."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``size``, ``source_size``, ``target`` and ``taken``; those that it
    takes nothing of go."""
    return mixing.with_shares(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", languages),
    ("near-dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("secrets", without_secrets),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        with scratch(spark):
            done = stage(spark, docs, sf_dir)
            done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before is not None:
            drop_written(before)
        before = docs
    return docs


#: Language profiles and fingerprints of bits have no reasonable SQL form; tests hold the stages against
#: brute force.
ORACLE_SQL = None
