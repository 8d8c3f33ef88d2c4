"""From raw documents to token ids: toxicity, near duplicates, benchmark leaks, source mixture, token output.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the
next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, simhash, tokens, toxicity
from tessera.llm.common import held_out, kept, own_folder, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(run: Stage) -> Stage:
    """Tables that a stage stages stand in a folder of its own, which the next stage deletes: by then the result is written. A next stage whose ``docs`` still read from the folder leaves it."""

    @wraps(run)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with own_folder(spark, docs):
            return run(spark, docs, sf_dir)

    return staged


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learned from the labels of the rows that are not held out."""
    labels = read_table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, labels)


@stage
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are at least 0.8 alike."""
    return simhash.keep_one_of_each_group(docs)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the sources' target weights ask."""
    return mixing.mix(docs)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files say of each document (doc_id, start, n_tokens, ids_crc32)."""
    return tokens.token_digest(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixture", mixed),
    ("token_ids", token_ids),
]

#: No stage but the mixture can be written in SQL; tests hold near duplicates, leaks, mixture and ids against brute force or a plain library call, and toxicity against labels that it has not seen.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        out = apply(spark, docs, sf_dir)
        docs = kept(out, name)
    return docs
