"""From raw documents to indexed token ids: five stages, each over all that the one before it kept.

Every stage takes an empty table, and columns beside those it reads, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonespan.llm import decontaminate, minhash, mixing, quality, tokenstore
from tonespan.llm.common import stored, table, unused


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among docs, accepts.

    Null texts and those without words go; equal texts are judged alike; with no labels all texts with words stay.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; rows with a null id or text stay, of rows that repeat an id one stays."""
    return minhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts stay; an empty benchmark changes nothing."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents whose source has tokens, in training order; rows with a null id go, a null source is one of its own."""
    return mixing.mixed(docs, mixing.whole_schedule)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids and their hash index; shards in order of their numbers, and documents in a shard, are in training order.

    The order of rows isn't kept by tables that are written and read again, so positions are made from the rows once more:
    they are those of the stage before, as it keeps every document that has one.  Rows without a position go.
    """
    place = unused(docs, "position")
    return tokenstore.token_store(mixing.placed(docs, mixing.whole_schedule, place), position_col=place)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The classifier, the near copies and the alignment can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
