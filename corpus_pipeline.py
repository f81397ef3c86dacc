"""A training-data pipeline over ``documents``: five stages, each one operator of ``jabcheck.llm``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jabcheck.llm import linededup, neardup, packing, quality, substrings
from jabcheck.llm.common import release, ship, staged, storing, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it now is."""
    return docs.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are boilerplate of their source; copies count as one page."""
    return _measured(linededup.dedup_lines(docs, once=True), docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id."""
    return neardup.one_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that an earlier document has."""
    return _measured(substrings.without_repeats(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in batches of similar length."""
    return packing.pack(docs)


def _stage(number: int, function: Stage) -> Stage:
    """``function`` as a stage: first, what the stage before has stored for itself is deleted.

    The result of that stage has been written by then, as a stage reads files only.
    """

    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        release(spark, f"stage-{number - 1}")
        with storing(f"stage-{number}"):
            return function(spark, docs, sf_dir)

    return stage


STAGES = [
    (name, _stage(number, function))
    for number, (name, function) in enumerate(
        (
            ("quality", good_documents),
            ("lines", without_boilerplate),
            ("near_duplicates", without_near_duplicates),
            ("repeated_passages", without_repeated_passages),
            ("packing", packed),
        )
    )
]

#: SQL expresses neither the classifier nor the forest; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; the others are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        with storing("pipeline"):
            docs = staged(result)
    return STAGES[-1][1](spark, docs, sf_dir)
