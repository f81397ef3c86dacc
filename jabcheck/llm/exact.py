"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jabcheck.llm.common import SPACE, staged

#: Characters of the normalised text that the second step hashes.
PREFIX = 64


def normalised(text: Column) -> Column:
    """The text without white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]", "")


def _met_again(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys of more than one row."""
    return rows.groupBy(*keys).count().filter("count > 1").drop("count")


def exact_groups(docs: DataFrame, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept`` and the ``carry`` columns for each row.

    Texts are equal when they are the same without white space. Of equal texts the row with
    the most characters stays, then that with the smallest ``doc_id`` (NULL last).
    ``keep_id`` is the ``doc_id`` of the row that stays. Rows that repeat both id and length
    share one fate: all of them are ``kept``. NULL texts count as empty, and all empty texts
    are one group. ``carry`` names expressions over the input's own columns to hand on.

    Rows are first grouped by the length of the text. Only those whose length occurs again get
    a prefix hash, and only those whose length and prefix occur again a full hash, each in a
    read of the text of its own; a row that drops out at any step is alone. Groups are folded
    and stored before any join, so each join is one of two plain shuffles, of which adaptive
    execution splits a group that holds a third of all rows.
    """
    text = docs["text"]
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        F.length(F.coalesce(text, F.lit(""))).alias("n_chars"),
        normalised(text).alias("norm"),
        *[c.alias(f"carry_{n}") for n, c in (carry or {}).items()],
    ).withColumns({"size": F.length("norm"), "start": F.substring("norm", 1, PREFIX)})
    lengths = staged(_met_again(rows, "size").withColumn("met", F.lit(True)))
    met = rows.join(lengths, "size", "left").withColumn("prefix", F.when(F.col("met"), F.xxhash64("start")))
    again = staged(_met_again(met.filter("met"), "size", "prefix").withColumn("again", F.lit(True)))
    read = staged(
        met.join(again, ["size", "prefix"], "left").select(
            "doc_id",
            "n_chars",
            F.when(F.col("again"), F.sha2(F.col("norm"), 256)).alias("full"),
            *[F.col(f"carry_{n}").alias(n) for n in carry or {}],
        )
    )
    best = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = staged(
        read.filter("full is not null")
        .groupBy("full")
        .agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    )
    grouped = read.filter("full is not null").join(groups, "full").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (best == F.col("best")).alias("kept"),
        *(carry or {}),
    )
    alone = read.filter("full is null").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        *(carry or {}),
    )
    return grouped.unionByName(alone)
