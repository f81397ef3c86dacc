"""Numbers behind set-intersection charts, from released counts per source combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jabcheck.functions.labels import SOURCES, source_combination
from jabcheck.operators.counts import unroll_rows

def intersections(counts: DataFrame) -> DataFrame:
    """Size of each exclusive intersection, ranked by frequency within its campaign."""
    combination = source_combination(*[F.col(s) for s in SOURCES])
    by_size = W.partitionBy("campaign").orderBy(F.col("n").desc(), "combination")
    return (
        counts.groupBy("campaign", combination.alias("combination"))
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(by_size))
    )


def set_sizes(counts: DataFrame) -> DataFrame:
    """People in each source per campaign, whatever else they are in."""
    sums = counts.groupBy("campaign").agg(
        *[F.sum(F.when(F.col(s), F.col("n")).otherwise(0)).alias(s) for s in SOURCES]
    )
    entries = [F.struct(F.lit(s).alias("source"), F.col(s).alias("n")) for s in SOURCES]
    return sums.select("campaign", F.inline(F.array(*entries)))


def uncount(counts: DataFrame) -> DataFrame:
    """One row per person, with the sources as 0/1."""
    people = unroll_rows(counts, "n")
    return people.select("campaign", *[F.col(s).cast("int").alias(s) for s in SOURCES])
