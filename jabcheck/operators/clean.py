"""First steps on an event table: drop undated rows, name products and campaigns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jabcheck.functions.dates import by_rank, campaign_rank
from jabcheck.sources.writers import write_csv
from jabcheck.study import UNMAPPED, Study


class UnmappedProductsError(ValueError):
    """An event table holds product names that the study does not know."""


def dated(events: DataFrame) -> DataFrame:
    return events.where(F.col("vax_date").isNotNull())


def product_dimension(spark: SparkSession, study: Study) -> DataFrame:
    """Raw product name to level rank: as many rows as the study has products.

    Built from an Arrow table, which Spark plans as a local scan of known size.
    """
    names = [raw for _, raw in study.products]
    ranks = pa.array(range(1, len(names) + 1), pa.int32())
    return spark.createDataFrame(pa.table({"vax_product": pa.array(names, pa.string()), "product_rank": ranks}))


def ranked(events: DataFrame, study: Study) -> DataFrame:
    """Dated events with ``product_rank``, in place of text, for everything downstream.

    An unknown or missing product gets the last rank. The dictionary is a constant of the
    study, so broadcasting it does not depend on the data.
    """
    dimension = F.broadcast(product_dimension(events.sparkSession, study))
    known = dated(events).join(dimension, "vax_product", "left")
    return known.withColumn("product_rank", F.coalesce("product_rank", F.lit(study.unmapped_rank)))


def product_label(study: Study, rank: str = "product_rank"):
    return by_rank(F.col(rank), study.product_labels, "string")


def campaign_label(study: Study, rank: str = "campaign_rank"):
    return by_rank(F.col(rank), study.campaign_labels, "string")


def rank_of_campaign(study: Study, day: str = "vax_date"):
    return campaign_rank(day, study.campaign_starts)


def with_campaign(events: DataFrame, study: Study) -> DataFrame:
    return events.withColumn("campaign_rank", rank_of_campaign(study)).withColumn("campaign", campaign_label(study))


def unmapped_products(events: DataFrame, study: Study) -> DataFrame:
    """Raw names that the study does not know, with their number of dated records."""
    return (
        ranked(events, study)
        .where(F.col("product_rank") == study.unmapped_rank)
        .groupBy(F.col("vax_product").alias("vax_product_raw"))
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


def watched(days: DataFrame, study: Study) -> tuple[DataFrame, Observation]:
    """``days``, and what the job that writes them will have seen: all records and unmapped ones.

    ``days`` are folded by product and carry ``n_records``. Observed right before a write, each
    partition counts once; its metrics are there when that job has ended.
    """
    seen = Observation()
    unknown = F.when(F.col("product_rank") == study.unmapped_rank, F.col("n_records"))
    records = F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records")
    return days.observe(seen, records, F.coalesce(F.sum(unknown), F.lit(0)).alias("n_unmapped")), seen


def require_mapped(events: DataFrame, study: Study, path: str) -> None:
    """Stop if there are unknown names; all of them are written to ``path``, a CSV."""
    unknown = unmapped_products(events, study).cache()
    number = unknown.count()
    if number:
        write_csv(unknown.orderBy(F.col("vax_product_raw").asc_nulls_last()), path)
    unknown.unpersist()
    if number:
        raise UnmappedProductsError(f"{number} {UNMAPPED} product names found, listed in {path}")
