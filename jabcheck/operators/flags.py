"""Quality flags: dates, approvals and several records on one day.

Flags live on *patient-days*: one row per patient, day and product with the number of
records behind it. So exact copies and busy patients are folded into counts before
anything is shuffled by patient. Summaries weigh by the counts; a table with one row per
record is unrolled from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jabcheck.functions.dates import by_rank
from jabcheck.functions.labels import PATTERN_SEPARATOR
from jabcheck.operators.clean import campaign_label, product_label, rank_of_campaign, ranked
from jabcheck.operators.counts import fold_rows, unroll_rows
from jabcheck.study import Study

# Flag columns, in order.
FLAGS = (
    "flag_implausible_early_date",
    "flag_pre_rollout_date",
    "flag_unapproved_product",
    "flag_product_before_approval",
    "flag_same_day_multiple",
    "flag_same_day_same_product",
    "flag_same_day_mixed_product",
)

DAY = ["patient_id", "vax_date"]


def date_flags(study: Study, day: str = "vax_date") -> dict[str, Column]:
    when = F.col(day)
    first, start = F.lit(study.first_possible), F.lit(study.start)
    return {
        "flag_implausible_early_date": when < first,
        "flag_pre_rollout_date": (when >= first) & (when < start),
    }


def approval_date(study: Study) -> Column:
    return by_rank(F.col("product_rank"), study.approval_dates, "date")


def approval_flags(study: Study, day: str = "vax_date") -> dict[str, Column]:
    """Before-approval is NULL for an unapproved product: there is no date to compare with."""
    approved = approval_date(study)
    return {
        "flag_unapproved_product": approved.isNull(),
        "flag_product_before_approval": F.col(day) < approved,
    }


def same_day_flags(total: Column, several_products: Column) -> dict[str, Column]:
    multiple = total > 1
    return {
        "flag_same_day_multiple": multiple,
        "flag_same_day_same_product": multiple & ~several_products,
        "flag_same_day_mixed_product": multiple & several_products,
    }


def day_products(events: DataFrame, study: Study, *extra: str) -> DataFrame:
    """Records per patient, day and product (and any ``extra`` patient columns)."""
    return fold_rows(ranked(events, study), *DAY, "product_rank", *extra)


def by_patient(rows: DataFrame) -> DataFrame:
    """One shuffle by patient that every window and per-patient aggregate below reuses.

    After :func:`day_products` a patient has at most one row per product and calendar day,
    so even the busiest patient is a bounded group. The number of tasks is that of shuffle
    partitions: sorts, windows and aggregates share the memory of one task, which partitions
    that adaptive execution makes up to 64 MB of packed rows would fill many times over.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "patient_id")


def flag_days(days: DataFrame, study: Study) -> DataFrame:
    """Campaign and all flags on patient-days that are already partitioned by patient."""
    day = W.partitionBy(*DAY)
    several = F.min("product_rank").over(day) != F.max("product_rank").over(day)
    return (
        days.withColumns(
            {"total_records_day": F.sum("n_records").over(day), "_several": several}
        )
        .withColumns(
            {
                "campaign_rank": rank_of_campaign(study),
                **date_flags(study),
                **approval_flags(study),
                **same_day_flags(F.col("total_records_day"), F.col("_several")),
            }
        )
        .drop("_several")
    )


def flagged_days(events: DataFrame, study: Study) -> DataFrame:
    return flag_days(by_patient(day_products(events, study)), study)


def pattern_text(listed: Column, study: Study) -> Column:
    """Text such as ``2x a  --AND-- 1x b`` from counted products of a day in level order."""
    label = lambda rank: by_rank(rank, study.product_labels, "string")
    entry = lambda e: F.concat(e["n_records"].cast("string"), F.lit("x "), label(e["product_rank"]))
    return F.array_join(F.transform(listed, entry), PATTERN_SEPARATOR)


def _merged_entry(done: Column, entry: Column) -> Column:
    """Add a counted product to a sorted list in which the last one may be the same product."""
    last = F.try_element_at(done, F.lit(-1))
    both = F.struct(entry["product_rank"].alias("product_rank"), (last["n_records"] + entry["n_records"]).alias("n_records"))
    return F.when(
        last["product_rank"] == entry["product_rank"],
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both)),
    ).otherwise(F.concat(done, F.array(entry)))


def same_day_patterns(events: DataFrame, study: Study) -> DataFrame:
    """Per patient-day: totals, the pattern text such as ``2x a  --AND-- 1x b``, and the flags.

    Products are listed in level order. The second grouping starts from counted products,
    so its list has at most one entry per product.
    """
    listed = F.array_sort(F.collect_list(F.struct("product_rank", "n_records")))
    per_day = (
        day_products(events, study)
        .groupBy(*DAY)
        .agg(
            F.sum("n_records").alias("total_records_day"),
            F.count(F.lit(1)).alias("n_products_day"),
            listed.alias("_listed"),
        )
    )
    return per_day.select(
        *DAY,
        "total_records_day",
        "n_products_day",
        pattern_text(F.col("_listed"), study).alias("product_pattern"),
        *_named(same_day_flags(F.col("total_records_day"), F.col("n_products_day") > 1)),
    )


def flag_events(events: DataFrame, study: Study, *extra: str) -> DataFrame:
    """Every dated record with its campaign, product label, per-day counts and all flags.

    ``extra`` names further columns to keep, such as ``age``. They become part of what
    makes two records copies of each other, so they must not tell every record apart.
    """
    days = flag_days(by_patient(day_products(events, study, *extra)), study)
    day = W.partitionBy(*DAY)
    counted = F.collect_list(F.struct("product_rank", "n_records")).over(day)
    per_product = F.aggregate(
        F.array_sort(counted),
        F.array().cast("array<struct<product_rank:int,n_records:bigint>>"),
        _merged_entry,
    )
    listed = days.withColumn("_listed", per_product).withColumn("n_products_day", F.size("_listed").cast("long"))
    labelled = listed.select(
        *DAY,
        *extra,
        product_label(study).alias("vax_product"),
        campaign_label(study).alias("campaign"),
        approval_date(study).alias("approval_date"),
        "total_records_day",
        "n_products_day",
        pattern_text(F.col("_listed"), study).alias("product_pattern"),
        *FLAGS,
        "n_records",
    )
    return unroll_rows(labelled)


def long_flags(flagged: DataFrame, study: Study) -> DataFrame:
    """One row per record and raised flag, from flagged patient-days.

    Explodes only the raised flags instead of unpivoting seven columns and filtering after.
    """
    raised = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(flag)) for flag in FLAGS]))
    weighted = flagged.where(" OR ".join(FLAGS)).select(
        *DAY,
        campaign_label(study).alias("campaign"),
        product_label(study).alias("vax_product"),
        F.explode(raised).alias("flag_type"),
        "n_records",
    )
    return unroll_rows(weighted)


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]
