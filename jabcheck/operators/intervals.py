"""Days between a patient's consecutive doses, and how the two doses relate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jabcheck.functions.dates import by_rank
from jabcheck.functions.labels import (
    ARROW,
    INTERVAL_BINS,
    campaign_stage,
    interval_bin_rank,
    interval_context,
)
from jabcheck.operators.clean import campaign_label, product_label, rank_of_campaign, ranked
from jabcheck.operators.flags import DAY, by_patient
from jabcheck.study import Study


def interval_bin(rank: str = "interval_bin_rank"):
    return by_rank(F.col(rank), [label for label, _, _ in INTERVAL_BINS], "string")


def single_record_days(events: DataFrame, study: Study) -> DataFrame:
    """Patient-days with exactly one record, in any campaign but the first, by patient.

    Counting needs one combined shuffle; what is moved by patient afterwards is only the
    days that take part in an interval.
    """
    days = (
        ranked(events, study)
        .groupBy(*DAY)
        .agg(F.count(F.lit(1)).alias("n_records"), F.min("product_rank").alias("product_rank"))
    )
    return by_patient(after_first_campaign(days.where(F.col("n_records") == 1), study))


def after_first_campaign(days: DataFrame, study: Study) -> DataFrame:
    """Days of every campaign but the first; a plain date bound, so it reaches the scan."""
    later = days.where(F.col("vax_date") >= F.lit(study.campaign_starts[1]))
    return later.withColumn("campaign_rank", rank_of_campaign(study))


def dose_gaps(days: DataFrame) -> DataFrame:
    """Each day beside the patient's previous one; first days are left out.

    ``days`` must hold one row per patient and day, after every exclusion: the previous
    dose is the previous row that was kept.
    """
    order = W.partitionBy("patient_id").orderBy("vax_date")
    previous = {
        "prev_date": F.lag("vax_date").over(order),
        "prev_product_rank": F.lag("product_rank").over(order),
        "prev_campaign_rank": F.lag("campaign_rank").over(order),
    }
    gaps = days.withColumns(previous).where(F.col("prev_date").isNotNull())
    days_between = F.datediff("vax_date", "prev_date")
    return gaps.withColumn("interval_days", days_between).withColumn(
        "interval_bin_rank", interval_bin_rank("interval_days")
    )


def stage_of(study: Study, rank: str = "campaign_rank"):
    """The stage of a campaign, looked up by rank; labels are matched once, when planning."""
    return by_rank(F.col(rank), [campaign_stage(label) for label in study.campaign_labels], "string")


def context_of(study: Study):
    same = F.col("prev_campaign_rank") == F.col("campaign_rank")
    return interval_context(stage_of(study, "prev_campaign_rank"), stage_of(study), same)


def fold_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps of a patient that no table tells apart, counted as ``n``."""
    return gaps.groupBy(
        "patient_id", "prev_campaign_rank", "campaign_rank", "prev_product_rank", "product_rank", "interval_bin_rank"
    ).agg(F.count(F.lit(1)).alias("n"))


def describe_gaps(gaps: DataFrame, study: Study) -> DataFrame:
    """The interval table with labels in place of ranks."""
    before, now = campaign_label(study, "prev_campaign_rank"), campaign_label(study)
    product_before, product_now = product_label(study, "prev_product_rank"), product_label(study)
    return gaps.select(
        "patient_id",
        "prev_date",
        "vax_date",
        product_before.alias("prev_product"),
        product_now.alias("vax_product"),
        before.alias("prev_campaign"),
        now.alias("campaign"),
        stage_of(study, "prev_campaign_rank").alias("prev_campaign_stage"),
        stage_of(study).alias("campaign_stage"),
        "interval_days",
        interval_bin().alias("interval_bin"),
        context_of(study).alias("interval_context"),
        F.concat(before, F.lit(ARROW), now).alias("campaign_transition_type"),
        F.concat(product_before, F.lit(ARROW), product_now).alias("product_transition_type"),
    )


def dose_intervals(events: DataFrame, study: Study) -> DataFrame:
    return describe_gaps(dose_gaps(single_record_days(events, study)), study)
