"""Summary tables of flags and dose intervals.

Every distinct-patient count is taken the same way: fold to one row per patient and group
while the data is partitioned by patient, mark a patient's first row where a wider level
needs it, and add up. So one small shuffle of per-group sums follows, and no
``count(distinct)`` has to move patients again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from jabcheck.functions.dates import by_rank
from jabcheck.functions.labels import ARROW
from jabcheck.functions.rounding import round_midpoint
from jabcheck.operators.clean import campaign_label, product_label
from jabcheck.operators.flags import FLAGS
from jabcheck.operators.intervals import context_of, interval_bin
from jabcheck.study import Study

# Names of count columns, and what is added to them after rounding.
ROUNDED_SUFFIX = "_midpoint6"
GROUP_DENOMINATORS = ["denom_records_group", "denom_patients_group"]
TOTAL_DENOMINATORS = ["denom_records_total", "denom_patients_total"]
COUNTS = ["n_records", "n_patients", *GROUP_DENOMINATORS, *TOTAL_DENOMINATORS]


def whole_table() -> WindowSpec:
    """For totals over sums that are already grouped: a few thousand rows at most."""
    return W.partitionBy()


def ordered(table: DataFrame, *order: Column | str) -> DataFrame:
    """Total order of a small result table, without sampling it for a range shuffle."""
    return table.coalesce(1).sortWithinPartitions(*order)


def rounded(table: DataFrame, threshold: int) -> DataFrame:
    """The disclosure-rounded twin of a summary table; count columns get a suffix."""
    counts = [c for c in table.columns if c in COUNTS]
    return table.withColumns({c: round_midpoint(F.col(c), threshold) for c in counts}).withColumnsRenamed(
        {c: c + ROUNDED_SUFFIX for c in counts}
    )


# The flag columns are summed by SQL text: seven flags at a time in one expression each.


def _flag_counts_per_patient(flagged: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    raised = [F.expr(f"sum(if({flag}, n_records, 0))").alias(flag) for flag in FLAGS]
    return flagged.groupBy("patient_id", *keys).agg(*raised, *extra)


def _sum_over_patients() -> list[Column]:
    records = [F.expr(f"sum({flag}) AS {flag}_records") for flag in FLAGS]
    return records + [F.expr(f"count_if({flag} > 0) AS {flag}_patients") for flag in FLAGS]


def _one_row_per_flag(sums: DataFrame, *keep: str) -> DataFrame:
    entries = ", ".join(f"'{flag}', {flag}_records, {flag}_patients" for flag in FLAGS)
    stacked = f"stack({len(FLAGS)}, {entries}) AS (flag_type, n_records, n_patients)"
    return sums.selectExpr(*keep, stacked).where("n_records > 0")


def _flag_table(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Flag counts per key with totals over all raised flags."""
    per_patient = _flag_counts_per_patient(flagged, keys).where(" OR ".join(f"{f} > 0" for f in FLAGS))
    if keys:
        first = F.row_number().over(W.partitionBy("patient_id").orderBy(*keys)) == 1
    else:
        first = F.lit(True)
    sums = (
        per_patient.withColumn("_first", first)
        .groupBy(*keys)
        .agg(*_sum_over_patients(), F.count_if("_first").alias("_patients"))
    )
    return (
        _one_row_per_flag(
            sums.withColumn("denom_patients_total", F.sum("_patients").over(whole_table())),
            *keys,
            "denom_patients_total",
        )
        .withColumn("denom_records_total", F.sum("n_records").over(whole_table()))
    )


def overall_flags(flagged: DataFrame) -> DataFrame:
    """Table 1: per flag. Totals count raised flags, so a record with three counts three times."""
    table = _flag_table(flagged, [])
    return ordered(table, F.col("flag_type")).select("flag_type", "n_records", "n_patients", *TOTAL_DENOMINATORS)


def product_flags(flagged: DataFrame, study: Study) -> DataFrame:
    """Table 3: per product and flag, products in level order."""
    table = _flag_table(flagged, ["product_rank"])
    return ordered(table, F.col("product_rank"), F.col("flag_type")).select(
        product_label(study).alias("vax_product"), "flag_type", "n_records", "n_patients", *TOTAL_DENOMINATORS
    )


def campaign_flags(flagged: DataFrame, study: Study) -> DataFrame:
    """Table 2: per campaign and flag, with the campaign's active records and patients.

    ``flagged`` carries ``active``. Counts of flagged records are not limited to active
    ones, the denominators are. Both come out of one pass, so nothing is joined and a
    campaign that is NULL groups like any other. Without any active record the
    denominators are NULL.
    """
    active = F.sum(F.when(F.col("active"), F.col("n_records")).otherwise(0)).alias("_active")
    sums = (
        _flag_counts_per_patient(flagged, ["campaign_rank"], active)
        .groupBy("campaign_rank")
        .agg(
            *_sum_over_patients(),
            F.nullif(F.count_if(F.col("_active") > 0), F.lit(0)).alias("denom_patients_group"),
            F.nullif(F.sum("_active"), F.lit(0)).alias("denom_records_group"),
        )
    )
    denominators = ["denom_patients_group", "denom_records_group"]
    table = _one_row_per_flag(sums, "campaign_rank", *denominators)
    return ordered(table, F.col("campaign_rank").asc_nulls_last(), F.col("flag_type")).select(
        campaign_label(study).alias("campaign"), "flag_type", "n_records", "n_patients", *denominators
    )


def _interval_table(gaps: DataFrame, keys: list[str], name: str, label: Column) -> DataFrame:
    """Counts per group and interval bin, beside those of the group and of the whole table.

    ``gaps`` are counted: each stands for ``n`` intervals.
    """
    by_group = W.partitionBy("patient_id", *keys).orderBy("interval_bin_rank")
    by_person = W.partitionBy("patient_id").orderBy(*keys, "interval_bin_rank")
    marked = (
        gaps.groupBy("patient_id", *keys, "interval_bin_rank")
        .agg(F.sum("n").alias("n"))
        .withColumn("_first_in_group", F.row_number().over(by_group) == 1)
        .withColumn("_first", F.row_number().over(by_person) == 1)
    )
    sums = marked.groupBy(*keys, "interval_bin_rank").agg(
        F.sum("n").alias("n_records"),
        F.count(F.lit(1)).alias("n_patients"),
        F.count_if("_first_in_group").alias("_group"),
        F.count_if("_first").alias("_total"),
    )
    group = W.partitionBy(*keys)
    table = sums.withColumns(
        {
            name: label,
            "interval_bin": interval_bin(),
            "denom_records_group": F.sum("n_records").over(group),
            "denom_patients_group": F.sum("_group").over(group),
            "denom_records_total": F.sum("n_records").over(whole_table()),
            "denom_patients_total": F.sum("_total").over(whole_table()),
        }
    )
    return ordered(table, F.col(name).asc_nulls_last(), F.col("interval_bin_rank").asc_nulls_last()).select(
        name, "interval_bin", *COUNTS
    )


def interval_contexts(gaps: DataFrame, study: Study) -> DataFrame:
    """Table 4: interval context by interval bin, from counted gaps as the next two."""
    with_context = gaps.withColumn("interval_context", context_of(study))
    return _interval_table(with_context, ["interval_context"], "interval_context", F.col("interval_context"))


def campaign_transitions(gaps: DataFrame, study: Study) -> DataFrame:
    """Table 5: campaign of the previous dose -> campaign of this one, by interval bin."""
    label = F.concat(campaign_label(study, "prev_campaign_rank"), F.lit(ARROW), campaign_label(study))
    return _interval_table(gaps, ["prev_campaign_rank", "campaign_rank"], "campaign_transition_type", label)


def product_transitions(gaps: DataFrame, study: Study) -> DataFrame:
    """Table 6: product of the previous dose -> product of this one, by interval bin."""
    label = F.concat(
        by_rank(F.col("prev_product_rank"), study.product_labels, "string"), F.lit(ARROW), product_label(study)
    )
    return _interval_table(gaps, ["prev_product_rank", "product_rank"], "product_transition_type", label)
