"""Distinct patients by bitmaps: one stored table from which every level of flag tables rolls up.

Patients are numbered densely, and a bitmap holds which of 32,768 consecutive numbers have a
flag in a campaign and product. Bitmaps of finer groups combine by OR into those of coarser
ones, so campaigns, products, flags and totals all count from the same table, exactly, and
tables of different extracts of the same patients combine as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jabcheck.operators.clean import campaign_label, product_label
from jabcheck.operators.flags import FLAGS
from jabcheck.operators.staging import Staging
from jabcheck.operators.summaries import TOTAL_DENOMINATORS, ordered, whole_table
from jabcheck.study import Study

#: The measure beside the flags: records and patients inside an active registration.
ACTIVE = "active"
LEVEL = ["campaign_rank", "product_rank", "measure"]


def numbered_patients(rows: DataFrame, stage: Staging) -> DataFrame:
    """``patient_id`` and a number from 1 on without gaps, NULL first; numbers rise with ids.

    Ranges of ids are sorted and counted by themselves, then each range gets the sum of those
    before it, for which one row a range is enough.
    """
    ids = rows.select("patient_id").distinct().repartitionByRange("patient_id").sortWithinPartitions("patient_id")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ids = stage.store(ids.select("patient_id", F.spark_partition_id().alias("_range"), place.alias("_place")))
    sums = ids.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_range")) - F.col("_n")  # one row a range
    numbered = ids.join(sums.select("_range", before.alias("_before")), "_range")
    return numbered.select("patient_id", (F.col("_before") + F.col("_place") + 1).alias("number"))


def flag_bitmaps(flagged: DataFrame, stage: Staging) -> DataFrame:
    """``campaign_rank, product_rank, measure, bucket, n_records, patients`` from flagged patient-days.

    ``measure`` is a flag, or ``active`` where ``flagged`` has that column. Records are added
    up by patient first, so a busy patient is one row a group before it meets its number.
    """
    measures = [*FLAGS, ACTIVE] if ACTIVE in flagged.columns else list(FLAGS)
    sums = [F.sum(F.when(F.col(m), F.col("n_records")).otherwise(0)).alias(m) for m in measures]
    per_patient = flagged.groupBy("patient_id", "campaign_rank", "product_rank").agg(*sums)
    numbers = stage.store(numbered_patients(flagged, stage))
    entries = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in measures])
    raised = F.filter(entries, lambda e: e["n"] > 0)
    same = per_patient["patient_id"].eqNullSafe(numbers["patient_id"])
    rows = per_patient.join(numbers, same).select("number", "campaign_rank", "product_rank", F.explode(raised).alias("e"))
    return rows.groupBy(
        "campaign_rank", "product_rank", F.col("e.measure").alias("measure"), F.bitmap_bucket_number("number").alias("bucket")
    ).agg(F.sum("e.n").alias("n_records"), F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("patients"))


def rolled_up(bitmaps: DataFrame, *keys: Column | str) -> DataFrame:
    """Records and exact distinct patients by ``keys``, any columns of the stored table."""
    names = [f"_k{i}" for i in range(len(keys))]
    columns = [(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names)]
    by_bucket = bitmaps.groupBy(*columns, "bucket").agg(
        F.sum("n_records").alias("n_records"), F.bitmap_count(F.bitmap_or_agg("patients")).alias("n_patients")
    )
    sums = by_bucket.groupBy(*names).agg(F.sum("n_records").alias("n_records"), F.sum("n_patients").alias("n_patients"))
    return sums.withColumnsRenamed({n: k for n, k in zip(names, keys) if isinstance(k, str)})


def _flags_only(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.where(F.col("measure") != ACTIVE)


def _flag_table(bitmaps: DataFrame, *keys: str) -> DataFrame:
    flags = _flags_only(bitmaps)
    table = rolled_up(flags, *keys, "measure").withColumnRenamed("measure", "flag_type")
    table = table.unionByName(rolled_up(flags), allowMissingColumns=True)  # one more row, without a flag
    total = F.col("flag_type").isNull()
    table = table.withColumns(
        {
            "denom_patients_total": F.max(F.when(total, F.col("n_patients"))).over(whole_table()),
            "denom_records_total": F.max(F.when(total, F.col("n_records"))).over(whole_table()),
        }
    )
    return table.where(~total)


def overall_flags(bitmaps: DataFrame) -> DataFrame:
    """Table 1, as :func:`jabcheck.operators.summaries.overall_flags` counts it."""
    return ordered(_flag_table(bitmaps), F.col("flag_type")).select("flag_type", "n_records", "n_patients", *TOTAL_DENOMINATORS)


def product_flags(bitmaps: DataFrame, study: Study) -> DataFrame:
    """Table 3, from the same stored table."""
    table = ordered(_flag_table(bitmaps, "product_rank"), F.col("product_rank"), F.col("flag_type"))
    return table.select(product_label(study).alias("vax_product"), "flag_type", "n_records", "n_patients", *TOTAL_DENOMINATORS)


def campaign_flags(bitmaps: DataFrame, study: Study) -> DataFrame:
    """Table 2, from the same stored table; it needs the measure ``active``."""
    table = rolled_up(bitmaps, "campaign_rank", "measure")
    denominators = {"n_patients": "denom_patients_group", "n_records": "denom_records_group"}
    here = W.partitionBy("campaign_rank")  # a row for each flag of a campaign
    of_active = {new: F.max(F.when(F.col("measure") == ACTIVE, F.col(old))).over(here) for old, new in denominators.items()}
    table = _flags_only(table.withColumns(of_active)).withColumnRenamed("measure", "flag_type")
    return ordered(table, F.col("campaign_rank").asc_nulls_last(), F.col("flag_type")).select(
        campaign_label(study).alias("campaign"), "flag_type", "n_records", "n_patients", *denominators.values()
    )
