"""Was a patient registered and alive on the day of an event?"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jabcheck.operators.clean import dated
from jabcheck.operators.flags import by_patient
from jabcheck.operators.counts import fold_rows, unroll_rows

OPEN_END = date(9999, 12, 31)


def registration_spans(registrations: DataFrame) -> DataFrame:
    """The latest end per patient and start; an open period never ends.

    Of several periods with one start only the longest can matter, so repeated periods
    fold into one row per start before they are shuffled.
    """
    return (
        registrations.where(F.col("registration_start_date").isNotNull())
        .groupBy("patient_id", F.col("registration_start_date").alias("vax_date"))
        .agg(F.max(F.coalesce("deregistration_date", F.lit(OPEN_END))).alias("registered_until"))
    )


def add_active(days: DataFrame, registrations: DataFrame) -> DataFrame:
    """Patient-days with ``active``: inside any registration period and not dead.

    Days and period starts are merged into one timeline per patient. Some period covers a
    day exactly when the latest end among the periods that have started reaches it, and
    that is a running maximum: linear in the rows of a patient, where matching every day
    with every period would be quadratic. The result is partitioned by patient.
    """
    timeline = W.partitionBy("patient_id").orderBy("vax_date", "_is_day").rowsBetween(W.unboundedPreceding, 0)
    merged = days.withColumn("_is_day", F.lit(1)).unionByName(
        registration_spans(registrations).withColumn("_is_day", F.lit(0)), allowMissingColumns=True
    )
    covered = F.coalesce(F.col("_until") >= F.col("vax_date"), F.lit(False))
    alive = F.col("death_date").isNull() | (F.col("death_date") >= F.col("vax_date"))
    return (
        by_patient(merged)
        .withColumn("_until", F.max("registered_until").over(timeline))
        .where(F.col("_is_day") == 1)
        .withColumn("active", covered & alive)
        .drop("_is_day", "_until", "registered_until")
    )


def events_with_active(events: DataFrame, registrations: DataFrame) -> DataFrame:
    """Every dated record with ``active_on_vax_date``; equal records are decided once."""
    folded = fold_rows(dated(events), "patient_id", "vax_date", "vax_product", "death_date")
    return unroll_active(add_active(folded, registrations))


def unroll_active(decided: DataFrame) -> DataFrame:
    return unroll_rows(decided.withColumnRenamed("active", "active_on_vax_date"))


def active_events(events: DataFrame, registrations: DataFrame) -> DataFrame:
    return events_with_active(events, registrations).where("active_on_vax_date").drop("active_on_vax_date")
