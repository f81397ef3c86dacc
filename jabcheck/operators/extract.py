"""From health-record tables to the event tables that the reports read.

Events are folded before they meet a table by patient and unrolled after, so no join here
has a hot key, with or without adaptive execution.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jabcheck.functions.dates import age_on
from jabcheck.operators.counts import fold_rows, unroll_rows


def with_disease(vaccinations: DataFrame, disease: str) -> DataFrame:
    return vaccinations.where(F.col("target_disease").isin(disease))


def with_code(events: DataFrame, code_column: str, codes: DataFrame) -> DataFrame:
    """Events whose code is in a codelist (one column, ``code``).

    No broadcast hint: Spark broadcasts a list it knows to be small, and otherwise
    shuffles both sides, where adaptive execution splits a code that is too frequent.
    """
    listed = codes.select(F.col("code").alias(code_column))
    return events.join(listed, code_column, "left_semi")


def patients_with_any(*frames: DataFrame) -> DataFrame:
    """Ids of patients with at least one row in any of the frames."""
    ids = frames[0].select("patient_id")
    for frame in frames[1:]:
        ids = ids.unionByName(frame.select("patient_id"))
    return ids.distinct()


def population(
    frames: list[DataFrame], patients: DataFrame, *, min_age: int | None = None, on: date | None = None
) -> DataFrame:
    """Ids of patients with an event in any frame and, if asked, of at least ``min_age`` on a day."""
    exists = patients_with_any(*frames)
    if min_age is None:
        return exists
    old_enough = _one_each(patients, "date_of_birth").where(age_on(F.col("date_of_birth"), F.lit(on)) >= min_age)
    return exists.join(old_enough.select("patient_id"), "patient_id", "left_semi")


def _one_each(table: DataFrame, day: str) -> DataFrame:
    """One row per patient, with the earliest ``day``, so that no join multiplies events."""
    return table.groupBy("patient_id").agg(F.min(day).alias(day))


def with_person(folded: DataFrame, patients: DataFrame) -> DataFrame:
    """Folded events beside their patient's date of birth, NULL where not recorded."""
    return folded.join(_one_each(patients, "date_of_birth"), "patient_id", "left")


def with_death(folded: DataFrame, deaths: DataFrame) -> DataFrame:
    """Folded rows beside their patient's date of death, NULL where none is recorded."""
    return folded.join(_one_each(deaths, "date").withColumnRenamed("date", "death_date"), "patient_id", "left")


def covid_events(vaccinations: DataFrame, patients: DataFrame, deaths: DataFrame) -> DataFrame:
    """One row per vaccination: date, product, age on the day and date of death."""
    folded = fold_rows(vaccinations, "patient_id", "date", "product_name")
    return unroll_rows(
        with_death(with_person(folded, patients), deaths).select(
            "patient_id",
            F.col("date").alias("vax_date"),
            F.col("product_name").alias("vax_product"),
            age_on(F.col("date_of_birth"), F.col("date")).alias("age"),
            "death_date",
            "n_records",
        )
    )


def covid_registrations(registrations: DataFrame, members: DataFrame) -> DataFrame:
    """Registration periods of the patients in the population."""
    folded = fold_rows(registrations, "patient_id", "start_date", "end_date")
    return unroll_rows(
        folded.join(members, "patient_id", "left_semi").select(
            "patient_id",
            F.col("start_date").alias("registration_start_date"),
            F.col("end_date").alias("deregistration_date"),
            "n_records",
        )
    )


def flu_events(events: DataFrame, patients: DataFrame, *, min_age: int, on: date) -> DataFrame:
    """One row per influenza event of a patient in the population, with the age on the day.

    A patient with a row here has an event in one of the three sources by definition, so
    membership comes down to the age rule, checked on the joined date of birth.
    """
    eligible = _one_each(patients, "date_of_birth").where(age_on(F.col("date_of_birth"), F.lit(on)) >= min_age)
    names = {"date": "vax_date"}
    if "product_name" in events.columns:
        names["product_name"] = "vax_product"
    folded = fold_rows(events, "patient_id", *names)
    return unroll_rows(
        folded.join(eligible.select("patient_id", "date_of_birth"), "patient_id").select(
            "patient_id",
            *[F.col(old).alias(new) for old, new in names.items()],
            age_on(F.col("date_of_birth"), F.col("date")).alias("age"),
            "n_records",
        )
    )
