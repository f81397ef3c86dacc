"""COVID-19 jobs: extraction and the report on its event table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jabcheck.operators import extract, flags, intervals, summaries
from jabcheck.operators.clean import require_mapped, watched
from jabcheck.operators.perturb import perturb, with_row_key
from jabcheck.operators.registration import add_active
from jabcheck.operators.staging import Staging, staging
from jabcheck.sources import schemas
from jabcheck.sources.extracts import PARQUET, read_extract, write_extract
from jabcheck.sources.layout import write_clustered
from jabcheck.sources.publish import publish
from jabcheck.sources.readers import read_table
from jabcheck.sources.writers import write_csv
from jabcheck.study import COVID_DISEASE, Study


def extract_covid(
    spark: SparkSession, records: str, out: str, *, clustered: bool = False, file_format: str = PARQUET
) -> None:
    """Read health-record tables under ``records``; write the event and registration tables.

    With ``clustered`` events are laid out by month and patient, as Parquet.
    """
    patients = read_table(spark, f"{records}/patients", schemas.PATIENTS)
    deaths = read_table(spark, f"{records}/ons_deaths", schemas.DEATHS)
    periods = read_table(spark, f"{records}/practice_registrations", schemas.PRACTICE_REGISTRATIONS)
    vaccinations = extract.with_disease(
        read_table(spark, f"{records}/vaccinations", schemas.VACCINATIONS), COVID_DISEASE
    )
    members = extract.population([vaccinations], patients)
    if clustered and file_format != PARQUET:
        raise ValueError("the clustered layout is for Parquet")
    events = extract.covid_events(vaccinations, patients, deaths)
    if clustered:
        write_clustered(events, f"{out}/vaccinations")
    else:
        write_extract(events, out, "vaccinations", file_format)
    write_extract(extract.covid_registrations(periods, members), out, "registrations", file_format)


def report_tables(flagged: DataFrame, study: Study, stage: Staging) -> dict[str, DataFrame]:
    """The six tables by file name, from flagged patient-days that carry ``active``.

    Gaps between doses are found in one pass and stored, folded, for three of the tables.
    """
    single = intervals.after_first_campaign(flagged.where(F.col("total_records_day") == 1), study)
    gaps = stage.by_patient(intervals.fold_gaps(intervals.dose_gaps(single)))
    return {
        "count_overall_noninterval_flags": summaries.overall_flags(flagged),
        "count_campaign_noninterval_flags": summaries.campaign_flags(flagged, study),
        "count_product_noninterval_flags": summaries.product_flags(flagged, study),
        "count_interval_context": summaries.interval_contexts(gaps, study),
        "count_interval_campaign_transition": summaries.campaign_transitions(gaps, study),
        "count_interval_product_transition": summaries.product_transitions(gaps, study),
    }


def flagged_with_active(events: DataFrame, registrations: DataFrame, study: Study) -> DataFrame:
    days = flags.day_products(events, study, "death_date")
    return flags.flag_days(add_active(days, registrations), study)


def report_covid(
    spark: SparkSession,
    extracts: str,
    out: str,
    study: Study,
    *,
    staging_folder: str | None = None,
    buckets: int | None = None,
    inject_faults: bool = False,
    seed: int = 0,
    as_set: bool = False,
    file_format: str = PARQUET,
) -> None:
    """Write every summary table, each as counted and disclosure-rounded.

    With ``as_set`` they are published as one set of single files: ``out``, which then holds
    nothing else, keeps the old set until the last table is there.

    Events are folded to flagged patient-days once and stored by patient; the six tables
    then read that without a shuffle by patient. The same job observes whether all products
    are known; only if not, the events are read again, to list the names. Intermediate tables live in a fresh folder
    below ``staging_folder`` that is deleted at the end.
    """
    events = read_extract(spark, extracts, "vaccinations", schemas.COVID_EVENTS, file_format)
    registrations = read_extract(spark, extracts, "registrations", schemas.COVID_REGISTRATIONS, file_format)
    with staging(spark, staging_folder, buckets) as stage:
        if inject_faults:
            events = perturb(stage.store(with_row_key(events)), study, stage, seed)
        days, seen = watched(flagged_with_active(events, registrations, study), study)
        flagged = stage.by_patient(days)
        if seen.get["n_unmapped"]:
            require_mapped(events, study, f"{out}.unmapped_products.csv" if as_set else f"{out}/unmapped_products.csv")
        tables = _with_rounded(report_tables(flagged, study, stage), study)
        if as_set:
            publish(spark, tables, out)
        else:
            for name, table in tables:
                write_csv(table, f"{out}/{name}.csv")


def _with_rounded(tables: dict[str, DataFrame], study: Study) -> Iterator[tuple[str, DataFrame]]:
    """Each table as counted and rounded; it is held while both are written."""
    for name, table in tables.items():
        table.cache()
        yield f"{name}_unrounded", table
        yield name, summaries.rounded(table, study.threshold)
        table.unpersist()
