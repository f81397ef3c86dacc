"""Influenza jobs: extraction, comparison of sources and set-intersection counts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from jabcheck.operators import crosssource, extract, upset
from jabcheck.sources import schemas
from jabcheck.sources.extracts import PARQUET, read_extract, write_extract
from jabcheck.sources.readers import codes_frame, read_codelist, read_source_counts, read_table
from jabcheck.sources.writers import write_csv
from jabcheck.study import FLU_DISEASE, FLU_DMD_CODES, FLU_MIN_AGE, FLU_SNOMED_CODES, Study


def extract_flu(
    spark: SparkSession,
    records: str,
    out: str,
    study: Study,
    *,
    snomed_codelist: str | None = None,
    drug_codelist: str | None = None,
    code_column: str = "code",
    file_format: str = PARQUET,
) -> None:
    """Write one event table per source: vaccinations, coded events and medications.

    Without a codelist file the published codes are used.
    """
    patients = read_table(spark, f"{records}/patients", schemas.PATIENTS)
    snomed = read_codelist(spark, snomed_codelist, code_column) if snomed_codelist else codes_frame(spark, FLU_SNOMED_CODES)
    drugs = read_codelist(spark, drug_codelist, code_column) if drug_codelist else codes_frame(spark, FLU_DMD_CODES)
    sources = {
        "flu_vaccinations_table": extract.with_disease(
            read_table(spark, f"{records}/vaccinations", schemas.VACCINATIONS), FLU_DISEASE
        ),
        "flu_vaccinations_SNOMED": extract.with_code(
            read_table(spark, f"{records}/clinical_events", schemas.CLINICAL_EVENTS), "snomedct_code", snomed
        ),
        "flu_vaccinations_drug": extract.with_code(
            read_table(spark, f"{records}/medications", schemas.MEDICATIONS), "dmd_code", drugs
        ),
    }
    for name, events in sources.items():
        chosen = extract.flu_events(events, patients, min_age=FLU_MIN_AGE, on=study.end)
        write_extract(chosen, out, name, file_format)


def report_flu(
    spark: SparkSession, extracts: str, out: str, study: Study, *, file_format: str = PARQUET
) -> None:
    """Write the source combinations, the set-intersection counts and the date agreement.

    All three come from one small table of counts, computed once.
    """
    records = crosssource.union_sources(
        table=read_extract(spark, extracts, "flu_vaccinations_table", schemas.FLU_TABLE, file_format),
        drug=read_extract(spark, extracts, "flu_vaccinations_drug", schemas.FLU_CODED, file_format),
        snomed=read_extract(spark, extracts, "flu_vaccinations_SNOMED", schemas.FLU_CODED, file_format),
    )
    people = crosssource.agreement_counts(crosssource.date_agreement(records, study)).cache()
    counts = crosssource.round_counts(people, study)
    write_csv(crosssource.source_table(counts, study), f"{out}/table_flu_sources.csv")
    write_csv(crosssource.upset_table(counts, study), f"{out}/upset_counts_campaign.csv")
    write_csv(crosssource.agreement_table(people, study), f"{out}/table_date_agreement.csv")
    people.unpersist()


def upset_data(spark: SparkSession, counts: str, out: str) -> None:
    """From the released counts, the numbers of one set-intersection chart per campaign."""
    released = read_source_counts(spark, counts)
    write_csv(upset.intersections(released).orderBy("campaign", "rank"), f"{out}/upset_intersections.csv")
    write_csv(upset.set_sizes(released).orderBy("campaign", "source"), f"{out}/upset_set_sizes.csv")
