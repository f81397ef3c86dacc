"""Schemas of every table read or written; nothing is inferred."""

from __future__ import annotations

# health-record tables read by the extraction jobs
PATIENTS = "patient_id BIGINT, date_of_birth DATE"
VACCINATIONS = "patient_id BIGINT, date DATE, target_disease STRING, product_name STRING"
CLINICAL_EVENTS = "patient_id BIGINT, date DATE, snomedct_code STRING"
MEDICATIONS = "patient_id BIGINT, date DATE, dmd_code STRING"
PRACTICE_REGISTRATIONS = "patient_id BIGINT, start_date DATE, end_date DATE"
DEATHS = "patient_id BIGINT, date DATE"

# extracts, read by the reports
COVID_EVENTS = "patient_id BIGINT, vax_date DATE, vax_product STRING, age INT, death_date DATE"
COVID_REGISTRATIONS = "patient_id BIGINT, registration_start_date DATE, deregistration_date DATE"
FLU_TABLE = "patient_id BIGINT, vax_date DATE, vax_product STRING, age INT"
FLU_CODED = "patient_id BIGINT, vax_date DATE, age INT"

# released counts and codelists
SOURCE_COUNTS = "campaign STRING, `table` BOOLEAN, drug BOOLEAN, snomed BOOLEAN, n BIGINT"
STUDY_DATES = "firstpossiblevax_date DATE, start_date DATE, end_date DATE"
