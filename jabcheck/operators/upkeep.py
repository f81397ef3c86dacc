"""Summary tables kept up to date: a delta of events changes the state of its patients only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jabcheck.operators.flags import DAY, by_patient, day_products, flag_days
from jabcheck.operators.intervals import after_first_campaign, dose_gaps, fold_gaps
from jabcheck.operators.registration import add_active
from jabcheck.operators.staging import Staging
from jabcheck.study import Study

#: What a record is counted by within a patient.
RECORD = [*DAY, "product_rank", "death_date"]


@dataclass(frozen=True)
class State:
    """Flagged patient-days and folded dose gaps, both stored by patient."""

    days: DataFrame
    gaps: DataFrame


def _flagged(counted: DataFrame, registrations: DataFrame, study: Study) -> DataFrame:
    return flag_days(add_active(counted, registrations), study)


def _gaps(flagged: DataFrame, study: Study) -> DataFrame:
    return fold_gaps(dose_gaps(after_first_campaign(flagged.where(F.col("total_records_day") == 1), study)))


def first_state(events: DataFrame, registrations: DataFrame, study: Study, stage: Staging) -> State:
    """The state after a first extract of events, which carry ``death_date``."""
    days = stage.by_patient(_flagged(day_products(events, study, "death_date"), registrations, study))
    return State(days, stage.by_patient(_gaps(days, study)))


def with_delta(state: State, events: DataFrame, registrations: DataFrame, study: Study, stage: Staging) -> State:
    """The state with further events of any date, as if all had come in one extract.

    Only patients in ``events`` are worked out again: their counted days are taken from the
    state, added to those of the delta, flagged and paired up anew. Everyone else's rows are
    handed on as stored, each read once and not windowed; all rows are dealt by patient before
    they are stored, as a write by buckets sorts what a task has read, up to a whole file. The
    registrations of touched patients are read; changes to those of other patients need a
    first state. A NULL patient is worked out again with every delta.
    """
    fresh = day_products(events, study, "death_date")
    touched = stage.store(fresh.select("patient_id").where(F.col("patient_id").isNotNull()).distinct())
    known = F.col("patient_id").isNotNull()

    def theirs(rows: DataFrame) -> DataFrame:
        return rows.join(touched, "patient_id", "left_semi").unionByName(rows.where(~known))

    def others(rows: DataFrame) -> DataFrame:
        return rows.where(known).join(touched, "patient_id", "left_anti")

    counted = theirs(state.days).select(*RECORD, "n_records").unionByName(fresh.select(*RECORD, "n_records"))
    counted = counted.groupBy(*RECORD).agg(F.sum("n_records").alias("n_records"))
    again = stage.by_patient(_flagged(counted, theirs(registrations), study))
    days = others(state.days).unionByName(again.select(*state.days.columns))
    gaps = others(state.gaps).unionByName(_gaps(again, study).select(*state.gaps.columns))
    return State(stage.by_patient(by_patient(days)), stage.by_patient(by_patient(gaps)))
