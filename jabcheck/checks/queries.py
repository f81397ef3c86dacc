"""Registered queries: name -> function of (spark, directory of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jabcheck.checks import standin
from jabcheck.functions.dates import age_on
from jabcheck.functions.labels import SOURCES
from jabcheck.functions.rounding import round_midpoint
from jabcheck.functions.sqlfunctions import register_functions
from jabcheck.operators import (
    clean,
    crosssource,
    distincts,
    extract,
    flags,
    intervals,
    perturb,
    registration,
    sourcesets,
    summaries,
    upkeep,
    upset,
)
from jabcheck.operators.counts import fold_rows, unroll_rows
from jabcheck.operators.staging import session_staging
from jabcheck.plans import design
from jabcheck.plans.covid import flagged_with_active, report_tables
from jabcheck.sources.arrowfiles import read_arrow, write_arrow
from jabcheck.sources.layout import campaign_days, read_campaign, write_clustered
from jabcheck.sources.readers import read_codelist, read_source_counts
from jabcheck.sources.writers import write_csv
from jabcheck.study import Study

Query = Callable[[SparkSession, str], DataFrame]
COVID, FLU = standin.covid_study(), standin.flu_study()
KEY = ["l_orderkey", "l_linenumber"]
#: Four record sources, and the days within which two of them agree.
FOUR_SOURCES, AGREE_WITHIN = ("table", "drug", "pharmacy", "snomed"), (0, 7)
#: The campaign that is read from the clustered extract, by rank.
CLUSTERED_CAMPAIGN = 6


def _with_campaign(rows: DataFrame, study: Study, *columns: str) -> DataFrame:
    return rows.select("patient_id", clean.campaign_label(study).alias("campaign"), *columns)


# --- settings, extraction, cleaning


def campaign_windows(spark, sf_dir):
    """Records of each campaign and source up to the milestones of the calendar."""
    calendar = design.calendar(spark, FLU).select("campaign_label", "early_milestone_date", "primary_milestone_date")
    records = standin.flu_records(spark, sf_dir).withColumn("campaign_rank", clean.rank_of_campaign(FLU))
    labelled = records.withColumn("campaign_label", clean.campaign_label(FLU))
    counted = labelled.groupBy("campaign_label", "source", "vax_date").agg(F.count(F.lit(1)).alias("n"))
    up_to = lambda day: F.coalesce(F.sum(F.when(F.col("vax_date") <= F.col(day), F.col("n"))), F.lit(0))
    return (
        counted.join(calendar, "campaign_label")
        .groupBy(F.col("campaign_label").alias("campaign"), "source")
        .agg(
            up_to("early_milestone_date").alias("n_to_early"),
            up_to("primary_milestone_date").alias("n_to_primary"),
            F.sum("n").alias("n_records"),
        )
    )


def extract_events(spark, sf_dir):
    events = extract.with_disease(standin.vaccinations(spark, sf_dir), standin.DISEASE)
    return extract.covid_events(events, standin.patients(spark, sf_dir), standin.deaths(spark, sf_dir))


def codelist_semi_join(spark, sf_dir):
    return extract.with_code(standin.clinical_events(spark, sf_dir), "code", standin.codes(spark, sf_dir))


def population_filter(spark, sf_dir):
    frames = list(standin.flu_sources(spark, sf_dir).values())
    return extract.population(frames, standin.patients(spark, sf_dir), min_age=standin.MIN_AGE, on=FLU.end)


def flu_extract(spark, sf_dir):
    drug = standin.flu_sources(spark, sf_dir)["drug"]
    return extract.flu_events(drug, standin.patients(spark, sf_dir), min_age=standin.MIN_AGE, on=FLU.end)


def registration_extract(spark, sf_dir):
    periods = standin.registrations(spark, sf_dir).select(
        "patient_id",
        F.col("registration_start_date").alias("start_date"),
        F.col("deregistration_date").alias("end_date"),
    )
    vaccinated = extract.with_disease(standin.vaccinations(spark, sf_dir), standin.DISEASE)
    members = extract.population([vaccinated], standin.patients(spark, sf_dir))
    return extract.covid_registrations(periods, members)


def age_on_event(spark, sf_dir):
    folded = fold_rows(standin.vaccinations(spark, sf_dir), "patient_id", "date")
    aged = extract.with_person(folded, standin.patients(spark, sf_dir)).withColumn(
        "age", age_on(F.col("date_of_birth"), F.col("date"))
    )
    return unroll_rows(aged).select("patient_id", "date", "age")


def campaign_assign(spark, sf_dir):
    rows = clean.with_campaign(clean.dated(standin.vax(spark, sf_dir)), COVID)
    return rows.select(*KEY, "patient_id", "vax_date", "campaign", "campaign_rank")


def harmonise_product(spark, sf_dir):
    rows = clean.ranked(standin.vax(spark, sf_dir), COVID)
    return rows.select(
        *KEY,
        F.col("vax_product").alias("vax_product_raw"),
        clean.product_label(COVID).alias("vax_product"),
        "product_rank",
    )


def unmapped_products(spark, sf_dir):
    return clean.unmapped_products(standin.vax(spark, sf_dir), standin.covid_study(products=24))


# --- record flags


def date_flags(spark, sf_dir):
    return standin.vax(spark, sf_dir).select(
        *KEY, "patient_id", "vax_date", *[c.alias(n) for n, c in flags.date_flags(COVID).items()]
    )


def approval_flags(spark, sf_dir):
    return clean.ranked(standin.vax(spark, sf_dir), COVID).select(
        *KEY,
        clean.product_label(COVID).alias("vax_product"),
        "vax_date",
        flags.approval_date(COVID).alias("approval_date"),
        *[c.alias(n) for n, c in flags.approval_flags(COVID).items()],
    )


def same_day_pattern(spark, sf_dir):
    return flags.same_day_patterns(standin.vax(spark, sf_dir), COVID)


def same_day_flags(spark, sf_dir):
    same_day = [f for f in flags.FLAGS if f.startswith("flag_same_day")]
    return flags.flag_events(standin.vax(spark, sf_dir), COVID).select(
        "patient_id", "vax_date", "vax_product", "total_records_day", "n_products_day", "product_pattern", *same_day
    )


def flags_long(spark, sf_dir):
    return flags.long_flags(flags.flagged_days(standin.vax(spark, sf_dir), COVID), COVID)


# --- intervals


def dose_intervals(spark, sf_dir):
    return intervals.dose_intervals(standin.vax(spark, sf_dir), COVID)


def _gaps(spark, sf_dir):
    return intervals.dose_gaps(intervals.single_record_days(standin.vax(spark, sf_dir), COVID))


def _counted_gaps(spark, sf_dir):
    return intervals.fold_gaps(_gaps(spark, sf_dir))


def interval_bins(spark, sf_dir):
    return _gaps(spark, sf_dir).select(
        "patient_id", "vax_date", "interval_days", intervals.interval_bin().alias("interval_bin"), "interval_bin_rank"
    )


def interval_context(spark, sf_dir):
    return dose_intervals(spark, sf_dir).select(
        "patient_id", "vax_date", "prev_campaign_stage", "campaign_stage", "interval_context"
    )


# --- registration


def _decided(spark, sf_dir):
    folded = fold_rows(standin.vax(spark, sf_dir), "patient_id", "vax_date", "vax_product")
    dead_or_alive = extract.with_death(folded, standin.deaths(spark, sf_dir))
    return registration.add_active(dead_or_alive, standin.registrations(spark, sf_dir))


def active_on_date(spark, sf_dir):
    """The same by a semi join, written apart from the running maximum of ``active_flag_any``.

    A join of days with the periods around them: fine where a patient has few periods.
    """
    folded = fold_rows(standin.vax(spark, sf_dir), "patient_id", "vax_date", "vax_product")
    alive = extract.with_death(folded, standin.deaths(spark, sf_dir)).where("death_date IS NULL OR death_date >= vax_date")
    spans = registration.registration_spans(standin.registrations(spark, sf_dir)).withColumnRenamed("vax_date", "_from")
    within = (
        (alive["patient_id"] == spans["patient_id"])
        & (F.col("_from") <= F.col("vax_date"))
        & (F.col("vax_date") <= F.col("registered_until"))
    )
    active = alive.join(spans, within, "left_semi").drop("death_date")
    return unroll_rows(active).select("patient_id", "vax_date", "vax_product")


def active_flag_any(spark, sf_dir):
    return registration.unroll_active(_decided(spark, sf_dir)).select(
        "patient_id", "vax_date", "vax_product", "death_date", "active_on_vax_date"
    )


# --- summary tables


def roundmid(spark, sf_dir):
    counts = (
        standin.flu_records(spark, sf_dir)
        .groupBy(F.col("vax_date"), F.col("source"))
        .agg(F.count(F.lit(1)).alias("n_records"))
    )
    return counts.select(
        "vax_date",
        "source",
        "n_records",
        round_midpoint(F.col("n_records"), 10).alias("n_to_10"),
        round_midpoint(F.col("n_records") - 1, 6).alias("n_less_one_to_6"),
        round_midpoint(F.col("n_records"), 0).alias("n_to_0"),
    )


def table1_overall_flags(spark, sf_dir):
    return summaries.overall_flags(flags.flagged_days(standin.vax(spark, sf_dir), COVID))


def table2_campaign_flags(spark, sf_dir):
    days = extract.with_death(flags.day_products(standin.vax(spark, sf_dir), COVID), standin.deaths(spark, sf_dir))
    active = registration.add_active(days, standin.registrations(spark, sf_dir))
    return summaries.campaign_flags(flags.flag_days(active, COVID), COVID)


def table3_product_flags(spark, sf_dir):
    return summaries.product_flags(flags.flagged_days(standin.vax(spark, sf_dir), COVID), COVID)


def table4_interval_context(spark, sf_dir):
    return summaries.interval_contexts(_counted_gaps(spark, sf_dir), COVID)


def table5_campaign_transition(spark, sf_dir):
    return summaries.campaign_transitions(_counted_gaps(spark, sf_dir), COVID)


def table6_product_transition(spark, sf_dir):
    return summaries.product_transitions(_counted_gaps(spark, sf_dir), COVID)


SUMMARY_TABLES: dict[str, Query] = {
    "table1_overall_flags": table1_overall_flags,
    "table2_campaign_flags": table2_campaign_flags,
    "table3_product_flags": table3_product_flags,
    "table4_interval_context": table4_interval_context,
    "table5_campaign_transition": table5_campaign_transition,
    "table6_product_transition": table6_product_transition,
}


REPORTED = {
    "table1_overall_flags": "count_overall_noninterval_flags",
    "table2_campaign_flags": "count_campaign_noninterval_flags",
    "table3_product_flags": "count_product_noninterval_flags",
    "table4_interval_context": "count_interval_context",
    "table5_campaign_transition": "count_interval_campaign_transition",
    "table6_product_transition": "count_interval_product_transition",
}


def _reported(file: str) -> Query:
    """A table as the report job makes it, from the staged patient-days."""

    def query(spark, sf_dir):
        stage = session_staging(spark)
        events = extract.with_death(
            fold_rows(standin.vax(spark, sf_dir), "patient_id", "vax_date", "vax_product"), standin.deaths(spark, sf_dir)
        )
        flagged = flagged_with_active(unroll_rows(events), standin.registrations(spark, sf_dir), COVID)
        return report_tables(stage.by_patient(flagged), COVID, stage)[file]

    return query


def _rounded(query: Query) -> Query:
    return lambda spark, sf_dir: summaries.rounded(query(spark, sf_dir), COVID.threshold)


# --- comparison of sources


def flu_source_summary(spark, sf_dir):
    folded = fold_rows(standin.flu_records(spark, sf_dir), "source", "patient_id", "vax_date")
    aged = extract.with_person(flags.by_patient(folded), standin.patients(spark, sf_dir)).withColumn(
        "age", age_on(F.col("date_of_birth"), F.col("vax_date"))
    )
    return _with_campaign(
        crosssource.source_summary(aged, FLU),
        FLU,
        "source",
        "n_vax",
        "n_vax_including_exact_duplicates",
        _dates_text("vax_dates_list").alias("vax_dates"),
    )


def _dates_text(column):
    return F.array_join(F.transform(column, lambda d: d.cast("string")), ",")


def flu_union_sources(spark, sf_dir):
    rows = standin.flu_records(spark, sf_dir).withColumn("campaign_rank", clean.rank_of_campaign(FLU))
    return _with_campaign(rows.select("patient_id", "campaign_rank", "source").distinct(), FLU, "source")


def flu_dates_wide(spark, sf_dir):
    records = standin.flu_records(spark, sf_dir).withColumn("age", F.lit(None).cast("int"))
    wide = crosssource.dates_by_source(crosssource.source_summary(records, FLU))
    return _with_campaign(wide, FLU, *[_dates_text(s).alias(s) for s in SOURCES])


def _presence(spark, sf_dir):
    return crosssource.source_presence(standin.flu_records(spark, sf_dir), FLU)


def source_combination_person(spark, sf_dir):
    return _with_campaign(
        crosssource.with_combination(_presence(spark, sf_dir)), FLU, *SOURCES, "source_combination"
    )


def _combination_counts(spark, sf_dir):
    return crosssource.combination_counts(_presence(spark, sf_dir), FLU)


def table_flu_sources(spark, sf_dir):
    return crosssource.source_table(_combination_counts(spark, sf_dir), FLU)


def upset_counts(spark, sf_dir):
    return crosssource.upset_table(_combination_counts(spark, sf_dir), FLU)


def report_upset_counts(spark, sf_dir):
    """The counts as the report job makes them, from the people counted for date agreement."""
    people = crosssource.agreement_counts(crosssource.date_agreement(standin.flu_records(spark, sf_dir), FLU))
    return crosssource.upset_table(crosssource.round_counts(people, FLU), FLU)


def clustered_extract(spark, sf_dir):
    """Events written by month and patient, and those of one campaign read back."""
    path = session_staging(spark).new_path()
    write_clustered(standin.vax(spark, sf_dir).select("patient_id", "vax_date", "vax_product"), path)
    return read_campaign(spark, path, "patient_id BIGINT, vax_date DATE, vax_product STRING", COVID, CLUSTERED_CAMPAIGN)


def _kept_up(spark, sf_dir) -> upkeep.State:
    """Records of even orders as a first extract, those of odd ones as its delta."""
    stage, registrations = session_staging(spark), standin.registrations(spark, sf_dir)
    events = extract.with_death(standin.vax(spark, sf_dir), standin.deaths(spark, sf_dir))
    even = F.col("l_orderkey") % 2 == 0
    state = upkeep.first_state(events.where(even), registrations, COVID, stage)
    return upkeep.with_delta(state, events.where(~even), registrations, COVID, stage)


def upkeep_campaign_flags(spark, sf_dir):
    return summaries.campaign_flags(_kept_up(spark, sf_dir).days, COVID)


def upkeep_interval_context(spark, sf_dir):
    return summaries.interval_contexts(_kept_up(spark, sf_dir).gaps, COVID)


def _bitmaps(spark, sf_dir) -> DataFrame:
    stage = session_staging(spark)
    days = extract.with_death(flags.day_products(standin.vax(spark, sf_dir), COVID), standin.deaths(spark, sf_dir))
    flagged = flags.flag_days(registration.add_active(days, standin.registrations(spark, sf_dir)), COVID)
    return stage.store(distincts.flag_bitmaps(stage.by_patient(flagged), stage))


def bitmap_overall_flags(spark, sf_dir):
    return distincts.overall_flags(_bitmaps(spark, sf_dir))


def bitmap_campaign_flags(spark, sf_dir):
    return distincts.campaign_flags(_bitmaps(spark, sf_dir), COVID)


def bitmap_product_flags(spark, sf_dir):
    return distincts.product_flags(_bitmaps(spark, sf_dir), COVID)


def arrow_extract(spark, sf_dir):
    """Events written as Arrow files, and patients and days of one campaign read back."""
    path = session_staging(spark).new_path()
    write_arrow(standin.vax(spark, sf_dir), path, batch_rows="4096")
    first, last = campaign_days(COVID, CLUSTERED_CAMPAIGN)
    events = read_arrow(spark, path, "patient_id BIGINT, vax_date DATE", split_bytes="1000000")
    return events.where((F.col("vax_date") >= F.lit(first)) & (F.col("vax_date") <= F.lit(last)))


def sql_dose_intervals(spark, sf_dir):
    """Dose intervals in plain SQL with the study's functions."""
    register_functions(spark, COVID)
    return spark.sql(
        """WITH days AS (
  SELECT patient_id, vax_date, campaign_on(vax_date) AS campaign FROM {vax} WHERE vax_date >= :first
  GROUP BY patient_id, vax_date HAVING count(*) = 1),
gaps AS (
  SELECT *, lag(vax_date) OVER by_day AS prev_date, lag(campaign) OVER by_day AS prev_campaign
  FROM days WINDOW by_day AS (PARTITION BY patient_id ORDER BY vax_date))
SELECT patient_id, prev_date, vax_date, interval_bin(datediff(vax_date, prev_date)) AS interval_bin,
  interval_context(campaign_stage(prev_campaign), campaign_stage(campaign), prev_campaign = campaign) AS interval_context
FROM gaps WHERE prev_date IS NOT NULL""",
        args={"first": COVID.campaign_starts[1]},
        vax=standin.vax(spark, sf_dir),
    )


def sql_campaign_ages(spark, sf_dir):
    """Records of booster campaigns by decade of age, rounded, in plain SQL with the study's functions."""
    register_functions(spark, COVID)
    return spark.sql(
        """WITH days AS (SELECT patient_id, vax_date, count(*) AS n FROM {vax} GROUP BY patient_id, vax_date),
ages AS (
  SELECT campaign_on(vax_date) AS campaign, age_on(date_of_birth, vax_date) DIV 10 AS decade, sum(n) AS n
  FROM days JOIN {patients} USING (patient_id) GROUP BY ALL)
SELECT campaign_rank, campaign, first_day, last_day, decade, roundmid_any(n, 10) AS n
FROM campaign_calendar('booster') JOIN ages USING (campaign)""",
        vax=standin.vax(spark, sf_dir),
        patients=standin.patients(spark, sf_dir),
    )


def source_set_intersections(spark, sf_dir):
    return sourcesets.intersection_table(standin.four_source_records(spark, sf_dir), FOUR_SOURCES, FLU)


def source_pair_agreement(spark, sf_dir):
    return sourcesets.pair_agreement(standin.four_source_records(spark, sf_dir), FOUR_SOURCES, FLU, AGREE_WITHIN)


def files_round_trip(spark, sf_dir):
    """A codelist and the released counts, written as files, read back and joined with records."""
    folder = session_staging(spark).new_path()
    listed = standin.urgent_patients(spark, sf_dir).select(F.col("patient_id").cast("string").alias("person"))
    listed.write.csv(f"{folder}/codes", header=True)
    write_csv(upset_counts(spark, sf_dir), f"{folder}/counts")
    codes = read_codelist(spark, f"{folder}/codes", "person")
    counts = read_source_counts(spark, f"{folder}/counts")
    sources = flu_union_sources(spark, sf_dir)
    chosen = extract.with_code(sources.withColumn("person", F.col("patient_id").cast("string")), "person", codes)
    presence = source_combination_person(spark, sf_dir).select(
        F.col("patient_id").alias("_id"), F.col("campaign").alias("_campaign"), *SOURCES
    )
    both = (F.col("patient_id") == F.col("_id")) & F.col("campaign").eqNullSafe(F.col("_campaign"))
    same = F.col("p.campaign").eqNullSafe(F.col("c.campaign"))
    for source in SOURCES:
        same &= F.col(f"p.{source}") == F.col(f"c.{source}")
    found = chosen.join(presence, both).alias("p").join(counts.alias("c"), same)
    return found.select("p.patient_id", "p.campaign", "p.source", "c.n")


def upset_intersections(spark, sf_dir):
    return upset.intersections(upset_counts(spark, sf_dir))


def upset_set_sizes(spark, sf_dir):
    return upset.set_sizes(upset_counts(spark, sf_dir))


def upset_uncount(spark, sf_dir):
    return upset.uncount(upset_counts(spark, sf_dir))


def date_agreement_person(spark, sf_dir):
    agreed = crosssource.date_agreement(standin.flu_records(spark, sf_dir), FLU)
    return _with_campaign(agreed, FLU, *crosssource.MATCHES)


def date_agreement_bandjoin(spark, sf_dir):
    agreed = crosssource.date_agreement_by_band(standin.flu_records(spark, sf_dir), FLU, 7)
    return _with_campaign(agreed, FLU, "within_7d_table_drug", "within_7d_table_snomed")


def table_date_agreement(spark, sf_dir):
    agreed = crosssource.date_agreement(standin.flu_records(spark, sf_dir), FLU)
    return crosssource.agreement_table(crosssource.agreement_counts(agreed), FLU)


# --- fault injection


def age_shift(spark, sf_dir):
    return perturb.recompute_age(standin.keyed_vax(spark, sf_dir), ["row_key"], session_staging(spark))


def inject_expand(spark, sf_dir):
    return perturb.expand_patients(standin.keyed_vax(spark, sf_dir))


def inject_faults(spark, sf_dir):
    return perturb.inject_faults(standin.keyed_vax(spark, sf_dir), COVID)


def inject_intervals(spark, sf_dir):
    stage = session_staging(spark)
    return perturb.inject_intervals(stage.store(inject_faults(spark, sf_dir)), stage)


def inject_all(spark, sf_dir):
    return perturb.perturb(standin.keyed_vax(spark, sf_dir), COVID, session_staging(spark))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        campaign_windows,
        extract_events,
        codelist_semi_join,
        population_filter,
        flu_extract,
        registration_extract,
        age_on_event,
        campaign_assign,
        harmonise_product,
        unmapped_products,
        date_flags,
        approval_flags,
        same_day_pattern,
        same_day_flags,
        flags_long,
        dose_intervals,
        interval_bins,
        interval_context,
        active_on_date,
        active_flag_any,
        roundmid,
        flu_source_summary,
        flu_union_sources,
        flu_dates_wide,
        source_combination_person,
        table_flu_sources,
        upset_counts,
        report_upset_counts,
        files_round_trip,
        clustered_extract,
        arrow_extract,
        sql_dose_intervals,
        sql_campaign_ages,
        source_set_intersections,
        source_pair_agreement,
        upkeep_campaign_flags,
        upkeep_interval_context,
        bitmap_overall_flags,
        bitmap_campaign_flags,
        bitmap_product_flags,
        upset_intersections,
        upset_set_sizes,
        upset_uncount,
        date_agreement_person,
        date_agreement_bandjoin,
        table_date_agreement,
        age_shift,
        inject_expand,
        inject_faults,
        inject_intervals,
        inject_all,
    )
}
for _name, _query in SUMMARY_TABLES.items():
    QUERIES[_name] = _query
    QUERIES[f"{_name}_rounded"] = _rounded(_query)
    QUERIES[f"report_{_name}"] = _reported(REPORTED[_name])
