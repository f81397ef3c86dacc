"""The same vaccinations as seen by several record sources: presence and date agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jabcheck.functions.labels import SOURCES, source_combination
from jabcheck.functions.rounding import number_text, percent, round_midpoint, round_tenth
from jabcheck.operators.clean import campaign_label, dated, rank_of_campaign
from jabcheck.operators.flags import by_patient
from jabcheck.operators.summaries import ordered
from jabcheck.study import Study

PERSON = ["patient_id", "campaign_rank"]

# Sources compared with the vaccination table, and how they are printed.
COMPARED = {"drug": "Drug", "snomed": "SNOMED"}

# Largest difference in days -> (column prefix, printed name).
TOLERANCES = {0: ("same_day", "Same day"), 7: ("within_7d", "Within 7 days")}


def union_sources(**frames: DataFrame) -> DataFrame:
    """Dated records of all sources in one table, each tagged with its ``source``."""
    tagged = [
        dated(frame).select("patient_id", "vax_date", "age", F.lit(name).alias("source"))
        for name, frame in frames.items()
    ]
    merged = tagged[0]
    for frame in tagged[1:]:
        merged = merged.unionByName(frame)
    return merged


def source_summary(records: DataFrame, study: Study) -> DataFrame:
    """Per source, patient and campaign: doses, records and the sorted distinct dates.

    Exact duplicates (same date and age) are one dose. They are counted away before the
    dates are listed, so a list has at most one entry per day of its campaign. Records that
    are folded already carry their number as ``n_records``. Doses move by patient once; rows
    that are dealt :func:`by_patient` when they come stay where they are.
    """
    number = F.sum("n_records") if "n_records" in records.columns else F.count(F.lit(1))
    doses = records.groupBy("source", "patient_id", "vax_date", "age").agg(number.alias("n"))
    return (
        by_patient(doses)
        .withColumn("campaign_rank", rank_of_campaign(study))
        .groupBy("source", *PERSON)
        .agg(
            F.count(F.lit(1)).alias("n_vax"),
            F.sum("n").alias("n_vax_including_exact_duplicates"),
            F.array_sort(F.collect_set("vax_date")).alias("vax_dates_list"),
        )
    )


def dates_by_source(summary: DataFrame) -> DataFrame:
    """One row per patient and campaign with a list of dates per source, NULL if absent."""
    return summary.groupBy(*PERSON).pivot("source", list(SOURCES)).agg(F.first("vax_dates_list"))


def source_presence(records: DataFrame, study: Study) -> DataFrame:
    """Which sources have a record, per patient and campaign.

    Reads the records directly: presence needs neither duplicates nor dates, so this is
    one combined shuffle.
    """
    present = [F.bool_or(F.col("source") == name).alias(name) for name in SOURCES]
    return records.withColumn("campaign_rank", rank_of_campaign(study)).groupBy(*PERSON).agg(*present)


def with_combination(presence: DataFrame) -> DataFrame:
    return presence.withColumn("source_combination", source_combination(*[F.col(s) for s in SOURCES]))


def combination_counts(presence: DataFrame, study: Study) -> DataFrame:
    """People per campaign and source combination, disclosure-rounded."""
    people = presence.groupBy("campaign_rank", *SOURCES).agg(F.count(F.lit(1)).alias("n"))
    return round_counts(people, study)


def round_counts(people: DataFrame, study: Study) -> DataFrame:
    return people.select("campaign_rank", *SOURCES, round_midpoint(F.col("n"), study.threshold).alias("n"))


def source_table(counts: DataFrame, study: Study) -> DataFrame:
    """Source combinations by campaign with their share; totals add up the rounded counts."""
    total = F.sum("n").over(W.partitionBy("campaign_rank"))
    share = round_tenth(F.col("n") / F.col("tot_camp") * 100)
    table = (
        with_combination(counts)
        .withColumn("tot_camp", total)
        .withColumn("perc_source", share)
        .withColumn(
            "n_perc_source",
            F.concat(F.col("n").cast("string"), F.lit(" ("), number_text(F.col("perc_source")), F.lit("%)")),
        )
    )
    return ordered(table, F.col("campaign_rank").asc_nulls_last(), F.col("source_combination")).select(
        campaign_label(study).alias("campaign"),
        "source_combination",
        F.col("n").alias("n_source"),
        "tot_camp",
        "perc_source",
        "n_perc_source",
    )


def upset_table(counts: DataFrame, study: Study) -> DataFrame:
    """Counts behind a set-intersection chart: one row per campaign and presence pattern."""
    return ordered(counts, F.col("campaign_rank").asc_nulls_last(), *SOURCES).select(
        campaign_label(study).alias("campaign"), *SOURCES, "n"
    )


def _match_name(days: int, other: str) -> str:
    return f"{TOLERANCES[days][0]}_table_{other}"


MATCHES = [_match_name(days, other) for days in TOLERANCES for other in COMPARED]


def date_agreement(records: DataFrame, study: Study) -> DataFrame:
    """Per patient and campaign: is any table date close to any date of another source?

    Beside the answers stands which sources are present. An answer is NULL where either
    source is absent. The closest pair of two sources is found among
    neighbours in time, so one pass over a person's days with the latest earlier date of
    each source decides every tolerance; no dates are paired up.
    """
    days = (
        records.groupBy("patient_id", "vax_date")
        .agg(*[F.bool_or(F.col("source") == name).alias(name) for name in SOURCES])
        .withColumn("campaign_rank", rank_of_campaign(study))
    )
    so_far = W.partitionBy(*PERSON).orderBy("vax_date").rowsBetween(W.unboundedPreceding, 0)
    latest = {
        f"_last_{name}": F.last(F.when(F.col(name), F.col("vax_date")), ignorenulls=True).over(so_far)
        for name in SOURCES
    }

    def near(other: str, within: int) -> Column:
        since_other = F.col("table") & (F.datediff("vax_date", f"_last_{other}") <= within)
        since_table = F.col(other) & (F.datediff("vax_date", "_last_table") <= within)
        return F.coalesce(since_other, F.lit(False)) | F.coalesce(since_table, F.lit(False))

    matches = [
        F.when(F.bool_or("table") & F.bool_or(other), F.bool_or(near(other, within))).alias(_match_name(within, other))
        for within in TOLERANCES
        for other in COMPARED
    ]
    present = [F.bool_or(name).alias(name) for name in SOURCES]
    return days.withColumns(latest).groupBy(*PERSON).agg(*present, *matches)


def date_agreement_by_band(records: DataFrame, study: Study, within: int) -> DataFrame:
    """The same answer from an equi-join on time buckets, as an independent check.

    A date only meets dates in its own and the two neighbouring buckets of ``within + 1``
    days, so it has at most ``3 * (within + 1)`` partners however many records there are.
    """
    width = within + 1
    days = (
        records.select("source", "patient_id", "vax_date")
        .distinct()
        # 0 stands for the NULL campaign, which must join with itself
        .withColumn("campaign_rank", F.coalesce(rank_of_campaign(study), F.lit(0)))
        .withColumn("_bucket", F.floor(F.unix_date("vax_date") / F.lit(width)))
    )
    table = days.where(F.col("source") == "table").select(
        *PERSON,
        F.col("vax_date").alias("_table_date"),
        F.explode(F.array(*[F.col("_bucket") + shift for shift in (-1, 0, 1)])).alias("_bucket"),
    )
    pairs = (
        days.where(F.col("source") != "table")
        .join(table, [*PERSON, "_bucket"])
        .where(F.abs(F.datediff("vax_date", "_table_date")) <= within)
    )
    matched = pairs.groupBy(*PERSON).agg(
        *[F.bool_or(F.col("source") == other).alias(f"_near_{other}") for other in COMPARED]
    )
    presence = days.groupBy(*PERSON).agg(*[F.bool_or(F.col("source") == s).alias(s) for s in SOURCES])
    answers = [
        F.when(F.col("table") & F.col(other), F.coalesce(f"_near_{other}", F.lit(False))).alias(
            _match_name(within, other)
        )
        for other in COMPARED
    ]
    answered = presence.join(matched, PERSON, "left").select(*PERSON, *answers)
    return answered.withColumn("campaign_rank", F.nullif(F.col("campaign_rank"), F.lit(0)))


def agreement_counts(agreement: DataFrame) -> DataFrame:
    """People, matches and comparable people per campaign and source combination.

    The few rows behind every cross-source table, so a report needs one pass over people.
    """
    return agreement.groupBy("campaign_rank", *SOURCES).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(m)).alias(f"{m}_n") for m in MATCHES],
        *[F.count(m).alias(f"{m}_denom") for m in MATCHES],
    )


def agreement_table(counts: DataFrame, study: Study) -> DataFrame:
    """People whose dates agree, out of those in both sources, per campaign and comparison.

    Takes :func:`agreement_counts`. A campaign without comparable people keeps its rows.
    """
    sums = counts.groupBy("campaign_rank").agg(
        *[F.sum(f"{m}_{part}").alias(f"{m}_{part}") for m in MATCHES for part in ("n", "denom")]
    )
    printed = {
        _match_name(days, other): f"{TOLERANCES[days][1]}: Table vs {shown}"
        for days in TOLERANCES
        for other, shown in COMPARED.items()
    }
    entries = [
        F.struct(
            F.lit(text).alias("comparison"),
            round_midpoint(F.col(f"{m}_n"), study.threshold).alias("n"),
            round_midpoint(F.col(f"{m}_denom"), study.threshold).alias("denom"),
        )
        for m, text in printed.items()
    ]
    share = percent(F.col("n"), F.col("denom"))
    text = F.concat(
        F.col("n").cast("string"),
        F.lit(" / "),
        F.col("denom").cast("string"),
        F.lit(" ("),
        number_text(round_tenth(F.col("pct"))),
        F.lit("%)"),
    )
    table = (
        sums.select("campaign_rank", F.inline(F.array(*entries))).withColumn("pct", share).withColumn("n_pct", text)
    )
    return ordered(table, F.col("campaign_rank").asc_nulls_last(), F.col("comparison")).select(
        campaign_label(study).alias("campaign"), "comparison", "n", "denom", "pct", "n_pct"
    )
