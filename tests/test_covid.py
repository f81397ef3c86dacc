import pytest
from fixtures import RAW, covid_events, covid_registrations, day, rows_of, sorted_rows
from pyspark.sql import functions as F

from jabcheck.operators import clean, extract, flags, intervals, registration, summaries
from jabcheck.operators.staging import session_staging
from jabcheck.plans.covid import flagged_with_active, report_tables
from jabcheck.study import covid_study

STUDY = covid_study()

OVERALL = [
    ("flag_implausible_early_date", 2, 2),
    ("flag_pre_rollout_date", 1, 1),
    ("flag_product_before_approval", 4, 3),
    ("flag_same_day_mixed_product", 3, 1),
    ("flag_same_day_multiple", 5, 2),
    ("flag_same_day_same_product", 2, 1),
    ("flag_unapproved_product", 1, 1),
]


@pytest.fixture(scope="module")
def events(spark):
    return covid_events(spark).cache()


@pytest.fixture(scope="module")
def flagged(spark, events):
    return flagged_with_active(events, covid_registrations(spark), STUDY).cache()


def test_overall_flags(flagged):
    assert rows_of(summaries.overall_flags(flagged)) == [(*row, 18, 5) for row in OVERALL]


def test_rounded_overall_flags(flagged):
    table = summaries.rounded(summaries.overall_flags(flagged), 10)
    assert table.columns == [
        "flag_type",
        "n_records_midpoint6",
        "n_patients_midpoint6",
        "denom_records_total_midpoint6",
        "denom_patients_total_midpoint6",
    ]
    assert all(r[1:] == (5, 5, 15, 5) for r in rows_of(table))


def test_campaign_flags(flagged):
    table = rows_of(summaries.campaign_flags(flagged, STUDY))
    denominators = {(r[0], r[4], r[5]) for r in table}
    assert ("Pre-roll-out", 1, 1) in denominators
    assert ("Primary series", 4, 8) in denominators
    assert ("Pre-2020-04-23", None, None) in denominators
    assert (None, None, None) in denominators
    order = [r[0] for r in table]
    assert order == sorted(order, key=lambda c: STUDY.campaign_labels.index(c) if c else 99)


def test_product_flags_in_level_order(flagged):
    table = rows_of(summaries.product_flags(flagged, STUDY))
    levels = [STUDY.product_labels.index(r[0]) for r in table]
    assert levels == sorted(levels)
    assert sum(r[2] for r in table) == 18 and {r[4:] for r in table} == {(18, 5)}


def test_long_flags_agree_with_table_one(flagged):
    long = flags.long_flags(flagged, STUDY)
    got = long.groupBy("flag_type").agg(F.count("*"), F.countDistinct("patient_id"))
    assert sorted(rows_of(got)) == OVERALL


def test_same_day_invariants(events):
    flagged = flags.flag_events(events, STUDY, "age", "death_date")
    assert flagged.count() == 15
    broken = flagged.where(
        "flag_same_day_multiple <> (flag_same_day_same_product OR flag_same_day_mixed_product)"
        " OR (flag_same_day_same_product AND flag_same_day_mixed_product)"
        " OR (flag_unapproved_product AND flag_product_before_approval IS NOT NULL)"
    )
    assert broken.count() == 0


def test_patterns(events):
    patterns = {
        (r.patient_id, str(r.vax_date)): r.product_pattern
        for r in flags.same_day_patterns(events, STUDY).where("total_records_day > 1").collect()
    }
    assert patterns == {
        (3, "2021-04-01"): "2x az_original",
        (4, "2021-05-01"): "2x pfizer_original  --AND-- 1x az_original",
    }


def test_intervals(events):
    got = intervals.dose_intervals(events, STUDY).select(
        "patient_id", "interval_days", "interval_bin", "interval_context"
    )
    assert sorted(rows_of(got)) == [
        (1, 25, "21-29", "within_primary"),
        (2, 84, "30-89", "within_primary"),
        (2, 221, "180+", "within_primary"),
        (4, 196, "180+", "between_booster_campaigns"),
    ]


def test_intervals_are_the_same_from_flagged_days(events, flagged):
    single = intervals.after_first_campaign(flagged.where("total_records_day = 1"), STUDY)
    described = intervals.describe_gaps(intervals.dose_gaps(single), STUDY)
    assert sorted_rows(described) == sorted_rows(intervals.dose_intervals(events, STUDY))


def test_interval_tables_share_totals(flagged):
    tables = report_tables(flagged, STUDY, session_staging(flagged.sparkSession))
    for name in ("context", "campaign_transition", "product_transition"):
        table = tables[f"count_interval_{name}"]
        rows = table.collect()
        assert {(r.denom_records_total, r.denom_patients_total) for r in rows} == {(4, 3)}
        groups = {}
        for r in rows:
            groups.setdefault(r[0], [0, r.denom_records_group])[0] += r.n_records
        assert all(total == denominator for total, denominator in groups.values())
    context = {(r[0], r[1]): tuple(r)[2:6] for r in tables["count_interval_context"].collect()}
    assert context[("within_primary", "21-29")] == (1, 1, 3, 2)


def test_active_borders(spark):
    events = spark.createDataFrame(
        [(1, day(d), "x", day(death)) for d, death in BORDER_EVENTS],
        "patient_id BIGINT, vax_date DATE, vax_product STRING, death_date DATE",
    )
    periods = spark.createDataFrame(
        [(1, day("2021-01-01"), day("2021-06-30")), (1, day("2021-01-01"), day("2021-02-01")), (1, None, None)],
        "patient_id BIGINT, registration_start_date DATE, deregistration_date DATE",
    )
    got = {
        (str(r.vax_date), r.death_date and str(r.death_date)): r.active_on_vax_date
        for r in registration.events_with_active(events, periods).collect()
    }
    assert got == BORDER_EVENTS


BORDER_EVENTS = {
    ("2020-12-31", None): False,
    ("2021-01-01", None): True,
    ("2021-02-02", None): True,
    ("2021-06-30", None): True,
    ("2021-07-01", None): False,
    ("2021-03-01", "2021-03-01"): True,
    ("2021-03-02", "2021-03-01"): False,
}


def test_active_equals_join_with_every_period(spark, small_dir):
    from jabcheck.checks import standin

    events = extract.with_death(standin.vax(spark, small_dir), standin.deaths(spark, small_dir)).select(
        "patient_id", "vax_date", "vax_product", "death_date"
    )
    periods = standin.registrations(spark, small_dir)
    inside = (
        (F.col("registration_start_date") <= F.col("vax_date"))
        & (F.col("deregistration_date").isNull() | (F.col("deregistration_date") >= F.col("vax_date")))
        & (F.col("death_date").isNull() | (F.col("death_date") >= F.col("vax_date")))
    )
    p = periods.withColumnRenamed("patient_id", "pid")
    semi = events.join(p, (F.col("pid") == F.col("patient_id")) & inside, "left_semi")
    assert sorted_rows(semi) == sorted_rows(registration.active_events(events, periods))


def test_every_unmapped_product_is_listed(spark, events, tmp_path):
    path = f"{tmp_path}/unmapped.csv"
    clean.require_mapped(events, STUDY, path)
    assert not (tmp_path / "unmapped.csv").exists()
    names = [f"TEST_{i:02d}" for i in range(79)] + [None]
    rows = [(9, day("2021-05-01"), name, 1, None) for name in names for _ in range(2)]
    bad = events.unionByName(spark.createDataFrame(rows, events.schema))
    with pytest.raises(clean.UnmappedProductsError, match="80 .*unmapped.csv"):
        clean.require_mapped(bad, STUDY, path)
    listed = spark.read.csv(path, header=True, nullValue="NA", schema="name STRING, n BIGINT").collect()
    assert [(r.name, r.n) for r in listed] == [(name, 2) for name in names]


def test_double_space_is_part_of_a_name(spark):
    raw = RAW["pfizer_LP81_children"]
    events = spark.createDataFrame(
        [(1, day("2025-10-01"), name) for name in (raw, raw.replace("  ", " "))],
        "patient_id BIGINT, vax_date DATE, vax_product STRING",
    )
    ranks = [r.product_rank for r in clean.ranked(events, STUDY).orderBy("product_rank").collect()]
    assert ranks == [13, STUDY.unmapped_rank]
