from datetime import date, timedelta

import pytest
from fixtures import day, py_draw
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jabcheck.functions.dates import age_on, by_rank, campaign_rank
from jabcheck.functions.draws import MODULUS, draw, draw_below
from jabcheck.functions.labels import INTERVAL_BINS, interval_bin_rank, source_combination
from jabcheck.functions.rounding import number_text, percent, round_midpoint, round_tenth
from jabcheck.study import autumn_campaigns, covid_study, flu_study


def values(spark, column, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


@pytest.mark.parametrize(
    "to, expected",
    [(10, [0, 5, 5, 15, 15, 25]), (6, [0, 3, 9, 9, 21, 21]), (0, [0, 1, 10, 11, 20, 21]), (1, [0, 1, 10, 11, 20, 21])],
)
def test_midpoint(spark, to, expected):
    data = [(x,) for x in (0, 1, 10, 11, 20, 21)]
    assert values(spark, round_midpoint(F.col("x"), to), data, "x BIGINT") == expected


def test_midpoint_is_exact_for_large_counts(spark):
    big = 2**60 + 1
    got = values(spark, round_midpoint(F.col("x"), 10), [(big,), (None,)], "x BIGINT")
    assert got == [-(-big // 10) * 10 - 5, None]


def test_tenths(spark):
    cases = {0.15: 0.1, 6.25: 6.2, 8.05: 8.1, 12.75: 12.8, 100 / 3: 33.3, 100.0: 100.0, 0.0: 0.0}
    assert values(spark, round_tenth(F.col("x")), [(x,) for x in cases], "x DOUBLE") == list(cases.values())


def test_number_text_and_percent(spark):
    data = [(5, 15), (0, 5), (5, 5), (0, 0)]
    text = number_text(round_tenth(percent(F.col("n"), F.col("d"))))
    assert values(spark, text, data, "n BIGINT, d BIGINT") == ["33.3", "0", "100", "NaN"]


def test_age(spark):
    data = [
        ("2000-02-29", "2001-02-28", 0),
        ("2000-02-29", "2001-03-01", 1),
        ("2000-06-15", "2020-06-14", 19),
        ("2000-06-15", "2020-06-15", 20),
        ("2000-06-15", "1999-06-15", -1),
    ]
    got = values(
        spark, age_on(F.col("b"), F.col("d")), [(day(b), day(d)) for b, d, _ in data], "b DATE, d DATE"
    )
    assert got == [a for _, _, a in data]


def test_campaign_borders(spark):
    study = covid_study()
    labels = by_rank(campaign_rank("d", study.campaign_starts), study.campaign_labels, "string")
    cases = {
        "1899-12-31": None,
        "1900-01-01": "Pre-2020-04-23",
        "2020-04-22": "Pre-2020-04-23",
        "2020-04-23": "Pre-roll-out",
        "2020-12-07": "Pre-roll-out",
        "2020-12-08": "Primary series",
        "2025-09-29": "Autumn 2025",
        "2099-01-01": "Autumn 2025",
    }
    assert values(spark, labels, [(day(d),) for d in cases], "d DATE") == list(cases.values())
    assert values(spark, labels, [(None,)], "d DATE") == [None]


def test_interval_bins(spark):
    edges = [0, 1, 6, 7, 13, 14, 20, 21, 29, 30, 89, 90, 112, 113, 179, 180, 10_000]
    got = values(spark, interval_bin_rank("x"), [(x,) for x in edges], "x INT")
    expected = [
        next((n for n, (_, a, b) in enumerate(INTERVAL_BINS, 1) if x >= a and (b is None or x <= b)), None)
        for x in edges
    ]
    assert got == expected == [None, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8]


def test_source_combinations(spark):
    data = [(bool(i & 4), bool(i & 2), bool(i & 1)) for i in range(8)]
    got = values(spark, source_combination(F.col("a"), F.col("b"), F.col("c")), data, "a BOOLEAN, b BOOLEAN, c BOOLEAN")
    assert got == [
        None,
        "snomed only",
        "drug only",
        "drug + snomed",
        "table only",
        "table + snomed",
        "table + drug",
        "table + drug + snomed",
    ]


def test_names_with_quotes_survive(spark):
    names = ["it's", 'a "b"', "back\\slash", "two  spaces"]
    got = values(spark, by_rank(F.col("r"), names, "string"), [(i,) for i in range(1, 5)], "r INT")
    assert got == names


def test_product_list_matches_published_sizes():
    study = covid_study()
    assert len(study.products) == len(dict(study.products)) == len({raw for _, raw in study.products}) == 44
    assert len(study.approvals) == 12 and set(study.approvals) <= set(dict(study.products))
    assert sum("  (Pfizer Ltd)" in raw for _, raw in study.products) == 2
    assert len(study.campaigns) == 12 and len(flu_study().campaigns) == 7
    assert [c.label for c in autumn_campaigns(2020, 2021)] == ["Pre-2020", "Autumn 2020", "Autumn 2021"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=50))
def test_draws_match_plain_arithmetic(spark, keys):
    got = values(spark, draw(F.col("k"), 3), [(k,) for k in keys], "k BIGINT")
    assert got == [py_draw(k, 3) for k in keys]


def test_draws_cover_their_range(spark):
    counts = dict(
        (r[0], r[1])
        for r in spark.range(20_000).groupBy(draw_below(F.col("id"), 5, 7).alias("d")).count().collect()
    )
    assert set(counts) == set(range(7)) and min(counts.values()) > 2400


def test_calendar(spark):
    from jabcheck.plans.design import calendar

    flu = {r.campaign_label: r for r in calendar(spark, flu_study()).collect()}
    days = lambda r: (r.early_milestone_days, r.primary_milestone_days, r.final_milestone_days)
    assert days(flu["Autumn 2020"]) == (91, 212, 365)
    assert days(flu["Autumn 2023"]) == (91, 213, 366)
    assert days(flu["Autumn 2025"]) == (91, 212, 153)
    assert days(flu["Pre-2020"]) == (1, 1, 44073)
    covid = {r.campaign_label: r for r in calendar(spark, covid_study()).collect()}
    assert covid["Pre-roll-out"].final_milestone_days == 229
    assert covid["Primary series"].early_milestone_date == date(2020, 12, 8) + timedelta(days=55)
    assert covid["Autumn 2025"].final_milestone_date == date(2029, 12, 31)
