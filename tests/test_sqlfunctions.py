"""SQL functions against the column expressions that the operators use."""

from datetime import date, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from jabcheck.functions import dates, labels, rounding
from jabcheck.functions.sqlfunctions import register_functions
from jabcheck.operators.clean import with_campaign
from jabcheck.study import covid_study, flu_study

STUDY = covid_study()


@pytest.fixture(autouse=True)
def functions(spark):
    register_functions(spark, STUDY)


def same(frame, call, column):
    rows = frame.select(F.expr(call).alias("sql"), column.alias("column")).collect()
    assert rows and [r["sql"] for r in rows] == [r["column"] for r in rows]
    return rows


def test_rounding(spark):
    numbers = spark.createDataFrame([(None,), *[(i,) for i in range(40)], (2**53 + 1,)], "n BIGINT")
    for step in (0, 1, 5, 6, 10):
        same(numbers, f"roundmid_any(n, {step})", rounding.round_midpoint(F.col("n"), step))


def test_ages(spark):
    days = [None, *[date(2000, 2, 27) + timedelta(days=i) for i in range(4)], date(2001, 2, 28), date(2020, 2, 29)]
    frame = spark.createDataFrame(list(product(days, days)), "born DATE, day DATE")
    same(frame, "age_on(born, day)", dates.age_on(F.col("born"), F.col("day")))


def test_bins_and_campaigns(spark):
    frame = spark.range(-3, 400).select(F.col("id").cast("int").alias("days"))
    bins = [label for label, _, _ in labels.INTERVAL_BINS]
    same(frame, "interval_bin(days)", dates.by_rank(labels.interval_bin_rank("days"), bins, "string"))
    days = spark.range(0, 2600).select(F.date_add(F.lit(date(2019, 12, 1)), F.col("id").cast("int")).alias("vax_date"))
    assert len({r["sql"] for r in same(with_campaign(days, STUDY), "campaign_on(vax_date)", F.col("campaign"))}) > 5


def test_stages_and_contexts(spark):
    stages = [labels.PRIMARY, labels.BOOSTER, None]
    frame = spark.createDataFrame(list(product(stages, stages, [True, False, None])), "a STRING, b STRING, same BOOLEAN")
    same(frame, "interval_context(a, b, same)", labels.interval_context(F.col("a"), F.col("b"), F.col("same")))
    for label in STUDY.campaign_labels:
        assert spark.sql("SELECT campaign_stage(:label)", {"label": label}).first()[0] == labels.campaign_stage(label)
    assert spark.sql("SELECT campaign_stage('no such')").first()[0] is None


def test_source_combinations(spark):
    frame = spark.createDataFrame(list(product([True, False, None], repeat=3)), "t BOOLEAN, d BOOLEAN, s BOOLEAN")
    same(frame, "source_combination(t, d, s)", labels.source_combination(F.col("t"), F.col("d"), F.col("s")))


def test_calendar(spark):
    rows = spark.sql("SELECT * FROM campaign_calendar(NULL) ORDER BY campaign_rank").collect()
    assert [(r.campaign, r.first_day) for r in rows] == list(zip(STUDY.campaign_labels, STUDY.campaign_starts, strict=True))
    assert [r.last_day for r in rows] == [d - timedelta(days=1) for d in STUDY.campaign_starts[1:]] + [None]
    boosters = spark.sql("SELECT campaign FROM campaign_calendar('booster')").collect()
    assert [r.campaign for r in boosters] == [c for c in STUDY.campaign_labels if labels.campaign_stage(c) == labels.BOOSTER]


def test_another_study_takes_their_place(spark):
    register_functions(spark, flu_study())
    found = spark.sql("SELECT count(*) FROM campaign_calendar(NULL)").first()[0]
    assert found == len(flu_study().campaign_labels)


def test_no_python_in_the_plan(spark):
    plan = spark.sql("SELECT interval_bin(cast(id AS INT)), roundmid_any(id, 6) FROM range(9)")
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
