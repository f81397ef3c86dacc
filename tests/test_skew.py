"""One patient or one group of copies holding a large share of all rows."""

from datetime import date

import pytest
from fixtures import rows_of, sorted_rows
from pyspark.sql import functions as F

from jabcheck.checks import standin
from jabcheck.operators import crosssource, flags, intervals, perturb, registration, summaries
from jabcheck.operators.counts import CHUNK, unroll_rows
from jabcheck.operators.skew import join_facts
from jabcheck.operators.staging import session_staging
from jabcheck.study import flu_study

STUDY = standin.covid_study()
COPIES = 300_000


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows are copies of one record, a third belong to one patient."""
    n = COPIES
    ids = spark.range(3 * n)
    days_in = F.pmod(F.xxhash64("id"), F.lit(2500)).cast("int")
    spread = F.date_add(F.lit(date(1995, 1, 1)), days_in)
    return ids.select(
        F.when(F.col("id") < n, 1).when(F.col("id") < 2 * n, 2).otherwise(F.col("id") % 5000 + 10).alias("patient_id"),
        F.when(F.col("id") < n, F.lit(date(1999, 5, 5))).otherwise(spread).alias("vax_date"),
        F.when(F.col("id") < n, F.lit("Brand#3"))
        .otherwise(F.concat(F.lit("Brand#"), (F.col("id") % 25 + 1).cast("string")))
        .alias("vax_product"),
        F.lit(None).cast("date").alias("death_date"),
    )


def test_patient_groups_are_bounded_by_days_and_products(skewed):
    days = flags.day_products(skewed, STUDY)
    largest = days.groupBy("patient_id").count().agg(F.max("count")).first()[0]
    assert largest <= 2500 * 25
    assert days.where("patient_id = 1").collect()[0].n_records == COPIES
    assert days.agg(F.sum("n_records")).first()[0] == 3 * COPIES


def test_tables_count_every_copy(skewed):
    overall = {r[0]: r for r in rows_of(summaries.overall_flags(flags.flagged_days(skewed, STUDY)))}
    exact = skewed.groupBy("patient_id", "vax_date").count().where("count > 1")
    records, patients = exact.agg(F.sum("count"), F.count_distinct("patient_id")).first()
    assert overall["flag_same_day_multiple"][1:3] == (records, patients)


def test_records_are_unrolled_in_full(skewed):
    long = flags.long_flags(flags.flagged_days(skewed, STUDY), STUDY)
    got = long.where("patient_id = 1").groupBy("flag_type").count()
    assert sorted(rows_of(got)) == [("flag_same_day_multiple", COPIES), ("flag_same_day_same_product", COPIES)]
    periods = skewed.sparkSession.createDataFrame(
        [(1, date(1999, 1, 1), None)],
        "patient_id BIGINT, registration_start_date DATE, deregistration_date DATE",
    )
    assert registration.active_events(skewed, periods).count() == COPIES


def test_intervals_of_a_busy_patient(skewed):
    gaps = intervals.dose_gaps(intervals.single_record_days(skewed, STUDY))
    single = skewed.groupBy("patient_id", "vax_date").count().where("count = 1")
    later = single.where(F.col("vax_date") >= STUDY.campaign_starts[1])
    per_patient = later.groupBy("patient_id").count()
    assert gaps.count() == per_patient.agg(F.sum(F.col("count") - 1)).first()[0]


def test_sources_of_a_busy_patient(skewed):
    source = F.element_at(F.array(F.lit("table"), F.lit("drug"), F.lit("snomed")), (F.rand(1) * 3).cast("int") + 1)
    records = skewed.select("patient_id", "vax_date", F.lit(1).alias("age"), source.alias("source"))
    agreed = crosssource.date_agreement(records, flu_study())
    assert agreed.where("patient_id = 1").first().same_day_table_drug
    summary = crosssource.source_summary(records, flu_study())
    total = summary.agg(F.sum("n_vax_including_exact_duplicates")).first()[0]
    assert total == 3 * COPIES


def test_unroll_rows(spark):
    counts = spark.createDataFrame(
        [("a", 0), ("b", 1), ("c", CHUNK), ("d", 2 * CHUNK + 1), ("e", -3), ("f", None)], "k STRING, n BIGINT"
    )
    got = {r.k: r["count"] for r in unroll_rows(counts, "n").groupBy("k").count().collect()}
    assert got == {"b": 1, "c": CHUNK, "d": 2 * CHUNK + 1}
    assert unroll_rows(counts, "n").columns == ["k"]


def test_join_facts_equals_plain_join_and_keeps_null_keys(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 > 0, F.col("id")).alias("k"), F.col("id").alias("v")
    )
    facts = rows.groupBy("k").agg(F.max("v").alias("top"))
    got = join_facts(rows, facts, ["k"], session_staging(spark))
    renamed = facts.withColumnRenamed("k", "k2")
    expected = rows.join(renamed, rows["k"].eqNullSafe(renamed["k2"])).select("k", "v", "top")
    assert sorted_rows(got.select("k", "v", "top")) == sorted_rows(expected)
    assert got.count() == 20_000 and got.where("k IS NULL AND top IS NULL").count() == 0


@pytest.mark.parametrize("share", [0.0009, 0.33])
def test_any_key_is_split(spark, share):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "400",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        n = 1_000_000
        key = F.when(F.col("id") < int(n * share), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(300_000)))
        rows = spark.range(0, n, 1, 8).select(key.alias("k"), F.col("id").alias("v"))
        joined = join_facts(rows, rows.groupBy("k").agg(F.max("v").alias("top")), ["k"], session_staging(spark))
        execution = joined._jdf.queryExecution()
        assert execution.toRdd().count() == n
        assert "skew=true" in execution.executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_ages_of_a_busy_patient(skewed):
    rows = skewed.withColumn("row_key", F.monotonically_increasing_id()).withColumn("age", F.lit(40))
    aged = perturb.recompute_age(rows, ["row_key"], session_staging(skewed.sparkSession))
    assert aged.count() == 3 * COPIES
    span = aged.where("patient_id = 2").agg(F.min("age"), F.max("age")).first()
    assert span[0] == 40 and span[1] == 46


def test_rows_without_a_patient_keep_an_age(spark):
    rows = spark.createDataFrame(
        [(1, None, date(2000, 1, 1), 30), (2, None, date(2002, 1, 1), 5), (3, 8, date(2001, 1, 1), 40)],
        "row_key BIGINT, patient_id BIGINT, vax_date DATE, age INT",
    )
    aged = perturb.recompute_age(rows, ["row_key"], session_staging(spark))
    assert {r.row_key: r.age for r in aged.collect()} == {1: 30, 2: 32, 3: 40}
