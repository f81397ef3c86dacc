"""Shape of the physical plans that large inputs depend on."""

import re

import pytest
from pyspark.sql import functions as F

from jabcheck.checks.queries import QUERIES
from jabcheck.operators.staging import Staging, staging


@pytest.fixture(scope="module")
def plan_of(spark, small_dir):
    cache = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def plan(name):
        if name not in cache:
            cache[name] = QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        return cache[name]

    yield plan
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_and_no_python(plan_of, name):
    plan = plan_of(name)
    for operator in ("NestedLoop", "CartesianProduct", "PythonUDF", "MapInPandas", "FlatMapGroups", "ArrowEvalPython"):
        assert operator not in plan


@pytest.mark.parametrize(
    "name, shuffles_by_patient",
    [
        ("table1_overall_flags", 1),
        ("table3_product_flags", 1),
        ("table4_interval_context", 1),
        ("table6_product_transition", 1),
    ],
)
def test_one_shuffle_by_patient(plan_of, name, shuffles_by_patient):
    by_patient = re.findall(r"Exchange hashpartitioning\(patient_id#\d+L?, \d+\)", plan_of(name))
    assert len(by_patient) == shuffles_by_patient
    # besides, event rows are folded by the whole key; the other exchanges join the tables or carry sums
    folds = re.findall(r"Exchange hashpartitioning\(patient_id#\d+L?, vax_date#\d+[^)]*\)", plan_of(name))
    assert len(folds) == 1


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_records_are_unrolled_in_one_branch(spark, adaptive):
    from jabcheck.operators.counts import fold_rows, unroll_rows

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(10).withColumn("k", F.when(F.col("id") < 5, 1).otherwise(2))
        huge = fold_rows(rows, "k").withColumn("n_records", F.when(F.col("k") == 1, 200_001).otherwise(1))
        execution = unroll_rows(huge)._jdf.queryExecution()
        assert execution.toRdd().count() == 200_002
        assert execution.executedPlan().toString().count("Scan") <= execution.optimizedPlan().toString().count("Range") + 1
        assert "Union" not in execution.executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_source_summary_needs_no_unroll(plan_of):
    assert "explode" not in plan_of("flu_source_summary")


def test_staging_leaves_nothing(spark, tmp_path):
    with staging(spark, str(tmp_path)) as stage:
        stage.by_patient(stage.store(spark.range(9).withColumnRenamed("id", "patient_id")))
        assert list(tmp_path.rglob("*.parquet"))
    assert not list(tmp_path.iterdir())


def test_staging_falls_back_to_the_warehouse(spark, monkeypatch):
    get = type(spark.conf).get
    unset = lambda self, key, *default: None if key == "spark.checkpoint.dir" else get(self, key, *default)
    monkeypatch.setattr(type(spark.conf), "get", unset)
    assert Staging(spark).path.startswith(spark.conf.get("spark.sql.warehouse.dir"))



@pytest.mark.parametrize("name", ["table1_overall_flags", "table2_campaign_flags", "table4_interval_context"])
def test_distinct_patients_need_no_expand(plan_of, name):
    assert "Expand" not in plan_of(name)


def test_only_needed_columns_are_read(plan_of):
    columns = {c.split(":")[0] for s in re.findall(r"FileScan parquet \[([^\]]*)\]", plan_of("table1_overall_flags"))
               for c in re.sub(r"#\d+L?", "", s).split(",")}
    assert columns == {"l_orderkey", "l_partkey", "l_shipdate", "o_orderkey", "o_custkey", "p_partkey", "p_brand"}


def test_filters_reach_the_scan(plan_of):
    plan = plan_of("extract_events")
    assert re.search(r"PushedFilters: \[[^\]]*(EqualTo|In)\(l_linestatus", plan)


def test_staged_table_is_read_without_a_shuffle(spark):
    from pyspark.sql import Window as W

    rows = spark.range(1000).select((F.col("id") % 50).alias("patient_id"), F.current_date().alias("vax_date"), "id")
    with staging(spark) as stage:
        staged = stage.by_patient(rows.repartition("patient_id"))
        name = re.search(r"staging_\w+", staged._jdf.queryExecution().analyzed().toString()).group()
        window = W.partitionBy("patient_id").orderBy("vax_date")
        counted = staged.withColumn("n", F.row_number().over(window)).groupBy("patient_id").agg(F.max("n").alias("n"))
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
        assert {r.n for r in counted.collect()} == {20}
    assert name not in [d.name for d in spark.catalog.listDatabases()]


def test_a_frequent_code_is_split(spark):
    from jabcheck.operators.extract import with_code

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        noise = F.xxhash64("id")
        code = F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(noise, F.lit(50_000)))
        events = spark.range(0, 400_000, 1, 8).select(noise.alias("patient_id"), code.alias("code"))
        found = with_code(events, "code", spark.range(0, 50_000, 2).union(spark.range(7, 8)).toDF("code"))
        expected = events.where((F.col("code") == 7) | (F.col("code") % 2 == 0)).count()
        execution = found._jdf.queryExecution()
        assert execution.toRdd().count() == expected
        assert "SortMergeJoin(skew=true)" in execution.executedPlan().toString()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_one_task_by_patient_for_each_shuffle_partition(spark):
    from jabcheck.operators.flags import by_patient

    rows = by_patient(spark.range(1000).withColumnRenamed("id", "patient_id"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.select(F.spark_partition_id().alias("task")).distinct().count() == tasks > 1
    assert rows.groupBy("patient_id").count().count() == 1000


@pytest.mark.parametrize("name", ["flu_source_summary", "flu_dates_wide"])
def test_doses_of_a_source_move_by_patient_once(plan_of, name):
    plan = plan_of(name)
    assert len(re.findall(r"Exchange hashpartitioning\(patient_id#\d+L?, \d+\), REPARTITION_BY_NUM", plan)) == 1
    assert not re.search(r"Exchange hashpartitioning\([^)]*campaign_rank", plan)
