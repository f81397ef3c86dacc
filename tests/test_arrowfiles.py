"""Arrow files as a source and a sink: splits, pruning, pushed dates, strict schemas, commits."""

import glob
import os
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from fixtures import covid_events, covid_registrations, flu_extracts, sorted_rows
from pyspark.sql import functions as F

from jabcheck.plans.covid import report_covid
from jabcheck.plans.flu import report_flu
from jabcheck.sources import arrowfiles, extracts, schemas
from jabcheck.sources.arrowfiles import read_arrow, write_arrow
from jabcheck.study import covid_study, flu_study

ROWS = 50_000
SCHEMA = "patient_id BIGINT, vax_date DATE, vax_product STRING, age INT"


@pytest.fixture(scope="module")
def one_file(tmp_path_factory):
    """A file of 50 batches with text as a dictionary, as written elsewhere, and a column nobody reads."""
    path = f"{tmp_path_factory.mktemp('feather')}/events.arrow"
    days = [None if i % 97 == 0 else date(2020, 1, 1) + timedelta(days=i % 1500) for i in range(ROWS)]
    products = [None if i % 31 == 0 else f"product {i % 7}" for i in range(ROWS)]
    table = pa.table(
        {
            "unread": pa.array(range(ROWS), pa.float64()),
            "age": pa.array([i % 90 for i in range(ROWS)], pa.int32()),
            "vax_product": pa.array(products).dictionary_encode(),
            "vax_date": pa.array(days, pa.date32()),
            "patient_id": pa.array([i // 3 for i in range(ROWS)], pa.int64()),
        }
    )
    feather.write_feather(table, path, chunksize=1000, compression="lz4")
    rows = list(zip((i // 3 for i in range(ROWS)), days, products, (i % 90 for i in range(ROWS)), strict=True))
    return path, rows


def test_one_file_is_read_by_many_tasks(spark, one_file):
    path, rows = one_file
    size = os.path.getsize(path)
    events = read_arrow(spark, path, SCHEMA, split_bytes=str(size // 10))
    assert events.rdd.getNumPartitions() >= 10
    per_task = [r["count"] for r in events.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 10 and max(per_task) <= ROWS / 5
    assert sorted_rows(events) == sorted(rows, key=repr)


def test_dates_are_compared_by_the_reader(spark, one_file):
    path, rows = one_file
    first, last = date(2020, 3, 1), date(2020, 3, 31)
    events = read_arrow(spark, path, SCHEMA)
    chosen = events.where((F.col("vax_date") >= F.lit(first)) & (F.col("vax_date") <= F.lit(last)))
    assert sorted_rows(chosen) == sorted((r for r in rows if r[1] and first <= r[1] <= last), key=repr)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "18322" not in plan.split("BatchScan")[0]  # neither bound is left to a filter above the scan
    assert ">=" not in plan.split("BatchScan")[0]
    after = events.where((F.col("vax_date") > F.lit(first)) & (F.col("age") == 7))
    assert sorted_rows(after) == sorted((r for r in rows if r[1] and r[1] > first and r[3] == 7), key=repr)


def test_equal_day_and_missing_days(spark, one_file):
    path, rows = one_file
    events = read_arrow(spark, path, SCHEMA)
    day = date(2021, 2, 3)
    assert sorted_rows(events.where(F.col("vax_date") == F.lit(day))) == sorted((r for r in rows if r[1] == day), key=repr)
    assert sorted_rows(events.where("vax_date IS NULL")) == sorted((r for r in rows if r[1] is None), key=repr)


@pytest.mark.parametrize("schema", ["patient_id BIGINT, dose INT", "patient_id INT", "vax_date STRING"])
def test_other_schemas_raise(spark, one_file, schema):
    with pytest.raises(Exception, match="lacks columns"):
        read_arrow(spark, one_file[0], schema).collect()


def test_schema_of_the_file(spark, one_file):
    spark.dataSource.register(arrowfiles.ArrowFiles)
    found = spark.read.format(arrowfiles.FORMAT).load(one_file[0])
    assert dict(found.dtypes)["vax_product"] == "string" and found.count() == ROWS


def test_written_rows_come_back_in_batches(spark, tmp_path, one_file):
    events = read_arrow(spark, one_file[0], SCHEMA).repartition(3)
    write_arrow(events, f"{tmp_path}/out", batch_rows="4000")
    files = glob.glob(f"{tmp_path}/out/*")
    assert len(files) == 3 and all(f.endswith(".arrow") for f in files)
    for file in files:
        sizes = [b.num_rows for b in (pa.ipc.open_file(file).get_batch(i) for i in range(pa.ipc.open_file(file).num_record_batches))]
        assert set(sizes[:-1]) == {4000} and 0 < sizes[-1] <= 4000
    assert sorted_rows(read_arrow(spark, f"{tmp_path}/out", SCHEMA)) == sorted_rows(events)
    write_arrow(events.where("age = 3"), f"{tmp_path}/out")
    assert sorted_rows(read_arrow(spark, f"{tmp_path}/out", SCHEMA)) == sorted_rows(events.where("age = 3"))


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    write_arrow(spark.range(5), f"{tmp_path}/out")
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        write_arrow(broken, f"{tmp_path}/out")
    assert sorted_rows(read_arrow(spark, f"{tmp_path}/out", "id BIGINT")) == [(i,) for i in range(5)]
    assert not glob.glob(f"{tmp_path}/out/_unfinished*")


def test_empty_tables(spark, tmp_path):
    write_arrow(spark.range(0), f"{tmp_path}/out")
    assert read_arrow(spark, f"{tmp_path}/out", "id BIGINT").count() == 0
    with pytest.raises(Exception, match="lacks columns"):
        read_arrow(spark, f"{tmp_path}/out", "id STRING").count()


def test_reports_from_arrow_equal_those_from_parquet(spark, tmp_path):
    for kind in extracts.FORMATS:
        folder = f"{tmp_path}/{kind}"
        extracts.write_extract(covid_events(spark), folder, "vaccinations", kind)
        extracts.write_extract(covid_registrations(spark), folder, "registrations", kind)
        for name, frame in flu_extracts(spark).items():
            shown = {"snomed": "SNOMED"}.get(name, name)
            extracts.write_extract(frame, folder, f"flu_vaccinations_{shown}", kind)
        out = f"{tmp_path}/report-{kind}"
        report_covid(spark, folder, f"{out}/covid", covid_study(), staging_folder=f"{tmp_path}/staging", as_set=True, file_format=kind)
        report_flu(spark, folder, f"{out}/flu", flu_study(), file_format=kind)
    texts = [
        {os.path.relpath(f, f"{tmp_path}/report-{kind}"): open(f).read() for f in glob.glob(f"{tmp_path}/report-{kind}/covid/*.csv")}
        | {
            os.path.basename(os.path.dirname(f)): open(f).read()
            for f in glob.glob(f"{tmp_path}/report-{kind}/flu/*.csv/part-*.csv")
        }
        for kind in extracts.FORMATS
    ]
    assert len(texts[0]) == 15 and texts[0] == texts[1]
    assert schemas.COVID_EVENTS
