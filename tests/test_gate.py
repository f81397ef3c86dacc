"""The gate on product names within the write of the days, and the guard on staging folders."""

from types import SimpleNamespace

import pytest
from fixtures import covid_events, covid_registrations, day
from pyspark.sql import functions as F

from jabcheck.operators import staging as staged
from jabcheck.operators.clean import UnmappedProductsError, watched
from jabcheck.plans.covid import flagged_with_active, report_covid
from jabcheck.sources import schemas
from jabcheck.sources.writers import write_extract
from jabcheck.study import covid_study

STUDY = covid_study()


def with_unknown(spark):
    strange = spark.createDataFrame([(9, day("2021-05-01"), name, 1, None) for name in ("x", "x", "y", None)], schemas.COVID_EVENTS)
    return covid_events(spark).unionByName(strange)


@pytest.mark.parametrize("events, unknown", [(covid_events, 0), (with_unknown, 4)])
def test_one_job_writes_and_counts(spark, tmp_path, events, unknown):
    days, seen = watched(flagged_with_active(events(spark), covid_registrations(spark), STUDY), STUDY)
    with staged.staging(spark, str(tmp_path)) as stage:
        stored = stage.by_patient(days)
        assert seen.get == {"n_records": events(spark).where("vax_date IS NOT NULL").count(), "n_unmapped": unknown}
        assert stored.agg(F.sum("n_records")).first()[0] == seen.get["n_records"]


def test_no_events(spark, tmp_path):
    days, seen = watched(flagged_with_active(covid_events(spark).limit(0), covid_registrations(spark), STUDY), STUDY)
    with staged.staging(spark, str(tmp_path)) as stage:
        stage.by_patient(days)
        assert seen.get == {"n_records": 0, "n_unmapped": 0}


def test_unknown_names_stop_the_report(spark, tmp_path):
    write_extract(with_unknown(spark), f"{tmp_path}/e/vaccinations")
    write_extract(covid_registrations(spark), f"{tmp_path}/e/registrations")
    with pytest.raises(UnmappedProductsError, match="3 "):
        report_covid(spark, f"{tmp_path}/e", f"{tmp_path}/out", STUDY, staging_folder=f"{tmp_path}/s")
    listed = spark.read.csv(f"{tmp_path}/out/unmapped_products.csv", header=True)
    assert {(r[0], r[1]) for r in listed.collect()} == {("x", "2"), ("y", "1"), ("NA", "1")}


class Elsewhere:
    """A session whose executors run on other machines."""

    def __init__(self, spark, master, conf):
        self._context = SimpleNamespace(master=master, _jvm=spark.sparkContext._jvm)
        self._conf = conf

    sparkContext = property(lambda self: self._context)  # noqa: N815
    conf = property(lambda self: SimpleNamespace(get=lambda name, default=None: self._conf.get(name, default)))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_a_local_warehouse_is_refused_on_a_cluster(spark, tmp_path, master):
    local = {"spark.sql.warehouse.dir": f"file:{tmp_path}/w"}
    with pytest.raises(ValueError, match="shared"):
        staged.Staging(Elsewhere(spark, master, local))
    named = staged.Staging(Elsewhere(spark, master, local | {"spark.checkpoint.dir": f"file:{tmp_path}/mounted"}))
    assert named.path.startswith(f"file:{tmp_path}/mounted/")
    assert staged.Staging(Elsewhere(spark, master, local), f"{tmp_path}/given").path.startswith(f"{tmp_path}/given/")


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_local_warehouse_serves_a_local_master(spark, tmp_path, master):
    assert staged.Staging(Elsewhere(spark, master, {"spark.sql.warehouse.dir": f"{tmp_path}/w"})).path.startswith(f"{tmp_path}/w/")
