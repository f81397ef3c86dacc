"""The clustered layout, tables kept up by deltas, and publication of whole sets."""

import json
import random
from collections import Counter
from datetime import date, timedelta

import pytest
from fixtures import RAW, covid_events, covid_registrations, day, rows_of, sorted_rows
from pyspark.sql import functions as F

from jabcheck.operators import distincts, summaries, upkeep
from jabcheck.operators.staging import staging
from jabcheck.plans.covid import report_covid, report_tables
from jabcheck.sources import layout, publish, schemas
from jabcheck.sources.readers import SchemaError, read_table
from jabcheck.study import covid_study

STUDY = covid_study()
PRODUCTS = list(RAW.values())[:6]


def many_events(spark, n=600):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        patient = rng.choice([None, 1, 1, 1, *range(2, 60)])
        when = date(2020, 1, 1) + timedelta(days=rng.randrange(1500)) if rng.random() > 0.05 else None
        death = day("2023-01-01") if patient and patient % 9 == 0 else None
        rows.append((patient, when, rng.choice(PRODUCTS), 40, death, i))
    rows += [(r[0], r[1], r[2], r[3], r[4], n + i) for i, r in enumerate(rows[:50])]
    return spark.createDataFrame(rows, f"{schemas.COVID_EVENTS}, n INT")


def periods(spark):
    rows = [(p, day("2019-01-01") if p % 4 else day("2021-06-01"), None if p % 3 else day("2022-06-01")) for p in range(1, 60)]
    return spark.createDataFrame(rows, schemas.COVID_REGISTRATIONS)


# --- layout


def test_clustered_rows_come_back(spark, tmp_path):
    events = many_events(spark).drop("n")
    layout.write_clustered(events, f"{tmp_path}/e")
    assert sorted_rows(layout.read_clustered(spark, f"{tmp_path}/e", schemas.COVID_EVENTS)) == sorted_rows(events)
    assert sorted_rows(read_table(spark, f"{tmp_path}/e", schemas.COVID_EVENTS)) == sorted_rows(events)


def test_bounds_of_days_and_patients(spark, tmp_path):
    events = many_events(spark).drop("n")
    layout.write_clustered(events, f"{tmp_path}/e")
    bounds = {"first": date(2021, 3, 15), "last": date(2021, 9, 2)}
    wanted = events.where(F.col("vax_date").between(F.lit(bounds["first"]), F.lit(bounds["last"])))
    got = layout.read_clustered(spark, f"{tmp_path}/e", schemas.COVID_EVENTS, **bounds)
    assert sorted_rows(got) == sorted_rows(wanted) and wanted.count()
    some = layout.read_clustered(spark, f"{tmp_path}/e", schemas.COVID_EVENTS, patients=(5, 9), **bounds)
    assert sorted_rows(some) == sorted_rows(wanted.where("patient_id between 5 and 9"))
    for rank in range(len(STUDY.campaign_starts)):
        first, last = layout.campaign_days(STUDY, rank)
        one = layout.read_campaign(spark, f"{tmp_path}/e", schemas.COVID_EVENTS, STUDY, rank)
        assert sorted_rows(one) == sorted_rows(events.where(F.col("vax_date").between(F.lit(first), F.lit(last))))


def test_one_campaign_reads_its_months_only(spark, tmp_path):
    layout.write_clustered(many_events(spark).drop("n"), f"{tmp_path}/e")
    one = layout.read_campaign(spark, f"{tmp_path}/e", schemas.COVID_EVENTS, STUDY, 4, patients=(5, 9))
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = one._jdf.queryExecution().executedPlan().toString()
    (partitions,) = [x for x in plan.split("\n") if "PartitionFilters" in x]
    assert f"{layout.MONTH}" in partitions.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(patient_id,5)" in partitions and "LessThanOrEqual(patient_id,9)" in partitions
    read = {r[0].split("=")[1].split("/")[0] for r in one.select(F.input_file_name()).collect()}
    first, last = layout.campaign_days(STUDY, 4)
    assert read and all(first.replace(day=1) <= date.fromisoformat(m) <= last for m in read)


def test_layout_needs_its_columns(spark, tmp_path):
    many_events(spark).drop("n").write.parquet(f"{tmp_path}/plain")
    with pytest.raises(SchemaError, match="event_month"):
        layout.read_clustered(spark, f"{tmp_path}/plain", schemas.COVID_EVENTS)
    layout.write_clustered(many_events(spark).drop("n", "age"), f"{tmp_path}/e")
    with pytest.raises(SchemaError, match="age"):
        layout.read_clustered(spark, f"{tmp_path}/e", schemas.COVID_EVENTS)


# --- upkeep


@pytest.mark.parametrize("split", ["n % 3 = 0", "vax_date < date'2022-01-01'", "patient_id = 1", "false", "n < 3"])
def test_deltas_equal_one_extract(spark, split):
    events, registrations = many_events(spark), periods(spark)
    later = F.coalesce(F.expr(split), F.lit(False))
    with staging(spark) as stage:
        whole = upkeep.first_state(events, registrations, STUDY, stage)
        state = upkeep.first_state(events.where(~later), registrations, STUDY, stage)
        half = F.col("n") % 2 == 0
        for delta in (events.where(later & half), events.where(later & ~half)):
            state = upkeep.with_delta(state, delta, registrations, STUDY, stage)
        columns = whole.days.columns
        assert sorted_rows(state.days.select(*columns)) == sorted_rows(whole.days)
        assert Counter(rows_of(state.gaps)) == Counter(rows_of(whole.gaps.select(*state.gaps.columns)))
        expected = report_tables(whole.days, STUDY, stage)
        assert rows_of(summaries.interval_contexts(state.gaps, STUDY)) == rows_of(expected["count_interval_context"])
        assert rows_of(summaries.campaign_flags(state.days, STUDY)) == rows_of(expected["count_campaign_noninterval_flags"])


def test_untouched_patients_are_not_worked_out_again(spark, monkeypatch):
    events, registrations = many_events(spark), periods(spark)
    seen = []
    flagged = upkeep._flagged
    monkeypatch.setattr(upkeep, "_flagged", lambda counted, *a: seen.append({r.patient_id for r in counted.collect()}) or flagged(counted, *a))
    with staging(spark) as stage:
        state = upkeep.first_state(events.where("patient_id <> 7"), registrations, STUDY, stage)
        upkeep.with_delta(state, events.where("patient_id = 7"), registrations, STUDY, stage)
    assert seen[1] == {7}


# --- bitmaps


def test_bitmaps_count_patients_exactly(spark):
    events, registrations = many_events(spark), periods(spark)
    with staging(spark) as stage:
        days = upkeep.first_state(events, registrations, STUDY, stage).days
        bitmaps = stage.store(distincts.flag_bitmaps(days, stage))
        tables = report_tables(days, STUDY, stage)
        assert rows_of(distincts.overall_flags(bitmaps)) == rows_of(tables["count_overall_noninterval_flags"])
        assert rows_of(distincts.product_flags(bitmaps, STUDY)) == rows_of(tables["count_product_noninterval_flags"])
        assert rows_of(distincts.campaign_flags(bitmaps, STUDY)) == rows_of(tables["count_campaign_noninterval_flags"])
        per_flag = days.where("flag_same_day_multiple").agg(F.countDistinct(F.coalesce("patient_id", F.lit(-1)))).first()[0]
        (got,) = [r.n_patients for r in distincts.rolled_up(bitmaps, "measure").collect() if r.measure == "flag_same_day_multiple"]
        assert got == per_flag


def test_patients_get_numbers_without_gaps(spark):
    ids = [None, *range(-40, 70_000, 3)]
    with staging(spark) as stage:
        frame = spark.createDataFrame([(i,) for i in ids] * 2, "patient_id BIGINT")
        got = sorted((r.number, r.patient_id) for r in distincts.numbered_patients(frame, stage).collect())
    assert [n for n, _ in got] == list(range(1, len(ids) + 1)) and [i for _, i in got] == ids


# --- publication


def test_a_stopped_report_leaves_the_old_set(spark, tmp_path, monkeypatch):
    covid_events(spark).write.parquet(f"{tmp_path}/in/vaccinations")
    covid_registrations(spark).write.parquet(f"{tmp_path}/in/registrations")
    out = tmp_path / "set"
    report_covid(spark, f"{tmp_path}/in", str(out), STUDY, as_set=True)
    old = {p.name: p.read_text() for p in out.iterdir() if not p.name.startswith(".")}
    assert len(old) == 13 and all(p.is_file() for p in out.iterdir())
    listed = json.loads(old["manifest.json"])["tables"]
    assert {x["file"]: x["rows"] for x in listed} == {n: len(t.splitlines()) - 1 for n, t in old.items() if n.endswith(".csv")}

    made = []
    write = publish.write_csv

    def dies(table, path):
        made.append(path)
        if len(made) == 4:
            raise RuntimeError("stopped")
        write(table, path)

    monkeypatch.setattr(publish, "write_csv", dies)
    with pytest.raises(RuntimeError, match="stopped"):
        report_covid(spark, f"{tmp_path}/in", str(out), STUDY, as_set=True)
    assert {p.name: p.read_text() for p in out.iterdir() if not p.name.startswith(".")} == old
    monkeypatch.setattr(publish, "write_csv", write)
    report_covid(spark, f"{tmp_path}/in", str(out), STUDY, as_set=True)
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("set")] == ["set"]


def test_a_set_is_recovered_between_its_renames(spark, tmp_path):
    table = lambda n: [("t", spark.range(n).toDF("n"))]
    out = tmp_path / "set"
    publish.publish(spark, table(2), str(out))
    out.rename(tmp_path / "set.previous-x")
    publish.recover(spark, str(out))
    assert (out / "t.csv").read_text() == "n\n0\n1\n"
    publish.publish(spark, table(3), f"{tmp_path}/other")
    out.rename(tmp_path / "set.previous-x")
    (tmp_path / "other").rename(tmp_path / "set.next-y")
    publish.recover(spark, str(out))
    assert (out / "t.csv").read_text() == "n\n0\n1\n2\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["set"]
    (tmp_path / "full").mkdir()
    (tmp_path / "full/own.txt").write_text("x")
    with pytest.raises(ValueError, match="no publication"):
        publish.publish(spark, table(1), f"{tmp_path}/full")


def test_state_is_dealt_by_patient_before_it_is_stored(spark):
    events = many_events(spark)
    with staging(spark) as stage:
        state = upkeep.first_state(events.where("n % 2 = 0"), periods(spark), STUDY, stage)
        state = upkeep.with_delta(state, events.where("n % 2 = 1 and patient_id < 9"), periods(spark), STUDY, stage)
        for rows in (state.days, state.gaps):  # so each bucket is written, and sorted, by one task
            assert len(rows.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
            assert rows.select("patient_id").distinct().count() > 9
