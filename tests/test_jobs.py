"""Whole jobs on files: records in, extracts, reports and counts out."""

import csv
import glob
import json
import os
import subprocess
import sys
from dataclasses import replace
from datetime import timedelta

import pytest
from fixtures import RAW, covid_events, covid_registrations, day, flu_extracts, rows_of

from jabcheck import __main__ as cli
from jabcheck.operators.clean import UnmappedProductsError
from jabcheck.plans.covid import extract_covid, report_covid
from jabcheck.plans.design import publish_design
from jabcheck.plans.flu import extract_flu, report_flu, upset_data
from jabcheck.sources import schemas
from jabcheck.sources.readers import SchemaError, read_codelist, read_source_counts, read_study_dates, read_table
from jabcheck.sources.writers import write_csv
from jabcheck.study import FLU_DMD_CODES, FLU_SNOMED_CODES, covid_study, flu_study


def csv_rows(path):
    (part,) = glob.glob(f"{path}/part-*.csv")
    with open(part, newline="") as handle:
        return list(csv.reader(handle))


def json_rows(path):
    (part,) = glob.glob(f"{path}/part-*")
    with open(part) as handle:
        found = json.load(handle)
    return found if isinstance(found, list) else [found]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    """Health-record tables with the cases that extraction must tell apart."""
    root = tmp_path_factory.mktemp("records")

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}")

    save(
        "patients",
        [(1, day("1950-02-28")), (2, day("2016-01-01")), (3, day("1990-06-15")), (4, day("1980-01-01"))],
        schemas.PATIENTS,
    )
    save(
        "vaccinations",
        [
            (1, day("2021-01-05"), "SARS-2 CORONAVIRUS", RAW["pfizer_original"]),
            (1, day("2021-10-01"), "INFLUENZA", "flu"),
            (2, day("2021-10-01"), "INFLUENZA", "flu"),
            (3, None, "SARS-2 CORONAVIRUS", RAW["az_original"]),
            (5, day("2021-02-01"), "SARS-2 CORONAVIRUS", None),
            (4, day("2021-02-01"), "MEASLES", "other"),
        ],
        schemas.VACCINATIONS,
    )
    save(
        "clinical_events",
        [(3, day("2021-10-02"), FLU_SNOMED_CODES[0]), (3, day("2021-10-02"), "123"), (4, None, FLU_SNOMED_CODES[-1])],
        schemas.CLINICAL_EVENTS,
    )
    save("medications", [(4, day("2020-11-11"), FLU_DMD_CODES[1]), (4, day("2020-11-11"), None)], schemas.MEDICATIONS)
    save(
        "practice_registrations",
        [(1, day("2000-01-01"), None), (4, day("2000-01-01"), None), (3, day("2000-01-01"), day("2001-01-01"))],
        schemas.PRACTICE_REGISTRATIONS,
    )
    save("ons_deaths", [(1, day("2022-01-01"))], schemas.DEATHS)
    return str(root)


def test_extract_covid(spark, records, tmp_path):
    extract_covid(spark, records, str(tmp_path))
    events = spark.read.schema(schemas.COVID_EVENTS).parquet(f"{tmp_path}/vaccinations")
    assert sorted(rows_of(events), key=repr) == [
        (1, day("2021-01-05"), RAW["pfizer_original"], 70, day("2022-01-01")),
        (3, None, RAW["az_original"], None, None),
        (5, day("2021-02-01"), None, None, None),
    ]
    periods = spark.read.schema(schemas.COVID_REGISTRATIONS).parquet(f"{tmp_path}/registrations")
    assert sorted(r.patient_id for r in periods.collect()) == [1, 3]


def test_extract_flu(spark, records, tmp_path):
    codelist = tmp_path / "codes.csv"
    codelist.write_text('code,term\n' + "\n".join(f'{c},"a, quoted term"' for c in FLU_DMD_CODES) + "\n")
    assert sorted(r.code for r in read_codelist(spark, str(codelist)).collect()) == sorted(FLU_DMD_CODES)
    extract_flu(spark, records, str(tmp_path), flu_study(), drug_codelist=str(codelist))
    read = lambda name: sorted(rows_of(spark.read.parquet(f"{tmp_path}/{name}")), key=repr)
    assert read("flu_vaccinations_table") == [(1, day("2021-10-01"), "flu", 71)]
    assert read("flu_vaccinations_SNOMED") == [(3, day("2021-10-02"), 31), (4, None, None)]
    assert read("flu_vaccinations_drug") == [(4, day("2020-11-11"), 40)]


@pytest.fixture(scope="module")
def covid_files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("covid")
    covid_events(spark).write.parquet(f"{root}/vaccinations")
    covid_registrations(spark).write.parquet(f"{root}/registrations")
    return str(root)


def test_report_covid(spark, covid_files, tmp_path):
    report_covid(spark, covid_files, str(tmp_path), covid_study())
    written = sorted(p.name for p in tmp_path.iterdir() if p.suffix == ".csv")
    names = [
        f"count_{n}"
        for n in (
            "campaign_noninterval_flags",
            "interval_campaign_transition",
            "interval_context",
            "interval_product_transition",
            "overall_noninterval_flags",
            "product_noninterval_flags",
        )
    ]
    assert written == sorted(f"{n}{suffix}.csv" for n in names for suffix in ("", "_unrounded"))
    table = csv_rows(tmp_path / "count_overall_noninterval_flags_unrounded.csv")
    assert table[0] == ["flag_type", "n_records", "n_patients", "denom_records_total", "denom_patients_total"]
    assert table[3] == ["flag_product_before_approval", "4", "3", "18", "5"]
    by_campaign = csv_rows(tmp_path / "count_campaign_noninterval_flags.csv")
    assert by_campaign[1] == ["Pre-2020-04-23", "flag_implausible_early_date", "5", "5", "NA", "NA"]
    assert by_campaign[-1][0] == "NA"


def test_report_covid_with_injected_faults(spark, tmp_path):
    study = covid_study()
    approved = [name for label, name in study.products if label in study.approvals]
    days = [day("2021-01-01") + timedelta(days=7 * (i // 60) + i % 60) for i in range(400)]
    rows = [(i % 60, d, approved[i % len(approved)], 50, None) for i, d in enumerate(days)]
    spark.createDataFrame(rows, schemas.COVID_EVENTS).write.parquet(f"{tmp_path}/in/vaccinations")
    covid_registrations(spark).write.parquet(f"{tmp_path}/in/registrations")
    report_covid(spark, f"{tmp_path}/in", f"{tmp_path}/out", study, inject_faults=True)
    flags = {r[0]: int(r[1]) for r in csv_rows(tmp_path / "out/count_overall_noninterval_flags_unrounded.csv")[1:]}
    assert len(flags) == 7 and all(n >= 5 for n in flags.values())
    bins = {r[1] for r in csv_rows(tmp_path / "out/count_interval_context_unrounded.csv")[1:]}
    assert len(bins) == 8


def test_unmapped_products_leave_no_staging(spark, covid_files, tmp_path):
    study = covid_study()
    fewer = replace(study, products=study.products[1:], approvals={})
    before = spark.catalog.listDatabases()
    with pytest.raises(UnmappedProductsError, match="1 .*unmapped_products.csv"):
        report_covid(spark, covid_files, str(tmp_path / "out"), fewer, staging_folder=str(tmp_path / "staging"))
    assert csv_rows(tmp_path / "out/unmapped_products.csv")[1][0].find("Comirnaty 30micrograms") > 0
    assert not list((tmp_path / "staging").iterdir())
    assert spark.catalog.listDatabases() == before


def test_flu_report_and_upset(spark, tmp_path):
    names = {"table": "flu_vaccinations_table", "drug": "flu_vaccinations_drug", "snomed": "flu_vaccinations_SNOMED"}
    for source, frame in flu_extracts(spark).items():
        frame.write.parquet(f"{tmp_path}/in/{names[source]}")
    report_flu(spark, f"{tmp_path}/in", f"{tmp_path}/out", flu_study())
    table = csv_rows(tmp_path / "out/table_flu_sources.csv")
    assert table[1:] == [
        ["Autumn 2020", "snomed only", "5", "15", "33.3", "5 (33.3%)"],
        ["Autumn 2020", "table + drug + snomed", "5", "15", "33.3", "5 (33.3%)"],
        ["Autumn 2020", "table + snomed", "5", "15", "33.3", "5 (33.3%)"],
        ["Autumn 2021", "drug only", "5", "5", "100", "5 (100%)"],
    ]
    counts = csv_rows(tmp_path / "out/upset_counts_campaign.csv")
    assert counts[0] == ["campaign", "table", "drug", "snomed", "n"]
    assert counts[1] == ["Autumn 2020", "FALSE", "FALSE", "TRUE", "5"]
    agreement = csv_rows(tmp_path / "out/table_date_agreement.csv")
    assert len(agreement) == 9 and agreement[-1][4:] == ["NaN", "0 / 0 (NaN%)"]
    upset_data(spark, f"{tmp_path}/out/upset_counts_campaign.csv", f"{tmp_path}/plots")
    assert csv_rows(tmp_path / "plots/upset_intersections.csv")[1] == ["Autumn 2020", "snomed only", "5", "1"]
    assert ["Autumn 2020", "snomed", "15"] in csv_rows(tmp_path / "plots/upset_set_sizes.csv")


def test_design_files(spark, tmp_path):
    publish_design(spark, flu_study(), str(tmp_path), "flu")
    (dates,) = json_rows(tmp_path / "study_dates_flu.json")
    assert dates == {"firstpossiblevax_date": "2005-10-01", "start_date": "2020-10-01", "end_date": "2026-03-31"}
    campaigns = json_rows(tmp_path / "campaign_info_flu.json")
    assert campaigns[0]["campaign_label"] == "Pre-2020" and "year" not in campaigns[0]
    assert campaigns[-1]["final_milestone_days"] == 153
    assert read_study_dates(spark, f"{tmp_path}/study_dates_flu.json", covid_study()).start == day("2020-10-01")
    pretty = tmp_path / "pretty.json"
    pretty.write_text(json.dumps({**dates, "end_date": "2027-01-31"}, indent=2))
    assert read_study_dates(spark, str(pretty), flu_study()).end == day("2027-01-31")


def test_csv_text(spark, tmp_path):
    rows = [("a,b", True, 1.0, None), ('say "x"', None, 33.3, 5)]
    write_csv(spark.createDataFrame(rows, "t STRING, b BOOLEAN, d DOUBLE, n BIGINT").coalesce(1), f"{tmp_path}/x.csv")
    assert csv_rows(tmp_path / "x.csv")[1:] == [["a,b", "TRUE", "1", "NA"], ['say "x"', "NA", "33.3", "5"]]


def test_command_line(spark, covid_files, tmp_path, monkeypatch):
    staging = str(tmp_path / "staging")
    cli.main(["report-covid", "--extracts", covid_files, "--out", str(tmp_path), "--staging", staging, "--threshold", "4"])
    assert len(list(tmp_path.glob("*.csv"))) == 12
    assert csv_rows(tmp_path / "count_overall_noninterval_flags.csv")[5][1:] == ["6", "2", "18", "6"]
    cli.main(["design-covid", "--out", f"{tmp_path}/design"])
    assert json_rows(tmp_path / "design/campaign_info_covid.json")[1]["final_milestone_days"] == 229
    with pytest.raises(SystemExit):
        cli.main(["report-covid"])


def test_report_covid_starts_in_a_session_without_settings(covid_files, tmp_path):
    (tmp_path / "conf").mkdir()
    command = [sys.executable, "-m", "jabcheck", "report-covid", "--extracts", covid_files, "--inject-faults", "--seed", "5"]
    paths = ["--out", f"{tmp_path}/out", "--staging", f"{tmp_path}/staging", "--buckets", "4"]
    env = os.environ | {"SPARK_CONF_DIR": f"{tmp_path}/conf", "PYSPARK_SUBMIT_ARGS": "--conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run(
        command + paths, env=env, cwd=os.path.dirname(os.path.dirname(cli.__file__)), capture_output=True, text=True, timeout=600
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(list((tmp_path / "out").glob("*.csv"))) == 12
    assert not list((tmp_path / "staging").iterdir())


def test_missing_columns_and_other_types_raise(spark, tmp_path):
    spark.createDataFrame([(1, "2020-01-01", "x")], "patient_id BIGINT, vax_date STRING, vaxproduct STRING").write.parquet(
        f"{tmp_path}/events"
    )
    with pytest.raises(SchemaError, match=r"vax_date date \(is string\), vax_product string \(is missing\)"):
        read_table(spark, f"{tmp_path}/events", "patient_id BIGINT, vax_date DATE, vax_product STRING")


def test_study_dates_must_be_whole(spark, tmp_path):
    file = tmp_path / "dates.json"
    for text in ('{"firstpossiblevax_date": "2020-01-01", "start_date": "2020-02-01"}', "{}"):
        file.write_text(text)
        with pytest.raises(SchemaError, match="end_date"):
            read_study_dates(spark, str(file), flu_study())
    file.write_text('{"firstpossiblevax_date": "2020-01-01", "start_date": "soon", "end_date": "2021-01-01"}')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_study_dates(spark, str(file), flu_study())


def test_any_codelist_column(spark, tmp_path):
    file = tmp_path / "codes.csv"
    file.write_text('id,snomed,term\n1,123456789012345678,"a, b"\n2,7,c\n3,,d\n')
    assert sorted(r.code for r in read_codelist(spark, str(file), "snomed").collect()) == ["123456789012345678", "7"]
    with pytest.raises(SchemaError, match="no column code"):
        read_codelist(spark, str(file))


def test_released_counts_are_read_by_name(spark, tmp_path):
    file = tmp_path / "counts.csv"
    file.write_text("campaign,snomed,drug,table,n\nA,TRUE,FALSE,FALSE,15\n")
    assert read_source_counts(spark, str(file)).first().asDict() == {
        "campaign": "A", "table": False, "drug": False, "snomed": True, "n": 15,
    }
    file.write_text("campaign,snomed,drug,table,n\nA,TRUE,FALSE,FALSE,many\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_source_counts(spark, str(file)).collect()


def test_a_second_row_of_a_patient_adds_no_event(spark):
    from jabcheck.operators import extract

    vaccinations = spark.createDataFrame([(1, day("2021-05-05"), "x")], "patient_id BIGINT, date DATE, product_name STRING")
    patients = spark.createDataFrame([(1, day("1990-01-01")), (1, day("1980-01-01"))], schemas.PATIENTS)
    deaths = spark.createDataFrame([(1, day("2022-01-01")), (1, day("2021-12-01"))], schemas.DEATHS)
    (row,) = extract.covid_events(vaccinations, patients, deaths).collect()
    assert (row.age, row.death_date) == (41, day("2021-12-01"))
