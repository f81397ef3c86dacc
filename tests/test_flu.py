import pytest
from fixtures import day, flu_extracts, rows_of, sorted_rows

from jabcheck.operators import crosssource, upset
from jabcheck.operators.clean import campaign_label
from jabcheck.study import flu_study

STUDY = flu_study()


@pytest.fixture(scope="module")
def records(spark):
    return crosssource.union_sources(**flu_extracts(spark)).cache()


@pytest.fixture(scope="module")
def counts(records):
    return crosssource.combination_counts(crosssource.source_presence(records, STUDY), STUDY).cache()


def test_source_summary(records):
    summary = crosssource.source_summary(records, STUDY).withColumn("campaign", campaign_label(STUDY))
    rows = {(r.source, r.patient_id, r.campaign): r for r in summary.collect()}
    first = rows[("table", 1, "Autumn 2020")]
    assert (first.n_vax, first.n_vax_including_exact_duplicates) == (3, 4)
    assert [str(d) for d in first.vax_dates_list] == ["2020-09-01", "2020-10-10"]
    assert not any(patient == 3 for _, patient, _ in rows)


def test_dates_side_by_side(records):
    wide = crosssource.dates_by_source(crosssource.source_summary(records, STUDY))
    assert wide.columns == ["patient_id", "campaign_rank", "table", "drug", "snomed"]
    row = wide.where("patient_id = 4").first()
    assert row.table is None and row.drug is None and len(row.snomed) == 1


def test_source_table(counts):
    assert rows_of(crosssource.source_table(counts, STUDY)) == [
        ("Autumn 2020", "snomed only", 5, 15, 33.3, "5 (33.3%)"),
        ("Autumn 2020", "table + drug + snomed", 5, 15, 33.3, "5 (33.3%)"),
        ("Autumn 2020", "table + snomed", 5, 15, 33.3, "5 (33.3%)"),
        ("Autumn 2021", "drug only", 5, 5, 100.0, "5 (100%)"),
    ]


def test_agreement_table(records):
    people = crosssource.agreement_counts(crosssource.date_agreement(records, STUDY))
    table = rows_of(crosssource.agreement_table(people, STUDY))
    text = {(r[0], r[1]): r[5] for r in table}
    assert text[("Autumn 2020", "Same day: Table vs Drug")] == "5 / 5 (100%)"
    assert text[("Autumn 2020", "Same day: Table vs SNOMED")] == "0 / 5 (0%)"
    assert text[("Autumn 2020", "Within 7 days: Table vs Drug")] == "5 / 5 (100%)"
    assert text[("Autumn 2020", "Within 7 days: Table vs SNOMED")] == "5 / 5 (100%)"
    assert {v for (campaign, _), v in text.items() if campaign == "Autumn 2021"} == {"0 / 0 (NaN%)"}


def test_counts_agree_with_presence(records, counts):
    people = crosssource.agreement_counts(crosssource.date_agreement(records, STUDY))
    assert sorted_rows(crosssource.round_counts(people, STUDY)) == sorted_rows(counts)


def test_agreement_invariants(spark, small_dir):
    from jabcheck.checks import standin

    records = standin.flu_records(spark, small_dir)
    agreed = crosssource.date_agreement(records, standin.flu_study()).cache()
    for other in ("drug", "snomed"):
        same, near = f"same_day_table_{other}", f"within_7d_table_{other}"
        assert agreed.where(f"{same} AND NOT {near}").count() == 0
        assert agreed.where(f"({same} IS NULL) <> ({near} IS NULL)").count() == 0
    for within, prefix in ((0, "same_day"), (7, "within_7d")):
        columns = ["patient_id", "campaign_rank", f"{prefix}_table_drug", f"{prefix}_table_snomed"]
        by_band = crosssource.date_agreement_by_band(records, standin.flu_study(), within)
        assert sorted_rows(agreed.select(*columns)) == sorted_rows(by_band.select(*columns))


def test_days_before_the_calendar_form_their_own_campaign(spark):

    rows = [(1, day("1899-12-01"), 5, "table"), (1, day("1899-12-05"), 5, "drug")]
    records = spark.createDataFrame(rows, "patient_id BIGINT, vax_date DATE, age INT, source STRING")
    (row,) = crosssource.date_agreement(records, STUDY).collect()
    assert row.campaign_rank is None and row.within_7d_table_drug and not row.same_day_table_drug
    (band,) = crosssource.date_agreement_by_band(records, STUDY, 7).collect()
    assert band.campaign_rank is None and band.within_7d_table_drug


def test_upset_numbers(counts):
    released = crosssource.upset_table(counts, STUDY)
    people = upset.uncount(released)
    assert people.count() == 20
    ranked = rows_of(upset.intersections(released).where("campaign = 'Autumn 2020'").orderBy("rank"))
    assert [r[1:] for r in ranked] == [("snomed only", 5, 1), ("table + drug + snomed", 5, 2), ("table + snomed", 5, 3)]
    sizes = {r[1]: r[2] for r in rows_of(upset.set_sizes(released)) if r[0] == "Autumn 2020"}
    assert sizes == {"table": 10, "drug": 5, "snomed": 15}
