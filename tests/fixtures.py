"""Helpers of the tests, and small event tables with answers worked out by hand."""

from datetime import date

from jabcheck.functions.draws import MODULUS
from jabcheck.sources import schemas
from jabcheck.study import covid_study

RAW = dict(covid_study().products)


def day(text):
    return None if text is None else date.fromisoformat(text)


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def sorted_rows(frame):
    return sorted(rows_of(frame), key=repr)


def py_draw(key, salt):
    h = (key % MODULUS * 48271 + (key >> 31) % MODULUS * 16807 + salt * 69621 + 1) % MODULUS
    h = (h * h + salt * 16807 + 11) % MODULUS
    return (h * 48271 + 7) % MODULUS


def covid_events(spark):
    death = {4: "2021-09-05"}
    rows = [
        (1, "2020-01-15", "pfizer_original"),
        (1, "2020-12-10", "pfizer_original"),
        (1, "2021-01-04", "pfizer_original"),
        (2, "2020-05-01", "az_original"),
        (2, "2020-12-08", "moderna_original"),
        (2, "2021-03-02", "novavax"),
        (3, "2021-04-01", "az_original"),
        (3, "2021-04-01", "az_original"),
        (3, "2021-06-24", "az_original"),
        (4, "2021-05-01", "az_original"),
        (4, "2021-05-01", "pfizer_original"),
        (4, "2021-05-01", "pfizer_original"),
        (4, "2021-09-06", "pfizer_original"),
        (4, "2022-03-21", "pfizer_original"),
        (5, "1899-12-31", "pfizer_original"),
        (6, None, "pfizer_original"),
    ]
    return spark.createDataFrame(
        [(p, day(d), RAW[product], 50, day(death.get(p))) for p, d, product in rows], schemas.COVID_EVENTS
    )


def covid_registrations(spark):
    rows = [
        (1, "2020-11-01", None),
        (2, "2010-01-01", "2021-03-01"),
        (2, "2021-03-02", "2021-03-02"),
        (3, "2021-04-02", None),
        (4, "2000-01-01", None),
        (4, "2000-01-01", None),
    ]
    return spark.createDataFrame([(p, day(a), day(b)) for p, a, b in rows], schemas.COVID_REGISTRATIONS)


def flu_extracts(spark):
    table = [
        (1, "2020-09-01", 40),
        (1, "2020-09-01", 40),
        (1, "2020-09-01", 41),
        (1, "2020-10-10", 40),
        (2, "2021-08-31", 50),
        (3, None, 30),
    ]
    drug = [(1, "2020-09-01", 40), (2, "2021-09-05", 51)]
    snomed = [(1, "2020-10-17", 40), (2, "2021-08-25", 50), (4, "2020-12-01", 20)]
    return {
        "table": spark.createDataFrame([(p, day(d), "flu", a) for p, d, a in table], schemas.FLU_TABLE),
        "drug": spark.createDataFrame([(p, day(d), a) for p, d, a in drug], schemas.FLU_CODED),
        "snomed": spark.createDataFrame([(p, day(d), a) for p, d, a in snomed], schemas.FLU_CODED),
    }
