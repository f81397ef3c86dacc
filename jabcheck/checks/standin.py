"""Order and line-item tables read as if they were health records.

Customers are patients, shipped lines are vaccinations, brands are products. Dates and
lookups of the study are moved to the range of those tables. Joins carry no hints: Spark
broadcasts what it measures to be small and adaptive execution splits frequent keys.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jabcheck.functions.dates import age_on
from jabcheck.study import Campaign, Study, autumn_campaigns

END = date(2001, 12, 31)
CALENDAR_CLOSE = date(2002, 1, 1)
DEATH_DAY = date(2000, 1, 1)
N_PRODUCTS = 25
N_APPROVED = 20
FIRST_APPROVAL = date(1995, 12, 2)
APPROVAL_GAP = 45
MIN_AGE = 12
PERIOD_DAYS = 60
OPEN_PERIOD_EVERY = 1000
DISEASE = "F"
CODED_TYPES = ("PROMO", "SMALL")

CAMPAIGN_STARTS = (
    ("Pre-1995-04-23", "1900-01-01"),
    ("Pre-roll-out", "1995-04-23"),
    ("Primary series", "1995-12-08"),
    ("Autumn 1996", "1996-09-06"),
    ("Spring 1997", "1997-03-21"),
    ("Autumn 1997", "1997-08-29"),
    ("Spring 1998", "1998-04-03"),
    ("Autumn 1998", "1998-08-28"),
    ("Spring 1999", "1999-04-15"),
    ("Autumn 1999", "1999-09-30"),
    ("Spring 2000", "2000-03-31"),
    ("Autumn 2000", "2000-09-29"),
)


def covid_study(products: int = N_PRODUCTS) -> Study:
    starts = [(label, date.fromisoformat(day)) for label, day in CAMPAIGN_STARTS]
    return Study(
        first_possible=date(1995, 4, 23),
        start=date(1995, 12, 8),
        end=END,
        campaigns=tuple(
            Campaign(label, day, day + timedelta(days=200), day, day + timedelta(days=55)) for label, day in starts
        ),
        calendar_close=CALENDAR_CLOSE,
        products=tuple((f"brand_{k}", f"Brand#{k}") for k in range(1, products + 1)),
        approvals={
            f"brand_{k}": FIRST_APPROVAL + timedelta(days=(k - 1) * APPROVAL_GAP) for k in range(1, N_APPROVED + 1)
        },
        early_faults_from=date(1994, 1, 1),
    )


def flu_study() -> Study:
    return Study(
        first_possible=date(1995, 1, 1),
        start=date(1995, 9, 1),
        end=END,
        campaigns=autumn_campaigns(1995, 2000),
        calendar_close=CALENDAR_CLOSE,
    )


SCHEMAS = {
    "customer": "c_custkey BIGINT, c_acctbal DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_returnflag STRING, "
    "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_brand STRING, p_type STRING",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _born(key: Column) -> Column:
    return F.date_add(F.lit(date(1930, 1, 1)), F.pmod(key * 7919, F.lit(25000)).cast("int"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(key.alias("patient_id"), _born(key).alias("date_of_birth"))


def deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "customer")
        .where(F.col("c_acctbal") < 0)
        .select(F.col("c_custkey").alias("patient_id"), F.lit(DEATH_DAY).alias("date"))
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order starts a period of a few weeks; every thousandth order's is open."""
    start, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    end = F.when(key % OPEN_PERIOD_EVERY != 0, F.date_add(start, (key % PERIOD_DAYS).cast("int")))
    return _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("patient_id"),
        start.alias("registration_start_date"),
        end.alias("deregistration_date"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("patient_id")
    )
    return _table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")


def vaccinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vaccination records with the target disease, before any extraction."""
    brands = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product_name")
    )
    return (
        _lines(spark, sf_dir)
        .join(brands, "l_partkey")
        .select(
            "l_orderkey",
            "l_linenumber",
            "patient_id",
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_linestatus").alias("target_disease"),
            "product_name",
        )
    )


def vax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table of the COVID-19 style report, without person attributes."""
    return vaccinations(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "patient_id",
        F.col("date").alias("vax_date"),
        F.col("product_name").alias("vax_product"),
    )


def clinical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        "patient_id", F.col("l_shipdate").cast("date").alias("date"), F.col("l_partkey").alias("code")
    )


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "part").where(F.col("p_type").isin(*CODED_TYPES)).select(F.col("p_partkey").alias("code"))
    )


def urgent_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with an urgent order: a list to look records up in."""
    orders = _table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return orders.select(F.col("o_custkey").alias("patient_id")).distinct()


def flu_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three flu record sources as (patient_id, date)."""
    table = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").cast("date").alias("date")
    )
    lines = _lines(spark, sf_dir)
    coded = {
        name: lines.where(F.col("l_returnflag").isin(*flags)).select(
            "patient_id", F.col("l_shipdate").cast("date").alias("date")
        )
        for name, flags in (("drug", ("A", "N")), ("snomed", ("R",)))
    }
    return {"table": table, **coded}


def flu_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all three sources: patient_id, vax_date, source."""
    return _orders_and_lines(spark, sf_dir, {"A": "drug", "N": "drug", "R": "snomed"})


def four_source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four sources: orders, and lines by each of their flags."""
    return _orders_and_lines(spark, sf_dir, {"A": "drug", "N": "pharmacy", "R": "snomed"})


def _orders_and_lines(spark: SparkSession, sf_dir: str, source_of: dict[str, str]) -> DataFrame:
    """Orders as source ``table`` and lines tagged by flag, joined with their orders once."""
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").cast("date").alias("vax_date"), F.lit("table").alias("source")
    )
    cases = " ".join(f"WHEN '{flag}' THEN '{name}'" for flag, name in source_of.items())
    lines = _lines(spark, sf_dir).where(F.col("l_returnflag").isin(*source_of)).select(
        "patient_id", F.col("l_shipdate").cast("date").alias("vax_date"), F.expr(f"CASE l_returnflag {cases} END AS source")
    )
    return orders.unionByName(lines)


def keyed_vax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event table with a unique key: one vaccination per order, for fault injection."""
    key, patient, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    brand = F.concat(F.lit("Brand#"), (F.pmod(key, F.lit(N_PRODUCTS)) + 1).cast("string"))
    return _table(spark, sf_dir, "orders").select(
        key.alias("row_key"),
        patient.alias("patient_id"),
        day.alias("vax_date"),
        brand.alias("vax_product"),
        age_on(_born(patient), day).alias("age"),
    )
