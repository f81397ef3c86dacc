"""Event tables laid out by month and patient, so that a report reads only what it needs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jabcheck.sources.readers import SchemaError
from jabcheck.study import Study

#: The partition column: the first day of the month of the event; events without a date have none.
MONTH = "event_month"


def write_clustered(events: DataFrame, path: str, *, day: str = "vax_date", key: str = "patient_id") -> None:
    """Write ``events`` as Parquet, one folder a month and sorted by patient inside.

    Rows are dealt by ranges of month, patient, day and row, so a file holds a narrow range of
    patients, and neither a busy month, nor a busy patient, nor many equal rows are one task's.
    Sorted files give row groups with narrow ranges of patients.
    """
    if MONTH in events.columns:
        raise ValueError(f"the column {MONTH} belongs to the layout")
    rows = events.withColumn(MONTH, F.trunc(day, "month"))
    place = F.monotonically_increasing_id()
    dealt = rows.withColumn("_row", place).repartitionByRange(MONTH, key, day, "_row")
    dealt.sortWithinPartitions(MONTH, key, day).drop("_row").write.mode("overwrite").partitionBy(MONTH).parquet(path)


def read_clustered(
    spark: SparkSession,
    path: str,
    schema: str,
    *,
    day: str = "vax_date",
    key: str = "patient_id",
    first: date | None = None,
    last: date | None = None,
    patients: tuple[int, int] | None = None,
) -> DataFrame:
    """The columns of ``schema`` from a clustered table, a missing one or another type raises.

    ``first`` and ``last`` bound the day of the event, ends included, and prune months; with
    either, events without a date are left out. ``patients`` bounds the patient, ends included,
    and prunes row groups. Without bounds the whole table is read.
    """
    wanted = StructType.fromDDL(schema)
    laid = StructType.fromDDL(f"{schema}, {MONTH} DATE")
    found = {f.name: f.dataType.simpleString() for f in spark.read.schema(f"{MONTH} DATE").parquet(path).schema}
    stored = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
    wrong = [f.name for f in wanted if stored.get(f.name) != f.dataType.simpleString()]
    if wrong or MONTH not in stored or MONTH not in found:
        raise SchemaError(f"{path} lacks columns: {', '.join(wrong) or MONTH}")
    rows = spark.read.schema(laid).parquet(path)
    if first is not None:
        rows = rows.where((F.col(MONTH) >= F.lit(first.replace(day=1))) & (F.col(day) >= F.lit(first)))
    if last is not None:
        rows = rows.where((F.col(MONTH) <= F.lit(last)) & (F.col(day) <= F.lit(last)))
    if patients is not None:
        rows = rows.where(F.col(key).between(*patients))
    return rows.select(*wanted.names)


def campaign_days(study: Study, rank: int) -> tuple[date, date]:
    """The first and the last day of a campaign; the last one ends before the calendar closes."""
    starts = [*study.campaign_starts, study.calendar_close]
    return starts[rank], starts[rank + 1] - timedelta(days=1)


def read_campaign(spark: SparkSession, path: str, schema: str, study: Study, rank: int, **options) -> DataFrame:
    """The events of one campaign, by rank from 0; other months are not read."""
    first, last = campaign_days(study, rank)
    return read_clustered(spark, path, schema, first=first, last=last, **options)
