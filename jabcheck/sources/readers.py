"""Readers: Parquet tables, codelists, study dates and released counts."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jabcheck.sources import schemas
from jabcheck.study import Study

NA = "NA"


class SchemaError(ValueError):
    """An input file does not have the columns, types or values that a job needs."""


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with the columns of ``schema``; a missing one or another type raises.

    Columns are found by name, and others are not read.
    """
    wanted = StructType.fromDDL(schema)
    found = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
    wrong = [
        f"{f.name} {f.dataType.simpleString()} (is {found.get(f.name, 'missing')})"
        for f in wanted
        if found.get(f.name) != f.dataType.simpleString()
    ]
    if wrong:
        raise SchemaError(f"{path} lacks columns: {', '.join(wrong)}")
    return spark.read.schema(wanted).parquet(path).select(*[f"`{c}`" for c in wanted.names])


def _read_named(spark: SparkSession, path: str, columns: list[str], **options) -> DataFrame:
    """Columns of a CSV by name, as text; a missing one or a malformed row raises."""
    rows = spark.read.csv(path, header=True, escape='"', mode="FAILFAST", enforceSchema=False, **options)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise SchemaError(f"{path} has no column {', '.join(missing)}")
    return rows.select(*[f"`{c}`" for c in columns])


def read_codelist(spark: SparkSession, path: str, column: str = "code") -> DataFrame:
    """Distinct codes of any column of a CSV. Codes stay text: they have up to 18 digits."""
    listed = _read_named(spark, path, [column])
    return listed.select(F.col(f"`{column}`").alias("code")).where(F.col("code").isNotNull()).distinct()


def codes_frame(spark: SparkSession, codes) -> DataFrame:
    """A codelist given as a Python sequence."""
    return spark.createDataFrame(pa.table({"code": pa.array(dict.fromkeys(codes), pa.string())}))


def read_study_dates(spark: SparkSession, path: str, study: Study) -> Study:
    """``study`` with the three dates found in a JSON file (one object, any layout)."""
    row = spark.read.json(path, schema=schemas.STUDY_DATES, multiLine=True, mode="FAILFAST").first()
    missing = [name for name, value in row.asDict().items() if value is None] if row else ["any date"]
    if missing:
        raise SchemaError(f"{path} has no {', '.join(missing)}")
    return replace(study, first_possible=row.firstpossiblevax_date, start=row.start_date, end=row.end_date)


def read_source_counts(spark: SparkSession, path: str) -> DataFrame:
    """Released counts per campaign and source combination (CSV, ``NA`` for missing).

    Columns are found by name; a cell that is not of its column's type raises when read.
    """
    wanted = StructType.fromDDL(schemas.SOURCE_COUNTS)
    rows = _read_named(spark, path, wanted.names, nullValue=NA)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])
