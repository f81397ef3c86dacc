"""Extracts between the extraction and the report jobs, as Parquet or as Arrow files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jabcheck.sources import writers
from jabcheck.sources.arrowfiles import read_arrow, write_arrow
from jabcheck.sources.readers import read_table

PARQUET, ARROW = "parquet", "arrow"
FORMATS = (PARQUET, ARROW)


def read_extract(spark: SparkSession, folder: str, name: str, schema: str, file_format: str = PARQUET) -> DataFrame:
    """``folder/name`` as Parquet, or ``folder/name.arrow``, a file or a folder of files."""
    if file_format == ARROW:
        return read_arrow(spark, f"{folder}/{name}.arrow", schema)
    return read_table(spark, f"{folder}/{name}", schema)


def write_extract(events: DataFrame, folder: str, name: str, file_format: str = PARQUET) -> None:
    if file_format == ARROW:
        write_arrow(events, f"{folder}/{name}.arrow")
    else:
        writers.write_extract(events, f"{folder}/{name}")
