"""Writers: Parquet extracts, small CSV result tables, JSON settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jabcheck.functions.rounding import number_text
from jabcheck.sources.readers import NA


def write_extract(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    """Write a summary table as one CSV file in the order it comes in.

    Booleans are upper case, whole doubles lose their ``.0`` and missing values are ``NA``.
    Only for aggregated tables, which have a few thousand rows at most.
    """
    columns = []
    for name, kind in table.dtypes:
        value = F.col(f"`{name}`")
        if kind == "boolean":
            value = F.upper(value.cast("string"))
        elif kind == "double":
            value = number_text(value)
        columns.append(value.alias(name))
    table.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue=NA, escape='"')


def write_json(table: DataFrame, path: str, *, single: bool = False) -> None:
    """Write a dimension table as one JSON document; missing fields are left out.

    The document is an array with an object for each row in the order they come in, or with
    ``single`` the object of the only row. Only for constants of a study: one task holds it.
    """
    row = F.struct(*[f"`{c}`" for c in table.columns])
    document = F.first(row) if single else F.collect_list(row)
    lines = table.coalesce(1).agg(F.to_json(document, {"pretty": "true"}).alias("value"))
    lines.write.mode("overwrite").text(path)
