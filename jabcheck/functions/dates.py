"""Date arithmetic and lookups by date."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_on(born: Column, day: Column) -> Column:
    """Completed years from ``born`` to ``day``.

    Compares month and day directly: ``months_between / 12`` calls 28 February a full
    year after 29 February, which a birthday rule must not.
    """
    before_birthday = F.month(day) * 100 + F.dayofmonth(day) < F.month(born) * 100 + F.dayofmonth(born)
    return F.year(day) - F.year(born) - before_birthday.cast("int")


def campaign_rank(day: str, starts: Sequence[date]) -> Column:
    """1-based position of the campaign that the column ``day`` falls in.

    Ranges are closed on the left and the last one never ends; a day before the first
    start is NULL. A CASE over a dozen literals stays in generated code, where a join on a
    date range would become a nested loop.
    """
    latest_first = reversed(list(enumerate(starts, start=1)))
    branches = " ".join(f"WHEN `{day}` >= {sql_literal(start)} THEN {n}" for n, start in latest_first)
    return F.expr(f"CASE {branches} END")


def by_rank(rank: Column, values: Sequence, type_name: str) -> Column:
    """Element of a fixed list by 1-based rank: a literal array, so no join.

    The list is given as one SQL expression; building it element by element would take a
    round trip to the JVM for each.
    """
    literals = F.expr(f"cast(array({', '.join(sql_literal(v) for v in values)}) AS array<{type_name}>)")
    return F.when(rank.isNotNull(), F.element_at(literals, rank))


def sql_literal(value: str | date | None) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
