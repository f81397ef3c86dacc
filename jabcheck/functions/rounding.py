"""Disclosure rounding, one-decimal percentages and the text they are printed as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_midpoint(x: Column, to: int) -> Column:
    """Round up to a multiple of ``to``, then back to the middle of the step; 0 stays 0.

    Stays in whole numbers, so a count of any size is exact. ``to=0`` gives ``x`` back.
    """
    if to == 0:
        return x
    ceiling = x + F.pmod(-x, F.lit(to))
    return F.when(x == 0, F.lit(0)).otherwise(ceiling - F.lit(to // 2)).cast("long")


def round_tenth(x: Column) -> Column:
    """Nearest tenth, comparing both candidate doubles; a true tie goes to the even tenth.

    ``round`` and ``bround`` decide on the printed decimal instead and differ on values
    such as 0.15 or 6.25.
    """
    tenths = F.floor(x * 10)
    low = tenths / F.lit(10.0)
    high = F.ceil(x * 10) / F.lit(10.0)
    nearest = (
        F.when(x - low < high - x, low)
        .when(x - low > high - x, high)
        .when(tenths % 2 == 0, low)
        .otherwise(high)
    )
    return F.when(F.isnan(x), x).otherwise(nearest)


def percent(n: Column, denominator: Column) -> Column:
    """``100 * n / denominator`` as a double; 0 / 0 is NaN rather than an error."""
    return F.when(denominator == 0, F.lit(float("nan"))).otherwise(F.lit(100) * n / denominator)


def number_text(x: Column) -> Column:
    """Number as text, whole numbers without a trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")
