"""Random classes of an exact size, without sorting the table."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jabcheck.functions.draws import MODULUS, draw

#: histogram cells over the range of a draw
CELLS = 65_536
CELL_WIDTH = MODULUS // CELLS + 1

Size = Callable[[int], int]


def exact_classes(rows: DataFrame, key: str, salt: int, sizes: list[Size], name: str) -> DataFrame:
    """Put rows in disjoint random classes 1, 2, ... of exact sizes; the rest get 0.

    Classes are consecutive ranges in the order of ``draw(key)``, ties by ``key``, which must
    be unique. Each entry of ``sizes`` maps the number of rows to a class size.

    The order is never materialised. One action fetches a histogram of the draws (at most
    :data:`CELLS` numbers, whatever the size of the table). It gives the class of every cell
    that no class border crosses; only rows of the few cells with a border are ranked, each
    cell holding about one row in :data:`CELLS`.
    """
    cell = F.floor(F.col("_draw") / F.lit(CELL_WIDTH)).cast("int")
    drawn = rows.withColumn("_draw", draw(F.col(key), salt)).withColumn("_cell", cell)
    counted = sorted((r["_cell"], r["count"]) for r in drawn.groupBy("_cell").count().collect())
    cells = [c for c, _ in counted]
    starts = [0, *accumulate(n for _, n in counted)]
    total = starts[-1]
    borders = list(accumulate((size(total) for size in sizes), lambda reached, n: min(total, reached + n)))

    crossed = {}
    for border in borders:
        at = bisect_right(starts, border) - 1
        if at < len(cells) and starts[at] < border:
            crossed[cells[at]] = starts[at]
    # a cell lies before a border if its first position does
    first_after = [cells[at] if (at := bisect_right(starts, b - 1)) < len(cells) else CELLS for b in borders]
    by_cell = _class_before(F.col("_cell"), first_after)
    if not crossed:
        return drawn.withColumn(name, by_cell).select(*rows.columns, name)

    in_crossed = F.col("_cell").isin(*crossed)
    before = F.lit(0)
    for number, position in crossed.items():
        before = F.when(F.col("_cell") == number, F.lit(position)).otherwise(before)
    position = before + F.row_number().over(W.partitionBy("_cell").orderBy("_draw", key)) - 1
    whole = drawn.where(~in_crossed).withColumn(name, by_cell)
    ranked = drawn.where(in_crossed).withColumn(name, _class_before(position, borders))
    return whole.unionByName(ranked).select(*rows.columns, name)


def _class_before(value: Column, borders: list[int]) -> Column:
    """Number of the first border above ``value``, 0 if there is none."""
    found = F.lit(0)
    for number, border in reversed(list(enumerate(borders, start=1))):
        found = F.when(value < border, F.lit(number)).otherwise(found)
    return found


def at_least(rate: float, minimum: int) -> Size:
    """Class size ``max(minimum, floor(rate * rows))``."""
    return lambda total: max(minimum, math.floor(rate * total))


def share(rate: float) -> Size:
    """Class size ``rate * rows``, rounded with halves to even."""
    return lambda total: round(rate * total)
