"""Folding equal records into one row with a count, and unrolling them again.

Joins and windows by patient run on folded rows: whatever share of a table one patient or
one group of copies holds, a patient has no more folded rows than there are distinct days
and products. Folding combines before its shuffle and its key is the whole row, so it has
no hot group itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: copies that are unrolled from one array
CHUNK = 100_000


def fold_rows(records: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of ``columns`` with ``n_records``, the number of records behind each."""
    return records.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_records"))


def unroll_rows(rows: DataFrame, n: str = "n_records") -> DataFrame:
    """Each row ``n`` times, without the column ``n``; rows with ``n < 1`` vanish.

    A count is cut into chunks of :data:`CHUNK`, mostly one, and each chunk is unrolled by
    itself, so a huge count never builds a huge array. The input is read once.
    """
    kept = [c for c in rows.columns if c != n]
    count, first = F.col(n), F.lit(0).cast("long")
    chunks = F.sequence(first, F.floor((count - 1) / F.lit(CHUNK)).cast("long"))
    cut = rows.where(count >= 1).select(*kept, n, F.explode(chunks).alias("_chunk"))
    size = F.least(F.lit(CHUNK).cast("long"), count - F.col("_chunk") * CHUNK).cast("int")
    return cut.select(*kept, F.explode(F.array_repeat(F.lit(True), size)).alias("_copy")).select(*kept)
