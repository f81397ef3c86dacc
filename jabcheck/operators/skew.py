"""Many-to-one joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jabcheck.operators.staging import Staging


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], stage: Staging) -> DataFrame:
    """Give every row the columns of ``facts``, which has one row per key; NULL keys match too.

    Facts are aggregates of the rows, so every row has its facts. They are stored first:
    the join is then one of two plain shuffles, of which adaptive execution splits any
    partition that is too large, whichever key made it so. Spark broadcasts facts that it
    measures to be small.
    """
    stored = stage.store(facts.withColumnsRenamed({k: f"_key_{k}" for k in keys}))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return rows.join(stored, same, "left").drop(*[f"_key_{k}" for k in keys])
