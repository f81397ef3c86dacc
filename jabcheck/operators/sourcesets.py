"""Any number of record sources, as bit masks: who is in which, and whose dates agree."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jabcheck.functions.rounding import round_midpoint
from jabcheck.operators.clean import campaign_label, rank_of_campaign
from jabcheck.operators.crosssource import PERSON
from jabcheck.operators.summaries import ordered
from jabcheck.study import Study

#: A mask is a long; the sign bit is left alone.
MOST_SOURCES = 62

#: Bits whose subsets are listed in one step: at most 256 rows for one pattern.
STEP = 8


def _checked(names: Sequence[str]) -> list[str]:
    if not 0 < len(names) <= MOST_SOURCES or len(set(names)) < len(names):
        raise ValueError(f"between 1 and {MOST_SOURCES} different sources can be compared")
    return list(names)


def _has(mask: str, bit: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << bit)) != 0


def source_bit(names: Sequence[str], source: str = "source") -> Column:
    """The bit of a record's source, the first name being the lowest; another name raises."""
    place = F.array_position(F.array(*[F.lit(n) for n in _checked(names)]), F.col(source))
    unknown = F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce(F.col(source), F.lit("NULL"))))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))
    return F.when(place > 0, bit).otherwise(unknown.cast("long"))


def source_masks(records: DataFrame, names: Sequence[str], study: Study) -> DataFrame:
    """``sources``, the mask of the sources with a record, per patient and campaign.

    A mask is combined before the one shuffle, so a busy patient sends a row a task.
    """
    return (
        records.withColumn("campaign_rank", rank_of_campaign(study))
        .groupBy(*PERSON)
        .agg(F.bit_or(source_bit(names)).alias("sources"))
    )


def exclusive_counts(masks: DataFrame, study: Study) -> DataFrame:
    """People per campaign and exact set of sources, disclosure-rounded."""
    people = masks.groupBy("campaign_rank", "sources").agg(F.count(F.lit(1)).alias("n"))
    return people.select("campaign_rank", "sources", round_midpoint(F.col("n"), study.threshold).alias("n"))


def intersections(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """``n_exclusive`` and ``n_inclusive`` per campaign and set of sources.

    Exclusive are people with records in these sources and no others, inclusive those with
    records in all of these, whatever else they are in: the sum over all supersets. Sets that
    nobody is in have no row; the empty set counts everybody. Inclusive counts add up the given
    counts, so rounded ones stay consistent.

    A count is handed to the subsets of its set, :data:`STEP` sources at a time, and summed
    before the next step, so rows never exceed the number of different sets. Only counts move,
    people were counted before.
    """
    sums = counts.select("campaign_rank", "sources", F.col("n").alias("n_exclusive"), F.col("n").alias("n_inclusive"))
    for low in range(0, len(_checked(names)), STEP):
        width = min(STEP, len(names) - low)
        bits = ((1 << width) - 1) << low
        shifted = lambda s: F.call_function("shiftleft", s, F.lit(low))  # noqa: E731, B023
        inside = F.col("sources").bitwiseAND(F.lit(bits))
        every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit((1 << width) - 1).cast("long")), shifted)
        subsets = F.filter(every, lambda s: s.bitwiseAND(inside) == s)  # noqa: B023
        handed = sums.withColumn("_part", F.explode(subsets)).withColumn("_inside", inside)
        sums = (
            handed.withColumn("sources", (F.col("sources") - F.col("_inside")) + F.col("_part"))
            .groupBy("campaign_rank", "sources")
            .agg(
                F.sum(F.when(F.col("_part") == F.col("_inside"), F.col("n_exclusive")).otherwise(0)).alias("n_exclusive"),
                F.sum("n_inclusive").alias("n_inclusive"),
            )
        )
    return sums


def set_label(names: Sequence[str], mask: str = "sources") -> Column:
    """``"a + b"`` from a mask; the empty set is ``"any"``."""
    present = F.concat_ws(" + ", *[F.when(_has(mask, bit), F.lit(name)) for bit, name in enumerate(_checked(names))])
    return F.when(F.col(mask) == 0, F.lit("any")).otherwise(present)


def intersection_table(records: DataFrame, names: Sequence[str], study: Study) -> DataFrame:
    """Every intersection of the sources by campaign, exclusive and inclusive, with its share of people."""
    counts = intersections(exclusive_counts(source_masks(records, names, study), study), names)
    everybody = F.max(F.when(F.col("sources") == 0, F.col("n_inclusive"))).over(W.partitionBy("campaign_rank"))
    table = counts.select(
        campaign_label(study).alias("campaign"),
        set_label(names).alias("source_set"),
        F.bit_count("sources").alias("n_sources"),
        "n_exclusive",
        "n_inclusive",
        everybody.alias("n_people"),
        "campaign_rank",
        "sources",
    )
    return ordered(table, F.col("campaign_rank").asc_nulls_last(), "n_sources", "sources").drop("campaign_rank", "sources")


def pair_agreement(records: DataFrame, names: Sequence[str], study: Study, tolerances: Sequence[int]) -> DataFrame:
    """For any two sources and tolerance in days: people with close dates, of those in both.

    A row per campaign, pair and tolerance; a campaign in which nobody is in both has 0 of 0.
    As for three sources, the latest earlier date of each source decides in one pass over a
    person's days; ``k`` sources make ``k (k - 1) / 2`` pairs of columns and no pairs of rows.
    """
    names = _checked(names)
    days = (
        records.groupBy("patient_id", "vax_date")
        .agg(F.bit_or(source_bit(names)).alias("sources"))
        .withColumn("campaign_rank", rank_of_campaign(study))
    )
    so_far = W.partitionBy(*PERSON).orderBy("vax_date").rowsBetween(W.unboundedPreceding, 0)
    latest = {
        f"_last_{bit}": F.last(F.when(_has("sources", bit), F.col("vax_date")), ignorenulls=True).over(so_far)
        for bit in range(len(names))
    }

    def near(here: int, other: int, within: int) -> Column:
        return _has("sources", here) & F.coalesce(F.datediff("vax_date", f"_last_{other}") <= within, F.lit(False))

    asked = [(a, b, within) for a, b in combinations(range(len(names)), 2) for within in tolerances]
    people = (
        days.withColumns(latest)
        .groupBy(*PERSON)
        .agg(
            F.bit_or("sources").alias("sources"),
            *[F.bool_or(near(a, b, t) | near(b, a, t)).alias(f"_near_{a}_{b}_{t}") for a, b, t in asked],
        )
    )
    both = {(a, b): _has("sources", a) & _has("sources", b) for a, b, _ in asked}
    sums = people.groupBy("campaign_rank").agg(
        *[F.count_if(both[a, b] & F.col(f"_near_{a}_{b}_{t}")).alias(f"_n_{a}_{b}_{t}") for a, b, t in asked],
        *[F.count_if(condition).alias(f"_both_{a}_{b}") for (a, b), condition in both.items()],
    )
    entries = [
        F.struct(
            F.lit(names[a]).alias("first_source"),
            F.lit(names[b]).alias("second_source"),
            F.lit(t).alias("within_days"),
            round_midpoint(F.col(f"_n_{a}_{b}_{t}"), study.threshold).alias("n"),
            round_midpoint(F.col(f"_both_{a}_{b}"), study.threshold).alias("denom"),
        )
        for a, b, t in asked
    ]
    return sums.select(campaign_label(study).alias("campaign"), F.inline(F.array(*entries)))
