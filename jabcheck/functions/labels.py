"""Names for dose intervals, campaign stages and source combinations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interval bins as (label, first day, last day), in order.
INTERVAL_BINS = (
    ("1-6", 1, 6),
    ("7-13", 7, 13),
    ("14-20", 14, 20),
    ("21-29", 21, 29),
    ("30-89", 30, 89),
    ("90-112", 90, 112),
    ("113-179", 113, 179),
    ("180+", 180, None),
)

# Campaigns of the primary stage; boosters are named by season.
PRIMARY_CAMPAIGNS = ("Pre-roll-out", "Primary series")
BOOSTER_PATTERN = "Spring|Autumn"

# Stages of a campaign, and contexts of an interval between two doses.
PRIMARY = "primary"
BOOSTER = "booster"
WITHIN_PRIMARY = "within_primary"
PRIMARY_TO_BOOSTER = "primary_to_booster"
WITHIN_BOOSTER = "within_booster_campaign"
BETWEEN_BOOSTERS = "between_booster_campaigns"

# The record sources that are compared with each other, in order.
SOURCES = ("table", "drug", "snomed")

# Separators of printed patterns and transitions.
PATTERN_SEPARATOR = "  --AND-- "
ARROW = " -> "


def interval_bin_rank(days: str) -> Column:
    """1-based position in :data:`INTERVAL_BINS` of the column ``days``, NULL outside all of them."""
    branches = " ".join(
        f"WHEN `{days}` >= {first}" + (f" AND `{days}` <= {last}" if last else "") + f" THEN {n}"
        for n, (_, first, last) in enumerate(INTERVAL_BINS, start=1)
    )
    return F.expr(f"CASE {branches} END")


def campaign_stage(campaign: str) -> str | None:
    """The stage that a campaign belongs to, from its label."""
    if campaign in PRIMARY_CAMPAIGNS:
        return PRIMARY
    return BOOSTER if re.search(BOOSTER_PATTERN, campaign) else None


def interval_context(stage_before: Column, stage: Column, same_campaign: Column) -> Column:
    """Where two consecutive doses sit relative to each other, from the stages of their campaigns."""
    from_primary, boosters = stage_before == PRIMARY, (stage_before == BOOSTER) & (stage == BOOSTER)
    return (
        F.when(from_primary & (stage == PRIMARY), WITHIN_PRIMARY)
        .when(from_primary & (stage == BOOSTER), PRIMARY_TO_BOOSTER)
        .when(boosters & same_campaign, WITHIN_BOOSTER)
        .when(boosters, BETWEEN_BOOSTERS)
    )


def source_combination(table: Column, drug: Column, snomed: Column) -> Column:
    """``"table only"``, ``"table + drug"`` ... from three presence columns."""
    present = F.concat_ws(
        " + ",
        *[F.when(bit, F.lit(name)) for bit, name in zip((table, drug, snomed), SOURCES, strict=True)],
    )
    return F.when(present.contains(" + "), present).when(present != "", F.concat(present, F.lit(" only")))
