"""The rules of a study as SQL functions, for reports written in plain SQL.

Each is a temporary function of the session with an SQL body, so Catalyst puts the body in
place of the call and a query with it is generated code, without Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from jabcheck.functions.dates import sql_literal
from jabcheck.functions.labels import (
    BETWEEN_BOOSTERS,
    BOOSTER,
    INTERVAL_BINS,
    PRIMARY,
    PRIMARY_TO_BOOSTER,
    SOURCES,
    WITHIN_BOOSTER,
    WITHIN_PRIMARY,
    campaign_stage,
)
from jabcheck.study import Study


def _roundmid_any() -> str:
    return """roundmid_any(x BIGINT, step INT) RETURNS BIGINT
COMMENT 'Up to a multiple of step, then back to the middle of the step; 0 stays 0, step 0 changes nothing'
RETURN CASE WHEN step = 0 THEN x WHEN x = 0 THEN 0 ELSE x + pmod(-x, step) - step DIV 2 END"""


def _age_on() -> str:
    return """age_on(born DATE, on_day DATE) RETURNS INT
COMMENT 'Completed years from born to on_day'
RETURN year(on_day) - year(born)
  - if(month(on_day) * 100 + day(on_day) < month(born) * 100 + day(born), 1, 0)"""


def _interval_bin() -> str:
    cases = " ".join(
        f"WHEN days >= {first}" + (f" AND days <= {last}" if last else "") + f" THEN {sql_literal(label)}"
        for label, first, last in INTERVAL_BINS
    )
    return f"""interval_bin(days INT) RETURNS STRING
COMMENT 'The bin of a number of days between two doses, NULL outside all of them'
RETURN CASE {cases} END"""


def _campaign_on(study: Study) -> str:
    latest_first = reversed(list(zip(study.campaign_starts, study.campaign_labels, strict=True)))
    cases = " ".join(f"WHEN on_day >= {sql_literal(first)} THEN {sql_literal(label)}" for first, label in latest_first)
    return f"""campaign_on(on_day DATE) RETURNS STRING
COMMENT 'The campaign that a day falls in, NULL before the first'
RETURN CASE {cases} END"""


def _campaign_stage(study: Study) -> str:
    staged = [(label, campaign_stage(label)) for label in study.campaign_labels]
    cases = " ".join(f"WHEN {sql_literal(label)} THEN {sql_literal(stage)}" for label, stage in staged)
    return f"""campaign_stage(campaign STRING) RETURNS STRING
COMMENT 'The stage that a campaign belongs to, NULL for none'
RETURN CASE campaign {cases} END"""


def _interval_context() -> str:
    return f"""interval_context(stage_before STRING, stage STRING, same_campaign BOOLEAN) RETURNS STRING
COMMENT 'Where two consecutive doses sit relative to each other'
RETURN CASE
  WHEN stage_before = '{PRIMARY}' AND stage = '{PRIMARY}' THEN '{WITHIN_PRIMARY}'
  WHEN stage_before = '{PRIMARY}' AND stage = '{BOOSTER}' THEN '{PRIMARY_TO_BOOSTER}'
  WHEN stage_before = '{BOOSTER}' AND stage = '{BOOSTER}' AND same_campaign THEN '{WITHIN_BOOSTER}'
  WHEN stage_before = '{BOOSTER}' AND stage = '{BOOSTER}' THEN '{BETWEEN_BOOSTERS}' END"""


def _source_combination() -> str:
    parameters = ", ".join(f"in_{name} BOOLEAN" for name in SOURCES)
    present = "concat_ws(' + ', " + ", ".join(f"if(in_{name}, '{name}', NULL)" for name in SOURCES) + ")"
    return f"""source_combination({parameters}) RETURNS STRING
COMMENT 'The sources that hold a record, NULL for none'
RETURN CASE WHEN {present} LIKE '% + %' THEN {present} WHEN {present} <> '' THEN {present} || ' only' END"""


def _campaign_calendar(study: Study) -> str:
    starts = study.campaign_starts
    last_days = [f"date_sub({sql_literal(day)}, 1)" for day in starts[1:]] + ["CAST(NULL AS DATE)"]
    rows = ", ".join(
        f"({rank}, {sql_literal(label)}, {sql_literal(campaign_stage(label))}, {sql_literal(first)}, {last})"
        for rank, (label, first, last) in enumerate(zip(study.campaign_labels, starts, last_days, strict=True), start=1)
    )
    return f"""campaign_calendar(of_stage STRING)
RETURNS TABLE (campaign_rank INT, campaign STRING, stage STRING, first_day DATE, last_day DATE)
COMMENT 'Campaigns of a stage, or all for NULL; the last one never ends'
RETURN SELECT campaign_rank, campaign, stage, first_day, last_day
FROM VALUES {rows} AS t(campaign_rank, campaign, stage, first_day, last_day)
WHERE campaign_calendar.of_stage IS NULL OR t.stage = campaign_calendar.of_stage"""


def register_functions(spark: SparkSession, study: Study) -> None:
    """Define the functions in the session, in place of those of a study registered before."""
    bodies = [
        _roundmid_any(),
        _age_on(),
        _interval_bin(),
        _campaign_on(study),
        _campaign_stage(study),
        _interval_context(),
        _source_combination(),
        _campaign_calendar(study),
    ]
    for body in bodies:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
