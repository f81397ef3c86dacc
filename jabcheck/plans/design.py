"""Campaign calendar and study dates as tables, and the job that publishes them."""

from __future__ import annotations

from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jabcheck.sources.writers import write_json
from jabcheck.study import Study

_CAMPAIGN_ROWS = pa.schema(
    {
        "year": pa.int32(),
        "label": pa.string(),
        "start": pa.date32(),
        "early_milestone": pa.date32(),
        "primary_milestone": pa.date32(),
        "age_date": pa.date32(),
        "age_threshold": pa.int32(),
        "clinical_priority": pa.string(),
    }
)


def calendar(spark: SparkSession, study: Study) -> DataFrame:
    """One row per campaign with its milestones and their day numbers.

    A campaign's final milestone is the day before the next one starts. The window has no
    partition because the table has a dozen rows.
    """
    rows = pa.Table.from_pylist([asdict(c) for c in study.campaigns], schema=_CAMPAIGN_ROWS)
    next_start = F.lead("campaign_start_date", 1, study.calendar_close).over(W.orderBy("campaign_start_date"))

    def day_number(milestone: str):
        return F.datediff(F.col(milestone), F.col("campaign_start_date")) + 1

    return (
        spark.createDataFrame(rows)
        .withColumnsRenamed(
            {
                "label": "campaign_label",
                "start": "campaign_start_date",
                "early_milestone": "early_milestone_date",
                "primary_milestone": "primary_milestone_date",
            }
        )
        .withColumn("final_milestone_date", F.date_sub(next_start, 1))
        .withColumns(
            {
                "early_milestone_days": day_number("early_milestone_date"),
                "primary_milestone_days": day_number("primary_milestone_date"),
                "final_milestone_days": day_number("final_milestone_date"),
            }
        )
    )


def study_dates(spark: SparkSession, study: Study) -> DataFrame:
    dates = {
        "firstpossiblevax_date": [study.first_possible],
        "start_date": [study.start],
        "end_date": [study.end],
    }
    return spark.createDataFrame(pa.table({k: pa.array(v, pa.date32()) for k, v in dates.items()}))


def publish_design(spark: SparkSession, study: Study, out: str, name: str) -> None:
    """Write the dates and the calendar as JSON under ``out``."""
    write_json(study_dates(spark, study), f"{out}/study_dates_{name}.json", single=True)
    write_json(calendar(spark, study).orderBy("campaign_start_date"), f"{out}/campaign_info_{name}.json")
