"""Command line: one sub-command per job. ``spark-submit`` or ``python -m jabcheck``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from jabcheck.plans.covid import extract_covid, report_covid
from jabcheck.plans.design import publish_design
from jabcheck.plans.flu import extract_flu, report_flu, upset_data
from jabcheck.sources.extracts import FORMATS, PARQUET
from jabcheck.sources.readers import read_study_dates
from jabcheck.study import covid_study, flu_study


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="jabcheck", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str) -> argparse.ArgumentParser:
        command = jobs.add_parser(name)
        for path in paths:
            command.add_argument(f"--{path}", required=True)
        return command

    job("design-flu", "out")
    job("design-covid", "out")
    flu = job("extract-flu", "records", "out")
    flu.add_argument("--study-dates", help="JSON file written by design-flu")
    flu.add_argument("--snomed-codelist", help="CSV of codes")
    flu.add_argument("--drug-codelist", help="CSV of codes")
    flu.add_argument("--code-column", default="code", help="column of the codes in both")
    report_of_flu = job("report-flu", "extracts", "out")
    job("upset", "counts", "out")
    covid = job("extract-covid", "records", "out")
    covid.add_argument("--clustered", action="store_true", help="lay events out by month and patient")
    report_of_covid = job("report-covid", "extracts", "out")
    report_of_covid.add_argument("--staging", required=True, help="shared folder for intermediate tables")
    report_of_covid.add_argument("--buckets", type=int, help="buckets of the staged tables")
    report_of_covid.add_argument("--inject-faults", action="store_true")
    report_of_covid.add_argument("--as-set", action="store_true", help="publish single files, all or none")
    report_of_covid.add_argument("--seed", type=int, default=0, help="of the injected faults")
    for command in (flu, report_of_flu, covid, report_of_covid):
        command.add_argument("--format", default=PARQUET, choices=FORMATS, help="of the extracts")
    for report in (report_of_flu, report_of_covid):
        report.add_argument("--threshold", type=int, help="disclosure rounding precision, 0 for none")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    covid, flu = covid_study(), flu_study()
    if getattr(args, "threshold", None) is not None:
        covid, flu = replace(covid, threshold=args.threshold), replace(flu, threshold=args.threshold)
    spark = SparkSession.builder.appName(f"jabcheck {args.job}").getOrCreate()
    if args.job == "design-flu":
        publish_design(spark, flu, args.out, "flu")
    elif args.job == "design-covid":
        publish_design(spark, covid, args.out, "covid")
    elif args.job == "extract-flu":
        if args.study_dates:
            flu = read_study_dates(spark, args.study_dates, flu)
        extract_flu(
            spark,
            args.records,
            args.out,
            flu,
            snomed_codelist=args.snomed_codelist,
            drug_codelist=args.drug_codelist,
            code_column=args.code_column,
            file_format=args.format,
        )
    elif args.job == "report-flu":
        report_flu(spark, args.extracts, args.out, flu, file_format=args.format)
    elif args.job == "upset":
        upset_data(spark, args.counts, args.out)
    elif args.job == "extract-covid":
        extract_covid(spark, args.records, args.out, clustered=args.clustered, file_format=args.format)
    else:
        report_covid(
            spark,
            args.extracts,
            args.out,
            covid,
            staging_folder=args.staging,
            buckets=args.buckets,
            inject_faults=args.inject_faults,
            seed=args.seed,
            as_set=args.as_set,
            file_format=args.format,
        )


if __name__ == "__main__":
    main()
