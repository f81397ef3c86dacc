"""Tables stored between the steps of a long job, in a folder that all executors share."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_SESSIONS: dict[tuple[str, str], Staging] = {}


def _warehouse(spark: SparkSession) -> str:
    """The warehouse, unless it is a folder that executors on other machines cannot see."""
    folder, master = spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    local = path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).getScheme() == "file"
    if local and not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(
            f"{folder} is a folder of this machine, the executors of {master} need a shared one: "
            "name it as the staging folder or in spark.checkpoint.dir"
        )
    return folder


class Staging:
    """A fresh folder for the intermediate tables of one job; ``remove`` deletes it.

    ``folder`` defaults to the one that ``spark.checkpoint.dir`` names, or else to the
    warehouse, where Spark keeps tables. It must be shared: a folder of one machine would
    lose tables with an executor. A folder that is named is trusted to be shared (a mount has
    a local path too); a local warehouse raises if executors run on other machines.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None) -> None:
        folder = folder or spark.conf.get("spark.checkpoint.dir", None) or _warehouse(spark)
        self.spark = spark
        self.path = f"{folder.rstrip('/')}/jabcheck-{uuid.uuid4().hex}"
        self.buckets = buckets
        self._databases: list[str] = []

    def new_path(self) -> str:
        return f"{self.path}/{uuid.uuid4().hex}"

    def store(self, frame: DataFrame) -> DataFrame:
        """``frame`` written once as Parquet; what follows starts from the files."""
        path = self.new_path()
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def by_patient(self, frame: DataFrame) -> DataFrame:
        """``frame`` as a table bucketed by patient, read without a shuffle by patient."""
        return self.bucketed(frame, "patient_id", sort=["patient_id"])

    def bucketed(
        self, frame: DataFrame, *columns: str, sort: list[str] | None = None, buckets: int | None = None, **options: str
    ) -> DataFrame:
        """``frame`` as a table dealt by ``columns``, so grouping or joining by them moves nothing."""
        buckets = buckets or self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        database = f"staging_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE DATABASE {database} LOCATION '{self.path}/{database}'")
        self._databases.append(database)
        writer = frame.write.format("parquet").options(**options).bucketBy(buckets, *columns)
        (writer.sortBy(*sort) if sort else writer).saveAsTable(f"{database}.rows")
        return self.spark.table(f"{database}.rows")

    def remove(self) -> None:
        while self._databases:
            self.spark.sql(f"DROP DATABASE IF EXISTS {self._databases.pop()} CASCADE")
        self._delete_files()

    def _delete_files(self) -> None:
        jvm = SparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


@contextmanager
def staging(spark: SparkSession, folder: str | None = None, buckets: int | None = None) -> Iterator[Staging]:
    """A :class:`Staging` for one ``with`` block."""
    stage = Staging(spark, folder, buckets)
    try:
        yield stage
    finally:
        stage.remove()


def session_staging(spark: SparkSession, name: str = "") -> Staging:
    """One :class:`Staging` of that name for all results of an application still to be read.

    Its files are deleted when Python ends.
    """
    key = spark.sparkContext.applicationId, name
    if key not in _SESSIONS:
        _SESSIONS[key] = Staging(spark)
        atexit.register(_SESSIONS[key]._delete_files)
    return _SESSIONS[key]
