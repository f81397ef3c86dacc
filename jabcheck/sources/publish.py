"""Result tables published as one consistent set of single CSV files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from jabcheck.sources.writers import write_csv

MANIFEST = "manifest.json"
#: What a folder that is still being written, and one that is being replaced, have after the name.
NEXT, PREVIOUS = ".next-", ".previous-"


class _Files:
    """A few operations on the file system that a path names."""

    def __init__(self, path: str) -> None:
        self.jvm = SparkContext._jvm
        self.system = self.at(path).getFileSystem(SparkContext._active_spark_context._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.system.exists(self.at(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.system.listStatus(self.at(path))] if self.exists(path) else []

    def rename(self, source: str, target: str) -> None:
        if not self.system.rename(self.at(source), self.at(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def delete(self, path: str) -> None:
        self.system.delete(self.at(path), True)

    def write(self, path: str, text: str) -> None:
        out = self.system.create(self.at(path), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()


def _parts(out: str) -> tuple[str, str]:
    folder, _, name = out.rstrip("/").rpartition("/")
    return folder or ".", name


def recover(spark: SparkSession, out: str) -> None:
    """Finish or undo what a stopped publication left beside ``out``.

    Where the set itself is missing, a new one that has its manifest takes its place, else the
    previous one does. What then is left over is deleted.
    """
    files, (folder, name) = _Files(out), _parts(out)
    beside = files.names(folder)
    fresh = [f"{folder}/{n}" for n in beside if n.startswith(name + NEXT)]
    older = [f"{folder}/{n}" for n in beside if n.startswith(name + PREVIOUS)]
    if not files.exists(out):
        whole = [p for p in fresh if files.exists(f"{p}/{MANIFEST}")] or older
        if whole:
            files.rename(whole[0], out)
            fresh, older = [p for p in fresh if p != whole[0]], [p for p in older if p != whole[0]]
    for path in fresh + older:
        files.delete(path)


def publish(spark: SparkSession, tables: Iterable[tuple[str, DataFrame]], out: str) -> dict[str, int]:
    """Write ``tables`` as files ``name.csv`` of the folder ``out``, all of them or none.

    Each table becomes one file of a fresh folder beside ``out``, in the order and form of
    :func:`write_csv`. When the last one is there, a manifest with the rows of each is added
    and the folder takes the place of ``out`` by two renames; :func:`recover`, which runs
    first, finishes them if the job stopped in between. Until then readers see the old set
    whole. A folder that holds anything but a set is refused. Tables are taken one after the other, so an iterator may make them as it goes.
    Returns the rows of each table. Only one job may publish to a folder at a time.
    """
    recover(spark, out)
    files, (folder, name) = _Files(out), _parts(out)
    if files.names(out) and not files.exists(f"{out}/{MANIFEST}"):
        raise ValueError(f"{out} holds files that no publication wrote")
    tag = uuid.uuid4().hex
    fresh, older = f"{folder}/{name}{NEXT}{tag}", f"{folder}/{name}{PREVIOUS}{tag}"
    rows: dict[str, int] = {}
    for table, frame in tables:
        if table in rows:
            raise ValueError(f"two tables are named {table}")
        parts = f"{fresh}/_{table}"
        write_csv(frame, parts)
        (part,) = [n for n in files.names(parts) if n.startswith("part-")]
        files.rename(f"{parts}/{part}", f"{fresh}/{table}.csv")
        files.delete(parts)
        rows[table] = spark.read.csv(f"{fresh}/{table}.csv", header=True, escape='"', multiLine=True).count()
    listed = [{"file": f"{t}.csv", "rows": n} for t, n in rows.items()]
    files.write(f"{fresh}/{MANIFEST}", json.dumps({"set": tag, "tables": listed}, indent=1))
    if files.exists(out):
        files.rename(out, older)
    files.rename(fresh, out)
    files.delete(older)
    return rows
