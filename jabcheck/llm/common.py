"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jabcheck.operators.staging import Staging, session_staging

#: The white space that separates words.
SPACE = r"\x20\x09-\x0D"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as they may not have it."""
    context = spark.sparkContext
    if not any("jabcheck-" in f for f in context.listFiles):
        top = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp()) / f"jabcheck-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        context.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The staging folder in use, by name.
_PART = ["llm"]


@contextmanager
def storing(part: str) -> Iterator[None]:
    """Operators called in the block stage their tables apart, so ``release`` can delete just these."""
    _PART.append(part)
    try:
        yield
    finally:
        _PART.pop()


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written in the block leaves no shuffle files behind.

    Spark else keeps them until the driver happens to collect its garbage, beside what was written.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _staging(spark: SparkSession) -> Staging:
    return session_staging(spark, _PART[-1])


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``, which all executors share."""
    return _staging(spark).new_path()


def staged(frame: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read back.

    This cuts the lineage: what follows survives the loss of any executor, and nothing above
    runs twice. The files stay until ``release`` or until Python ends.
    """
    return _staging(frame.sparkSession).store(frame)


def bucketed(frame: DataFrame, *columns: str, buckets: int | None = None, **options: str) -> DataFrame:
    """As ``staged``, dealt by ``columns``: grouping and joining by them moves nothing."""
    return _staging(frame.sparkSession).bucketed(frame, *columns, buckets=buckets, **options)


def release(spark: SparkSession, part: str = "llm") -> None:
    """Delete what this application staged in that part, once results over it are no longer read."""
    session_staging(spark, part).remove()


def learned_from(folds: int) -> Column:
    """True for rows a model may learn from: crc32 of the id as text is no multiple of ``folds``.

    A row without an id counts as id '' and so is held out.
    """
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds != 0


def text_blocks(
    batches: Iterable[pa.RecordBatch], column: str, block_bytes: int = 2_000_000
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts add up to about ``block_bytes``, to bound memory.

    One longer text is a slice of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > block_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
