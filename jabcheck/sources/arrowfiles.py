"""Arrow (Feather) files as a Spark data source: many tasks read one file, batch by batch."""

from __future__ import annotations

import posixpath
import sys
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "arrow_files"
SUFFIXES = (".arrow", ".feather")

#: Bytes of a file that one task reads, and rows that are handed over at once.
SPLIT_BYTES = 128 << 20
HANDED_ROWS = 10_000

#: Rows of a record batch that the writer makes, the unit that readers split by.
BATCH_ROWS = 65_536

_COMPARED = {
    EqualTo: pc.equal,
    GreaterThan: pc.greater,
    GreaterThanOrEqual: pc.greater_equal,
    LessThan: pc.less,
    LessThanOrEqual: pc.less_equal,
}

# executors need not have this package: what they run is sent by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ArrowSchemaError(ValueError):
    """An Arrow file does not have the columns or types that a job needs."""


@dataclass
class BatchRange(InputPartition):
    """Record batches ``first`` to ``end`` (left out) of one file."""

    path: str
    first: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    path: str | None


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    """Paths of the file, or of all Arrow files of the folder, without hidden ones."""
    system, place = _place(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [place]
    listed = system.get_file_info(fs.FileSelector(place))
    return sorted(
        f.path
        for f in listed
        if f.type == fs.FileType.File and f.base_name.endswith(SUFFIXES) and not f.base_name.startswith(("_", "."))
    )


def _plain(kind: pa.DataType) -> pa.DataType:
    """The type of the values: dictionaries are looked up, and large text is text."""
    if pa.types.is_dictionary(kind):
        return _plain(kind.value_type)
    return pa.string() if pa.types.is_large_string(kind) else kind


class ArrowReader(DataSourceReader):
    """Reads only the columns of the schema; comparisons of dates are made before rows are handed over."""

    def __init__(self, schema: StructType, options) -> None:
        self.wanted = schema
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.bounds: list[tuple[str, type, date]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            value = getattr(condition, "value", None)
            on_date = isinstance(value, date) and not isinstance(value, datetime)
            if type(condition) in _COMPARED and len(condition.attribute) == 1 and on_date:
                self.bounds.append((condition.attribute[0], type(condition), value))
            else:
                yield condition

    def _opened(self, path: str, included: list[int] | None = None) -> pa.ipc.RecordBatchFileReader:
        system, _ = _place(self.path)
        options = pa.ipc.IpcReadOptions(included_fields=included, use_threads=False)
        return pa.ipc.open_file(system.open_input_file(path), options=options)

    def _checked(self, path: str, found: pa.Schema) -> None:
        plain = {f.name: _plain(f.type) for f in found}
        kinds = {f.name: f.type for f in to_arrow_schema(self.wanted)}
        wrong = [f"{n} {k} (is {plain.get(n, 'missing')})" for n, k in kinds.items() if plain.get(n) != k]
        if wrong:
            raise ArrowSchemaError(f"{path} lacks columns: {', '.join(wrong)}")

    def _ranges(self, path: str) -> list[BatchRange]:
        """Batches of a file in runs of about ``split_bytes``, from its footer alone."""
        system, _ = _place(self.path)
        reader = self._opened(path)
        self._checked(path, reader.schema)
        number, size = reader.num_record_batches, system.get_file_info(path).size
        run = max(1, int(number * self.split_bytes / max(size, 1)))
        return [BatchRange(path, first, min(first + run, number)) for first in range(0, number, run)]

    def partitions(self) -> Sequence[InputPartition]:
        """Footers are read by a few threads of the driver; a file without batches is still checked."""
        with ThreadPoolExecutor(16) as threads:
            found = [part for parts in threads.map(self._ranges, _files(self.path)) for part in parts]
        return found or [BatchRange("", 0, 0)]

    def read(self, partition: BatchRange) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.end:
            return
        names = self.wanted.names
        kinds = to_arrow_schema(self.wanted)
        places = self._opened(partition.path).schema
        reader = self._opened(partition.path, [places.get_field_index(n) for n in names])
        for number in range(partition.first, partition.end):
            batch = reader.get_batch(number)
            for name, comparison, value in self.bounds:
                batch = batch.filter(_COMPARED[comparison](batch.column(name), pa.scalar(value, pa.date32())))
            columns = [batch.column(f.name).cast(f.type) for f in kinds]
            for start in range(0, batch.num_rows, HANDED_ROWS):
                yield pa.RecordBatch.from_arrays([c.slice(start, HANDED_ROWS) for c in columns], schema=kinds)


class ArrowWriter(DataSourceArrowWriter):
    """A file a task, written to a hidden folder; the files take their places when all are there."""

    def __init__(self, schema: StructType, options, overwrite: bool) -> None:
        self.wanted = schema
        self.path = options["path"]
        self.batch_rows = int(options.get("batch_rows", BATCH_ROWS))
        self.overwrite = overwrite
        self.hidden = f"_unfinished-{uuid.uuid4().hex}"

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        system, place = _place(self.path)
        return system, place, posixpath.join(place, self.hidden)

    def _write(self, batches: Iterable[pa.RecordBatch]) -> str:
        system, _, hidden = self._folder()
        system.create_dir(hidden, recursive=True)
        path = posixpath.join(hidden, f"part-{uuid.uuid4().hex}.arrow")
        kinds = to_arrow_schema(self.wanted)
        with system.open_output_stream(path) as out, pa.ipc.new_file(out, kinds) as file:
            held, rows = [], 0
            for batch in batches:
                held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, kinds, strict=True)], schema=kinds))
                rows += batch.num_rows
                if rows >= self.batch_rows:
                    held, rows = self._flushed(file, held, rows, kinds), rows % self.batch_rows
            self._flushed(file, held, 0, kinds)
        return path

    def _flushed(self, file, held: list[pa.RecordBatch], rows: int, kinds: pa.Schema) -> list[pa.RecordBatch]:
        """Write what is held in whole batches; with ``rows`` 0 the last, shorter one too."""
        joined = pa.Table.from_batches(held, kinds).combine_chunks()
        whole = rows // self.batch_rows * self.batch_rows if rows else joined.num_rows
        for batch in joined.slice(0, whole).to_batches(max_chunksize=self.batch_rows):
            file.write_batch(batch)
        return joined.slice(whole).to_batches()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Written(None)

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from iterator

        return Written(self._write(all_batches()))

    def commit(self, messages: list[Written | None]) -> None:
        """Attempts that were given up have no message, so their files go with the hidden folder."""
        paths = [m.path for m in messages if m is not None and m.path] or [self._write([])]
        system, place, hidden = self._folder()
        old = _files(self.path) if self.overwrite else []
        for path in paths:
            system.move(path, posixpath.join(place, posixpath.basename(path)))
        for path in old:
            system.delete_file(path)
        system.delete_dir(hidden)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, hidden = self._folder()
        if system.get_file_info(hidden).type == fs.FileType.Directory:
            system.delete_dir(hidden)


class ArrowFiles(DataSource):
    """``path`` is a file or a folder of files; ``split_bytes`` and ``batch_rows`` bound tasks and batches."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        paths = _files(self.options["path"])
        if not paths:
            raise ArrowSchemaError(f"{self.options['path']} holds no Arrow file")
        system, _ = _place(self.options["path"])
        found = pa.ipc.open_file(system.open_input_file(paths[0])).schema
        return from_arrow_schema(pa.schema([(f.name, _plain(f.type)) for f in found]))

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(schema, self.options, overwrite)


def read_arrow(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """The columns of ``schema`` from Arrow files; a missing one or another type raises.

    Other columns are not read. Splits are runs of record batches, so one large file is read by
    many tasks. Comparisons of a date column with a constant are made by the reader; for these
    the session is told to push filters to Python data sources.
    """
    spark.dataSource.register(ArrowFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).schema(schema).options(**options).load(path)


def write_arrow(events: DataFrame, path: str, **options: str) -> None:
    """Write ``events`` as a folder of Arrow files, in place of what was there."""
    events.sparkSession.dataSource.register(ArrowFiles)
    events.write.format(FORMAT).options(**options).mode("overwrite").save(path)
