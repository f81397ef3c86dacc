"""Web archives: gzip members written by tasks, and a sequential reader that verifies them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from jabcheck.llm.common import shared_folder, staged, text_blocks

#: A file is closed after this many bytes of payload.
FILE_BYTES = 16_000_000
#: Files that one task reads, about 128 MB of payload.
FILES_A_TASK = 8
#: Bytes read at once.
CHUNK = 65_536
#: Equal payloads of fewer bytes are stored each time.
LEAST_REVISIT = 1000


@contextmanager
def opened(uri: str, mode: str) -> Iterator[BinaryIO]:
    """A stream to or from a file of any store that pyarrow knows; a path counts as local."""
    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        with store.open_input_stream(path, compression=None) as stream:
            yield stream
        return
    # a task that dies leaves a part file under another name; the last whole one wins
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{TaskContext.get().taskAttemptId()}.draft"
    with store.open_output_stream(draft, compression=None) as stream:
        yield stream
    store.move(draft, path)


def member(page: dict) -> bytes:
    """One record as a gzip member of its own."""
    payload = page["payload"]
    digest = "sha1:" + base64.b32encode(bytes.fromhex(page["digest"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = page["refers_to"] is not None
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page['page_id'] is None else page['page_id']}>",
        "WARC-Target-URI": " ".join((page["url"] or "").split()),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
    }
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{page['refers_to']}>"
    fields["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def members(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of each gzip member in turn, inflated as the bytes come in."""
    rest = b""
    while rest or (rest := stream.read(chunk)):
        inflate, parts = zlib.decompressobj(wbits=31), []
        while not inflate.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("the archive ends inside a gzip member")
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(parts)


def parsed(record: bytes) -> dict:
    """The fields and block of a record, framed by its length and checked against its digests."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as Content-Length says")
    if fields["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("the block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    if fields["warc-type"] == "response" and (
        len(payload) != int(said[b"content-length"]) or hashlib.sha1(payload).digest() != digest
    ):
        raise ValueError("the payload does not match its length or digest")
    return {
        "record_id": fields["warc-record-id"],
        "url": fields["warc-target-uri"],
        "record_type": fields["warc-type"],
        "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": int(said[b"content-length"]),
        "payload_digest": digest.hex(),
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` for each page.

    Of equal payloads of at least ``least`` bytes the one with the largest ``page_id`` is
    stored and the others refer to it. NULL html is an empty payload. A NULL ``page_id`` is
    smaller than any other; if all ids of a group are NULL, each page is stored, and so is
    each row that repeats the largest id.
    """
    rows = pages.select(
        pages["page_id"].alias("page_id"),
        pages["url"].alias("url"),
        F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    again = staged(  # so the join is one of two plain shuffles, and a hot payload is split
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("stored"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "stored")
    )
    refers = F.when((F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored"))
    return rows.join(again, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of ``revisits`` as ``.warc.gz`` files; a row ``path, records`` each.

    Files are named by partition and number. Rows are sorted within a partition, so a repeated
    task writes the same bytes under the same name.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        pages = (p for b in batches for x in text_blocks([b], "payload") for p in x.to_pylist())
        page, number = next(pages, None), 0
        while page is not None:
            path, size, count = f"{folder}/part-{task:05d}-{number:05d}.warc.gz", 0, 0
            with opened(path, "w") as out:
                while page is not None and size < file_bytes:
                    out.write(member(page))
                    size, count = size + len(page["payload"]), count + 1
                    page = next(pages, None)
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

    ordered = records.sortWithinPartitions("page_id", "digest", "url")
    return staged(ordered.mapInArrow(run, "path string, records bigint"))


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that ``files.path`` names, verified; a bad one raises.

    A task streams each of its files once, member after member, and holds one record. It has
    at most ``FILES_A_TASK`` files, dealt in turn, so that there are far fewer tasks than files. A
    revisit has no payload in the archive, so its length and digest are as its record says.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with opened(path, "r") as stream:
                    for record in members(stream):
                        row = parsed(record)
                        if not payloads:
                            del row["payload"]
                        rows.append(row)
                        size += len(record) if payloads else 200
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "record_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string"
    schema = pa.schema(
        [(k, pa.int64() if k == "payload_bytes" else pa.string()) for k in (x.split()[0] for x in kinds.split(", "))]
        + [("payload", pa.binary())] * payloads
    )
    number = files.count()
    few = min(number, files.sparkSession.sparkContext.defaultParallelism)
    each = files.select("path").repartition(max(1, few, -(-number // FILES_A_TASK)))
    return each.mapInArrow(run, kinds + ", payload binary" * payloads)


def archive(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every page as a record and return the written files, ``path, records``.

    ``folder`` is a URI that all executors share, by default below ``spark.checkpoint.dir``.
    An empty table writes no file. Extra columns are ignored.
    """
    return write(revisits(pages), folder or shared_folder(pages.sparkSession), file_bytes)
