"""Repeated substrings: suffix buckets refined by the bucket identifiers of later offsets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jabcheck.llm.common import bucketed, staged, text_blocks

#: Bytes of a repeated string.
LENGTH = 100
#: Bytes of the initial buckets.
GRAM = 24
#: Contexts a task refines together, and those of one bucket from which windows are dealt out singly.
TOGETHER = 10_000
CROWDED = 4_000

#: Bits of the salt, and of salt and count together, in the number that tells rows of one id apart.
_ID_BITS = (8, 35)

_SALT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_PLACE = np.uint64((1 << 24) - 1)
_SEGMENT = 8_000_000


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset on, as one number."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw, strides=(1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buckets(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each offset on; ``gram`` is a multiple of eight."""
    words = _words(raw)
    n = len(raw) - gram + 1
    total = np.zeros(max(0, n), np.uint64)
    for i in range(gram // 8):
        total = (total + words[8 * i : 8 * i + n]) * _SALT[i % 3]
        total ^= total >> np.uint64(29)
    return _mixed(total)


def anchors(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For every string of ``length`` bytes inside a text, the offset whose bucket stands for it.

    That is the smallest bucket of those that begin in the string, the leftmost of equal ones,
    so equal strings choose the same offset. Strings that follow each other mostly share it:
    the result has one row for each run, ``bucket, offset, first start, last start``.
    ``raw`` holds the texts one after another, ``ends`` where each ends.
    """
    none = np.empty(0, np.int64)
    width = length - gram + 1
    if len(raw) < length:
        return none, none, none, none
    bucket = buckets(raw, gram)
    low = (bucket & ~_PLACE) | np.arange(len(bucket), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    owner = (low & _PLACE).astype(np.int64)
    starts = np.r_[0, ends[:-1]]
    inside = np.zeros(len(owner) + 1, np.int32)  # windows that lie in one text
    long = ends - starts >= length
    inside[starts[long]] += 1
    np.subtract.at(inside, ends[long] - length + 1, 1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return none, none, none, none
    own = owner[at]
    new = np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(at) - 1]
    return bucket[own[first]].view(np.int64), own[first], at[first], at[last]


def _texts(docs: DataFrame) -> DataFrame:
    """All rows by order of id as a table that is dealt by its key, so later joins don't move texts.

    The key is the id and a number that tells rows of one id apart: leading bits of a hash of
    the text, a salt by place and a count. So neither very many rows of one id (NULL, say) nor
    very many equal rows are one task. A NULL id comes last. ``rest`` has the columns but the text.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(docs["doc_id"].cast("bigint"), F.lit(2**63 - 1)).alias("d"),
        F.coalesce(docs["text"], F.lit("")).cast("binary").alias("raw"),
        F.struct(*[docs[c].alias(c) for c in docs.columns if c != "text"]).alias("rest"),
    )
    if rows.groupBy("d").count().filter("count > 1").head(1):
        rows = rows.withColumn("head", F.shiftright(F.xxhash64("raw"), _ID_BITS[1] + 1))
        rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << _ID_BITS[0])))
        count = F.row_number().over(Window.partitionBy("d", "head", "salt").orderBy(F.xxhash64("raw"), F.length("raw")))
        high = F.shiftleft(F.shiftleft("head", _ID_BITS[0]).bitwiseOR(F.col("salt")), _ID_BITS[1] - _ID_BITS[0])
        rows = rows.withColumn("k", high.bitwiseOR(count.cast("bigint"))).drop("head", "salt")
    else:
        rows = rows.withColumn("k", F.lit(1).cast("bigint"))
    rows = rows.withColumn("h", F.struct(F.xxhash64("raw").alias("a"), F.xxhash64("raw", F.lit(1)).alias("b"), F.length("raw").alias("n")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(rows.repartition(parts, "d", "k"), "d", "k", compression="zstd")


def _anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``bucket, d, k, at``: the anchors of each text; ``at`` packs offset, first and last start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "raw", 1_000_000):
            d, k = block.column("d").to_numpy(), block.column("k").to_numpy()
            column = block.column("raw")
            bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            ends = bounds[1:] - bounds[0]
            for start in range(0, max(1, len(raw)), _SEGMENT):  # more than one for a single huge text only
                piece = raw[start : start + _SEGMENT + length - 1]
                bucket, own, first, last = anchors(piece, ends if len(ends) > 1 else np.array([len(piece)]), length, gram)
                text = np.searchsorted(ends, own + start, "right")
                base = np.r_[0, ends[:-1]][text]
                at = ((own + start - base) << 16) | ((own - first) << 8) | (own - last)
                yield pa.RecordBatch.from_pydict({"bucket": bucket, "d": d[text], "k": k[text], "at": at})

    return texts.select("d", "k", "raw").mapInArrow(run, "bucket bigint, d bigint, k bigint, at bigint")


def _contexts(texts: DataFrame, survivors: DataFrame, length: int) -> DataFrame:
    """The bytes that the strings of each surviving anchor cover."""
    lists = survivors.groupBy("d", "k").agg(F.collect_list(F.struct("bucket", "at")).alias("found"))
    rows = texts.select("d", "k", "raw").join(lists, ["d", "k"]).select("d", "k", "raw", "found")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "raw", 1_000_000):
            bucket, d, k, at, context = [], [], [], [], []
            for i, raw in enumerate(block.column("raw")):
                raw, found = raw.as_py(), block.column("found")[i].values
                own, before, after = _unpacked(here := found.field("at").to_numpy())
                bucket.append(found.field("bucket").to_numpy())
                at.append(here)
                d.append(np.full(len(here), block.column("d")[i].as_py()))
                k.append(np.full(len(here), block.column("k")[i].as_py(), np.int64))
                context += [raw[a:b] for a, b in zip((own - before).tolist(), (own - after + length).tolist())]
            if context:
                yield pa.RecordBatch.from_pydict({
                    "bucket": np.concatenate(bucket), "d": np.concatenate(d), "k": np.concatenate(k), "at": np.concatenate(at),
                    "context": pa.array(context, pa.binary()),
                })

    return rows.mapInArrow(run, "bucket bigint, d bigint, k bigint, at bigint, context binary")


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 16, (at >> 8) & 255, at & 255


def _numbered(key: np.ndarray) -> np.ndarray:
    """Ranks of the distinct values, by one sort."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.r_[np.zeros(1, np.uint64), (ordered[1:] != ordered[:-1]).astype(np.uint64)])
    return rank


def refined(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A bucket identifier of the ``length`` bytes from each start: equal for equal strings only.

    Buckets of eight bytes are numbered first. Buckets of twice the depth come from sorting
    offsets on the pair of their identifier and that of the offset where it ends, and the new
    identifiers serve for the next doubling. At last two buckets overlap to the full length,
    at the given starts only. ``length`` is 16 at least.
    """
    depth, identifier = 8, _numbered(_words(raw))
    high = np.uint64(32)
    while 4 * depth <= length:
        identifier = _numbered((identifier[:-depth] << high) | identifier[depth:])
        depth *= 2
    if 2 * depth < length:  # one more step, so that two buckets reach over the whole length
        identifier = _numbered((identifier[:-depth] << high) | identifier[depth:])
        depth *= 2
    return _numbered((identifier[starts] << high) | identifier[starts + length - depth])


def _laid_out(table: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """The contexts one after another, and of every string in them its start there, row and start in its text."""
    column = table.column("context").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    own, before, after = _unpacked(table.column("at").to_numpy())
    count = before - after + 1
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return raw, (bounds[:-1] - bounds[0])[row] + step, row, (own - before)[row] + step


def _repeats_together(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of strings that some earlier context of the same bucket has, by whole buckets."""
    groups = max(1, -(-contexts.count() // TOGETHER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("d", "ascending"), ("k", "ascending"), ("at", "ascending")])
        raw, here, row, start = _laid_out(table, length)
        d, k = table.column("d").to_numpy()[row], table.column("k").to_numpy()[row]
        identifier = refined(raw, here, length).astype(np.int64)
        place = np.arange(len(identifier))  # in the order of the texts
        first = np.empty(int(identifier.max()) + 1, np.int64)
        first[identifier[::-1]] = place[::-1]
        at = np.flatnonzero(first[identifier] < place)
        if len(at):
            new = np.r_[True, (row[at][1:] != row[at][:-1]) | (at[1:] != at[:-1] + 1)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:] - 1, len(at) - 1]
            yield pa.RecordBatch.from_pydict(
                {"d": d[at[first]], "k": k[at[first]], "s": start[at[first]], "e": start[at[last]] + length}
            )

    return (
        contexts.select(F.pmod(F.xxhash64("bucket"), F.lit(groups)).alias("group"), "d", "k", "at", "context")
        .groupBy("group")
        .applyInArrow(run, "d bigint, k bigint, s bigint, e bigint")
    )


def _repeats_apart(contexts: DataFrame, length: int) -> DataFrame:
    """The same for crowded buckets: each string is a row, and equal ones are folded by hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                table = pa.Table.from_batches([batch.slice(i, 5000)])
                raw, here, row, start = _laid_out(table, length)
                words = _words(raw)
                a, b = np.zeros(len(here), np.uint64), np.ones(len(here), np.uint64)
                for step in [*range(0, length - 7, 8), length - 8]:
                    a = _mixed(a * _SALT[0] + words[here + step])
                    b = _mixed(b * _SALT[1] + words[here + step])
                yield pa.RecordBatch.from_pydict({
                    "a": a.view(np.int64), "b": b.view(np.int64),
                    "d": table.column("d").to_numpy()[row], "k": table.column("k").to_numpy()[row], "s": start,
                })

    windows = staged(contexts.mapInArrow(run, "a bigint, b bigint, d bigint, k bigint, s bigint"))
    first = windows.groupBy("a", "b").agg(F.min(F.struct("d", "k", "s")).alias("f")).select("f.*")
    return windows.join(first, ["d", "k", "s"], "left_anti").select("d", "k", "s", (F.col("s") + length).alias("e"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, rest`` for each row.

    Texts are UTF-8 bytes; NULL is empty. Each byte is removed that lies in a string of
    ``length`` bytes which also starts earlier: in a row of smaller ``doc_id``, or earlier in
    the same row; overlapping counts, and matches never cross rows. Strings are judged on the
    input. ``n_spans`` counts runs of removed bytes, ``kept`` holds the others (BINARY), and
    ``rest`` the input's columns but the text. Rows
    without an id come after all others; rows of one id are ordered by the leading 28 bits of
    a hash of their text, then as they come, and of rows equal in id and text one is kept. Ids are whole numbers. ``gram`` is a multiple of eight below ``length``.

    Every string is represented by one of the initial buckets that begin in it, about one
    offset in forty. Buckets that occur once are done. The rest get the bytes of their
    strings; equal bytes fold to their first place, and other places repeat it. Where a
    bucket keeps several contexts, they are refined to full depth, many buckets in a task.
    A crowded bucket is dealt out string by string instead, so no task holds it.
    """
    return _cut(docs, length, gram, as_text=False)


def _cut(docs: DataFrame, length: int, gram: int, as_text: bool) -> DataFrame:
    texts = _texts(docs)
    # sums are stored before a join, which then splits what is hot
    firsts = staged(texts.groupBy("h").agg(F.min(F.struct("d", "k")).alias("f"), F.count("*").alias("n")).filter("n > 1"))
    copies = staged(
        texts.select("d", "k", "h").join(firsts.select("h", "f"), "h").filter("d <> f.d or k <> f.k").select("d", "k", F.lit(True).alias("copy"))
    )
    judged = texts.filter(F.length("raw") >= length).join(copies, ["d", "k"], "left_anti")
    anchored = _anchored(judged, length, gram)
    shared = staged(anchored.groupBy("bucket").count().filter("count > 1").select("bucket"))
    survivors = staged(anchored.join(shared, "bucket"))
    contexts = _contexts(texts, survivors, length)
    place = F.struct("d", "k", "at")
    folded = staged(
        contexts.groupBy("bucket", F.col("at").bitwiseAND(F.lit(0xFFFF)).alias("reach"), "context")
        .agg(F.min(place).alias("f"))
        .select("bucket", "f.*", "context")
    )
    whole = survivors.join(folded.select("d", "k", "at"), ["d", "k", "at"], "left_anti").select(
        "d",
        "k",
        (F.shiftright("at", 16) - F.shiftright("at", 8).bitwiseAND(F.lit(255))).alias("s"),
        (F.shiftright("at", 16) - F.col("at").bitwiseAND(F.lit(255)) + length).alias("e"),
    )
    several = staged(folded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    open_ = folded.join(several, "bucket")
    spans = whole.unionByName(_repeats_together(open_.filter(F.col("n") <= CROWDED), length))
    spans = spans.unionByName(_repeats_apart(open_.filter(F.col("n") > CROWDED), length))
    lists = spans.groupBy("d", "k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = texts.select("d", "k", "raw", "rest").join(lists, ["d", "k"], "left").join(copies, ["d", "k"], "left").select("d", "raw", "rest", "spans", "copy")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "raw"):
            size, gone, runs, kept = [], [], [], []
            for raw, spans, copy in zip(block.column("raw"), block.column("spans"), block.column("copy")):
                raw = raw.as_py()
                size.append(len(raw))
                cut = np.zeros(len(raw) + 1, np.int32)
                if copy.is_valid and len(raw) >= length:
                    cut[0] = 1
                elif spans.is_valid:
                    np.add.at(cut, spans.values.field("s").to_numpy(), 1)
                    np.subtract.at(cut, spans.values.field("e").to_numpy(), 1)
                out = np.cumsum(cut[:-1]) > 0
                gone.append(int(out.sum()))
                runs.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
                kept.append(raw if not gone[-1] else np.frombuffer(raw, np.uint8)[~out].tobytes())
            if as_text:
                kept = [k.decode("utf-8", "ignore") for k in kept]
            numbers = {"d": block.column("d"), "n_bytes": size, "n_removed": gone, "n_spans": runs}
            yield pa.RecordBatch.from_pydict(
                {n: pa.array(v, pa.int64()) for n, v in numbers.items()} | {"kept": pa.array(kept, pa.string() if as_text else pa.binary()), "rest": block.column("rest")}
            )

    rest = rows.schema["rest"].dataType.simpleString()
    out = rows.mapInArrow(run, f"d bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'string' if as_text else 'binary'}, rest {rest}")
    return out.select(
        F.when(F.col("d") < 2**63 - 1, F.col("d")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "rest"
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows and columns of ``docs`` with repeated strings cut out of ``text``.

    Characters of which a part was cut go whole; NULL texts become empty.
    """
    cut = _cut(docs, length, gram, as_text=True)
    return cut.select(*[F.col("kept").alias(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
