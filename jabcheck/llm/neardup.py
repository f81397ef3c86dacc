"""Near duplicates by n-gram Jaccard similarity: MinHash bands of one depth and exact verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from jabcheck.llm.common import staged, text_blocks
from jabcheck.llm.graph import components

#: Words of a shingle, and the similarity from which two texts are near duplicates.
WORDS = 5
SIMILARITY = 0.8
#: Bands, and the most MinHash values of each.
TREES = 16
DEEPEST = 8
#: Share of the links at exactly the threshold that the bands must meet, by the formula.
RECALL = 0.99
#: Texts of a block in verification; a task compares two blocks.
BLOCK = 256
#: Shingles of a block, about; it has fewer texts where they are long.
BLOCK_SHINGLES = 500_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def depth_for(recall: float, similarity: float, trees: int, deepest: int) -> int:
    """The longest prefix at which the bands meet ``recall`` of the pairs of ``similarity``.

    Prefixes start at full length and are shortened by one hash until the share of pairs
    that agree in some tree is high enough.
    """
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix in which every bit of the input matters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, sorted within each, and where each text ends.

    Words are what stands between white space, in lower case. A text of fewer than ``words``
    words has all its words as its one shingle; one without a word has none.
    """
    # a vertical tab and the like separate words, a non-breaking blank does not
    each = [(t or "").lower().encode("utf-8", "replace").split() for t in texts]
    counts = np.array([len(w) for w in each], np.int64)
    flat = [w for ws in each for w in ws]
    if not flat:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=True).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    left = np.repeat(first + counts, counts) - np.arange(len(flat))  # words from here to the end
    value = np.zeros(len(flat), np.uint64)
    for i in range(words):
        here = left > i
        at = np.flatnonzero(here)
        value[at] = _mixed(value[at] * _GOLD + hashed[at + i] + np.uint64(i + 1))
    start = (left >= words) | (np.arange(len(flat)) == np.repeat(first, counts))
    value, doc = value[start], doc[start]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]
    value, doc = value[new], doc[new]
    return value, np.cumsum(np.bincount(doc, minlength=len(texts)))


def signatures(values: np.ndarray, ends: np.ndarray, hashes: int) -> np.ndarray:
    """``hashes`` MinHash values of each text that has shingles, 32 bits each."""
    starts = np.r_[0, ends[:-1]]
    out = np.zeros((len(ends), hashes), np.uint32)
    some = np.flatnonzero(ends > starts)
    if len(some):
        draw = np.random.default_rng(20_011)
        factor = draw.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = draw.integers(0, 1 << 63, hashes, dtype=np.uint64)
        for j in range(hashes):
            drawn = ((values * factor[j] + shift[j]) >> np.uint64(32)).astype(np.uint32)
            out[some, j] = np.minimum.reduceat(drawn, starts[some])
    return out


def shape_of(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One digest for each set of shingles."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(values), dtype=np.uint64)])
    starts = np.r_[0, ends[:-1]]
    return _mixed((sums[ends] - sums[starts]) * _GOLD + (ends - starts).astype(np.uint64)).view(np.int64)


def _signed(docs: DataFrame, words: int, trees: int, depth: int, carry: bool) -> DataFrame:
    """``row, id, size, shape, prefixes``: a digest of the set of shingles, and a prefix in each tree.

    ``row`` is a number of its own for each row; once written it stays. With ``carry`` there
    is ``doc``, a struct of all columns.
    """
    rows = docs.select(docs["doc_id"].cast("bigint").alias("id"), docs["text"].alias("text"), *([F.struct(*docs.columns).alias("doc")] if carry else []))
    more = f", doc {rows.schema['doc'].dataType.simpleString()}" if carry else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for block in text_blocks(batches, "text", 1_000_000):
            values, ends = shingles(block.column("text").to_pylist(), words)
            signs = signatures(values, ends, trees * depth).reshape(len(ends), trees, depth).astype(np.uint64)
            prefix = np.zeros(signs.shape[:2], np.uint64)
            for d in range(depth):
                prefix = _mixed(prefix * _GOLD + signs[:, :, d] + np.uint64(1))
            size, shape = ends - np.r_[0, ends[:-1]], shape_of(values, ends)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(ends) + 1, dtype=np.int32) * trees), pa.array(prefix.view(np.int64).ravel())
            )
            columns = {"row": number + np.arange(len(size)), "id": block.column("id"), "size": size, "shape": shape, "prefixes": lists}
            number += len(size)
            yield pa.RecordBatch.from_pydict(columns | ({"doc": block.column("doc")} if carry else {}))

    return rows.mapInArrow(run, f"row bigint, id bigint, size bigint, shape bigint, prefixes array<bigint>{more}")


def _linked(values: list[np.ndarray], other: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets of the one list are near which of the other: shared elements by matrix product."""
    sizes, sizes2 = np.array([len(v) for v in values]), np.array([len(v) for v in other])
    every = np.concatenate([*values, *other])
    _, code, count = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes) + len(sizes2)), np.r_[sizes, sizes2])
    shared = count[code] > 1
    code, row = code[shared], row[shared]
    column = np.cumsum(count > 1) - 1
    code = column[code]
    both = np.zeros((len(sizes), len(sizes2)), np.float32)
    width = 4096
    for low in range(0, int(code.max(initial=-1)) + 1, width):
        here = (code >= low) & (code < low + width)
        part = np.zeros((len(sizes) + len(sizes2), width), np.float32)
        part[row[here], code[here] - low] = 1
        both += part[: len(sizes)] @ part[len(sizes) :].T
    return both >= similarity * (sizes[:, None] + sizes2 - both) - 1e-6


def _spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that the matrix joins: breadth first from each row in turn."""
    rows, columns = links.shape
    free_rows, free_columns = np.ones(rows, bool), np.ones(columns, bool)
    out = []
    for r in range(rows):
        if not free_rows[r]:
            continue
        free_rows[r], edge = False, [r]
        while edge:
            nxt = []
            for a in edge:
                new = np.flatnonzero(links[a] & free_columns)
                free_columns[new] = False
                out += [(a, b) for b in new]
                for b in new:
                    up = np.flatnonzero(links[:, b] & free_rows)
                    free_rows[up] = False
                    out += [(c, b) for c in up]
                    nxt += up.tolist()
            edge = nxt
    return out


def _verified(sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """``shape, other, links``: of each text and pair of blocks the links, and enough of them to span.

    ``sets`` holds ``root, part, parts, shape, values``. Every two blocks of a group meet in one
    task, which multiplies two small matrices; no pair of texts becomes a row.
    """
    met = sets.withColumn(
        "pair",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("parts") - 1),
                lambda j: F.struct(F.least("part", j).alias("low"), F.greatest("part", j).alias("high")),
            )
        ),
    )

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # at most two blocks
        held = pa.Table.from_batches(list(batches))
        part = held.column("part").to_numpy()
        ids = held.column("shape").to_numpy()
        values = [np.frombuffer(v, np.uint64) for v in held.column("values").to_pylist()]
        low, high = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        links = _linked([values[i] for i in left], [values[i] for i in right], similarity)
        if low == high:
            np.fill_diagonal(links, False)
        counts = [(ids[i], int(n)) for i, n in zip(left, links.sum(1)) if n]
        if low != high:
            counts += [(ids[i], int(n)) for i, n in zip(right, links.sum(0)) if n]
        span = [(ids[left[a]], ids[right[b]]) for a, b in _spanning(links)]
        yield pa.RecordBatch.from_pydict({
            "shape": pa.array([int(i) for i, _ in counts] + [int(a) for a, _ in span], pa.int64()),
            "other": pa.array([None] * len(counts) + [int(b) for _, b in span], pa.int64()),
            "links": pa.array([n for _, n in counts] + [0] * len(span), pa.int64()),
        })

    return (
        met.select("root", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "part", "shape", "values")
        .groupBy("root", "low", "high")
        .applyInArrow(run, "shape bigint, other bigint, links bigint")
    )


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    trees: int = TREES,
    deepest: int = DEEPEST,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, class_id, n_links, class_size, copies, kept`` for each row of ``docs``.

    Two texts are linked when the Jaccard similarity of their sets of word shingles is at
    least ``similarity``. Texts with the same set are copies: they count as one text, the
    one with the smallest ``doc_id``, and share its links; ``copies`` is their number.
    ``n_links`` counts linked texts that are not copies, ``class_id`` is the smallest
    ``doc_id`` that can be reached over links and copies, ``class_size`` the rows of it, and
    ``kept`` marks one row of each class, one with the smallest id. Texts
    without a word (NULL and empty ones too) have no links and no copies. A NULL ``doc_id``
    takes part in nothing and is its own row with a NULL class. Repeated ids with one text are
    copies; each text of a repeated id has its own row. Ids are whole numbers; extra columns
    are ignored.

    MinHash bands find candidates: texts that agree in all values of some band. All bands have
    one depth, the longest that meets ``recall`` by the formula, and not one for each text as in
    an LSH forest. Candidates come as stars around the smallest id of each
    prefix, and their components are groups in which every two texts are verified exactly, in
    blocks. So a large group is many tasks, and only counts and spanning links leave them.
    """
    _, found = _classified(docs, words, similarity, trees, deepest, recall, block, carry=False)
    return found.drop("row")


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` marks as kept, with all their columns."""
    signed, found = _classified(docs, words, similarity, TREES, DEEPEST, RECALL, BLOCK, carry=True)
    return signed.select("row", "doc").join(found.filter("kept").select("row"), "row").select("doc.*")


def _classified(
    docs: DataFrame, words: int, similarity: float, trees: int, deepest: int, recall: float, block: int, carry: bool
) -> tuple[DataFrame, DataFrame]:
    depth = depth_for(recall, similarity, trees, deepest)
    signed = staged(_signed(docs, words, trees, depth, carry))
    known = signed.filter("id is not null and size > 0")
    shapes = staged(
        known.groupBy("shape").agg(
            F.min("id").alias("rep"), F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("copies"), F.min("size").alias("size"), F.min("prefixes").alias("prefixes")
        )
    )
    leaves = shapes.select("shape", F.posexplode("prefixes").alias("tree", "prefix"))
    stars = leaves.groupBy("tree", "prefix").agg(F.min("shape").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = staged(stars)  # sums are stored before a join, which then splits what is hot
    candidates = leaves.join(stars, ["tree", "prefix"]).select(F.col("shape").alias("a"), "b").filter("a <> b").distinct()
    groups = components(candidates).join(shapes.select(F.col("shape").alias("node"), "rep", "size"), "node")
    groups = staged(groups)
    parts = groups.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    parts = staged(parts)
    placed = groups.join(parts, "root").select(
        "root", F.col("node").alias("shape"), "rep", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    )
    verified = staged(_verified(_sets(docs, placed, words), similarity, block))
    links = verified.filter("other is null").groupBy("shape").agg(F.sum("links").alias("links"))
    reached = components(verified.filter("other is not null").select(F.col("shape").alias("a"), F.col("other").alias("b")))
    classes = staged(
        shapes.drop("prefixes", "size")
        .join(links, "shape", "left")
        .join(reached.withColumnRenamed("node", "shape"), "shape", "left")
        .select("shape", "rep", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "shape").alias("root"))
    )
    sizes = staged(classes.groupBy("root").agg(F.sum("copies").alias("class_size"), F.min("first").alias("best")))
    classes = classes.join(sizes, "root").select("shape", "copies", "links", "best", "class_size")
    single = signed.filter("id is null or size = 0").select(
        "row",
        F.col("id").alias("doc_id"),
        F.col("id").alias("class_id"),
        F.lit(0).cast("bigint").alias("n_links"),
        F.lit(1).cast("bigint").alias("class_size"),
        F.lit(1).cast("bigint").alias("copies"),
        F.lit(True).alias("kept"),
    )
    found = known.select("row", "id", "shape").join(classes, "shape").select(
        "row",
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("class_id"),
        F.col("links").alias("n_links"),
        "class_size",
        "copies",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )
    return signed, found.unionByName(single)


def _sets(docs: DataFrame, placed: DataFrame, words: int) -> DataFrame:
    """The shingles of the placed texts, from the texts themselves."""
    texts = docs.select(docs["doc_id"].cast("bigint").alias("rep"), docs["text"].alias("text"))
    rows = placed.join(texts, "rep").select("root", "part", "parts", "shape", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in text_blocks(batches, "text", 1_000_000):
            values, ends = shingles(got.column("text").to_pylist(), words)
            raw, starts = values.tobytes(), np.r_[0, ends[:-1]]
            columns = {c: got.column(c) for c in ("root", "part", "parts", "shape")}
            columns["values"] = pa.array([raw[8 * a : 8 * b] for a, b in zip(starts, ends)], pa.binary())
            # an id may have other texts too
            same = pa.array(shape_of(values, ends) == got.column("shape").to_numpy())
            yield pa.RecordBatch.from_pydict(columns).filter(same)

    kinds = "root bigint, part int, parts int, shape bigint, values binary"
    return rows.mapInArrow(run, kinds).dropDuplicates(["shape"])
