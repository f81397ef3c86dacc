"""Hard negatives by an inverted multi-index, searched until the windows are certified."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jabcheck.llm.common import staged

#: Rows that the codebooks are fitted on at most; all rows are indexed.
SAMPLE = 20_000
#: Rows of a cell on average, and centres of a half at most.
CELL_ROWS, MOST_CENTRES = 512, 256
#: Rows of a block of a cell, and anchors of a tile; a task compares one with the other.
BLOCK, TILE = 1024, 1024
#: Rows that the first round visits for an anchor; each further round visits this many times more.
FIRST, FASTER = 4096, 16
#: Inner products up to this size are exact in doubles.
EXACT = 2.0**53


def vectors(table: DataFrame) -> DataFrame:
    """``row, id, label, vec`` of the rows that take part, ``vec`` as whole numbers.

    Components are multiplied by 256 and rounded down. Where ``vec_id`` is a multiple of 7 the
    label moves on by one, modulo 10. Rows with a NULL label or vector, or with a component
    that is NULL, NaN or infinite, are left out.
    """
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select("vec_id", "embedding", "label").filter(F.col("label").isNotNull() & x.isNotNull()).filter(whole)
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("bigint").alias("id"),
        label.cast("int").alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("vec"),
    )
    return rows


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of doubles; shorter ones are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _fitted(points: np.ndarray, centres: int, rounds: int = 8) -> np.ndarray:
    """Centres of the points by Lloyd's rounds from an even choice of rows."""
    found = points[np.linspace(0, len(points) - 1, centres).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(points, found)
        sums = np.zeros_like(found)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=centres)
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


class Books:
    """The two codebooks, the radius of each of their cells, and the rows of each pair of cells."""

    def __init__(self, halves: list[np.ndarray], radii: list[np.ndarray], rows: np.ndarray, largest: float):
        self.halves, self.radii, self.rows, self.largest = halves, radii, rows, largest

    def bounds(self, vector: np.ndarray) -> list[np.ndarray]:
        """For each half cell the most that its rows can add to an inner product with the vector."""
        cut = self.halves[0].shape[1]
        parts = (vector[:cut], vector[cut:])
        return [c @ v + r * np.sqrt(v @ v) for c, v, r in zip(self.halves, parts, self.radii)]

    def visits(self, vector: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """The cells in descending order of summed bounds, by a heap over both sorted halves."""
        left, right = self.bounds(vector)
        a, b = np.argsort(-left), np.argsort(-right)
        heap = [(-(left[a[0]] + right[b[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield int(a[i]), int(b[j]), -bound
            if j + 1 < len(b):
                heapq.heappush(heap, (-(left[a[i]] + right[b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(left[a[i + 1]] + right[b[0]]), i + 1, 0))


def indexed(rows: DataFrame) -> tuple[DataFrame, Books]:
    """All rows with their ``cell`` and ``block``, and the codebooks.

    The codebooks are fitted on :data:`SAMPLE` rows, chosen by a hash; the number of centres
    grows with the root of the rows, up to :data:`MOST_CENTRES`, beyond which cells grow and
    are split into more blocks. The driver holds one number for each pair of centres.
    """
    n, width, size = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v))).first()
    width, largest = int(width or 0), float(size or 0.0)
    if largest >= 2.0**62:
        raise ValueError("inner products do not fit in 64 bits")
    cut = (width + 1) // 2
    centres = int(min(MOST_CENTRES, max(1, math.isqrt(n // CELL_ROWS)))) if n else 1
    chosen = rows.orderBy(F.xxhash64("id", "vec")).limit(SAMPLE).select("vec").toArrow() if n else None
    sample = _matrix(chosen.column("vec"), width) if n else np.zeros((1, width))
    halves = [_fitted(half, centres) for half in (sample[:, :cut], sample[:, cut:])]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column("vec"), width)
            near = [_nearest(p, c) for p, c in zip((points[:, :cut], points[:, cut:]), halves)]
            far = [np.sqrt(((p - c[k]) ** 2).sum(1)) for p, c, k in zip((points[:, :cut], points[:, cut:]), halves, near)]
            more = [("left", near[0].astype(np.int32)), ("right", near[1].astype(np.int32)), ("far_left", far[0]), ("far_right", far[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v) for _, v in more]], [*batch.schema.names, *[k for k, _ in more]])

    found = rows.mapInArrow(assign, "row bigint, id bigint, label int, vec array<bigint>, left int, right int, far_left double, far_right double")
    found = staged(found)
    radii = []
    for side in ("left", "right"):
        most = np.zeros(centres)
        for r in found.groupBy(side).agg(F.max(f"far_{side}").alias("far")).collect():  # one number a centre
            most[r[side]] = r["far"]
        radii.append(most)
    held = np.zeros((centres, centres), np.int64)
    for r in found.groupBy("left", "right").count().collect():  # one number a pair of centres
        held[r["left"], r["right"]] = r["count"]
    cell = F.col("left") * centres + F.col("right")
    # a cell's rows are dealt over its blocks by a hash, so blocks are near BLOCK rows and none is a task's whole cell
    sizes = found.groupBy("left", "right").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocked = found.join(sizes, ["left", "right"])
    blocked = blocked.select("row", "id", "label", "vec", cell.alias("cell"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"))
    return staged(blocked), Books(halves, radii, held, largest)


def search(queries: DataFrame, index: DataFrame, books: Books, same: bool, k: int) -> DataFrame:
    """``anchor, window, score, id, row``: the first ``k`` rows of each window of each query.

    Queries are ``anchor`` (a dense number), ``own`` (the row itself, left out), ``label``,
    ``vec`` and ``windows``, a list of ``low`` and ``high`` for 100 times the score. With
    ``same`` only rows of the query's label count, else only those of other labels. Higher
    scores come first, then smaller ids, NULL last.

    A round visits the next cells of each open query in the order of their bounds, 16 times as
    many rows as the round before. Blocks of cells and tiles of queries meet in a task, which
    hands on ``k`` rows a window. A window is certified when its last row scores more than any
    cell still to come can hold, or the cells to come lie below it. Rounds end when all are.
    """
    width = books.halves[0].shape[1] + books.halves[1].shape[1]
    centres = books.halves[0].shape[0]
    slack = 1e-9 * (books.largest + 1.0)
    steps = "anchor bigint, own bigint, label int, vec array<bigint>, windows array<struct<low:bigint,high:bigint>>, done int, floors array<bigint>"

    def requests(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
        """For each query the cells of this round, and one row (cell -1) with how far it then is."""
        for batch in batches:
            if not batch.num_rows:
                continue
            out: dict[str, list] = {"anchor": [], "cell": [], "done": [], "bound": []}
            points = _matrix(batch.column("vec"), width)
            done, floors = batch.column("done").to_pylist(), batch.column("floors").to_pylist()
            for anchor, point, skip, floor in zip(batch.column("anchor").to_pylist(), points, done, floors):
                need, seen, at, rest = min(floor), 0, 0, None
                for at, (i, j, bound) in enumerate(books.visits(point)):
                    if at < skip:
                        continue
                    if bound + slack < need or seen >= budget:
                        rest = bound + slack
                        break
                    if books.rows[i, j]:
                        seen += int(books.rows[i, j])
                        out["anchor"].append(anchor)
                        out["cell"].append(i * centres + j)
                        out["done"].append(None)
                        out["bound"].append(None)
                out["anchor"].append(anchor)
                out["cell"].append(-1)
                out["done"].append(at if rest is not None else at + 1)
                out["bound"].append(rest)
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("anchor", pa.int64()), ("cell", pa.int32()), ("done", pa.int32()), ("bound", pa.float64())])
            )

    def compared(asked: pa.Table, block: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "window": [], "score": [], "id": [], "row": []}
        if asked.num_rows and block.num_rows:
            left, right = _matrix(asked.column("vec"), width), _matrix(block.column("vec"), width)
            if books.largest < EXACT:
                scores = (left @ right.T).astype(np.int64)
            else:
                scores = np.array([[int(sum(int(x) * int(y) for x, y in zip(a, b))) for b in right] for a in left], np.int64)
            labels, rows = block.column("label").to_numpy(), block.column("row").to_numpy()
            ids = [np.iinfo(np.int64).max if i is None else i for i in block.column("id").to_pylist()]
            null = np.array([i is None for i in block.column("id").to_pylist()])
            order = np.lexsort((rows, ids, null))
            mine = zip(*[asked.column(c).to_pylist() for c in ("anchor", "own", "label", "windows", "floors")])
            for (anchor, own, label, windows, floors), score in zip(mine, scores):
                fits = ((labels == label) == same) & (rows != own)
                for w, (window, floor) in enumerate(zip(windows, floors)):
                    here = order[(fits & (100 * score >= max(window["low"], 100 * floor)) & (100 * score <= window["high"]))[order]]
                    best = here[np.argsort(-score[here], kind="stable")[:k]]
                    out["anchor"] += [anchor] * len(best)
                    out["window"] += [w] * len(best)
                    out["score"] += score[best].tolist()
                    out["id"] += [None if null[b] else ids[b] for b in best]
                    out["row"] += rows[best].tolist()
        schema = [("anchor", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())]
        return pa.Table.from_pydict(out, schema=pa.schema(schema))

    low = F.transform("windows", lambda w: F.ceil(w.low / 100).cast("bigint"))
    state = staged(queries.select("*", F.lit(0).alias("done"), low.alias("floors")).filter(F.size("windows") > 0))
    best = state.select("anchor", F.lit(0).alias("window"), F.lit(0).cast("bigint").alias("score"), F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("row")).limit(0)
    budget = FIRST
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    blocks = staged(index.select("cell", "block").distinct())
    while not state.isEmpty():
        limit = budget
        asked = staged(state.select(*[c.split()[0] for c in steps.split(", ")]).mapInArrow(lambda b: requests(b, limit), "anchor bigint, cell int, done int, bound double"))
        wanted = asked.filter("cell >= 0").select("anchor", "cell").join(blocks, "cell").join(state, "anchor")
        wanted = wanted.withColumn("tile", F.floor(F.col("anchor") / TILE))
        wanted = staged(wanted.select("cell", "block", "tile", "anchor", "own", "label", "vec", "windows", "floors"))
        tiles = wanted.select("cell", "block", "tile").distinct().toDF("cell", "block", "tile")
        here = index.join(tiles, ["cell", "block"])
        keys = ("cell", "block", "tile")
        fresh = wanted.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInArrow(compared, "anchor bigint, window int, score bigint, id bigint, row bigint")
        best = staged(best.unionByName(fresh).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"))
        last = best.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("score"))
        last = last.filter(F.col("n") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("last"))
        progress = asked.filter("cell < 0").select("anchor", F.col("done").alias("now"), "bound")
        moved = state.join(progress, "anchor").join(last, "anchor", "left").filter("bound is not null")
        full = lambda i: F.try_element_at("last", i)
        floors = F.transform("floors", lambda f, i: F.greatest(f, F.coalesce(full(i), f)))
        moved = moved.withColumn("floors", floors).withColumn("done", F.col("now"))
        state = staged(moved.filter(F.col("bound") >= F.array_min("floors")).drop("now", "bound", "last"))
        budget *= FASTER
    return best


def hard_negatives(
    table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, shares: tuple[int, int] = (30, 90)
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose ``vec_id`` is a multiple of ``every``. Their positives are the
    first ``positives`` other rows of the same label by inner product; ties go to the smaller
    ``vec_id``, NULL last. The negatives of a positive are the first ``negatives`` rows of
    another label whose score is within ``shares`` per cent of the positive's, both ends
    included; ``rank`` counts them. Which rows take part, and as what, is in :func:`vectors`.
    Vectors of different lengths are compared as if the shorter had zeros at its end. Rows that
    repeat a ``vec_id`` are rows of their own, as anchors too. Results are exact: the index
    only decides in what order rows are compared. An empty table gives no rows; other columns
    are ignored.
    """
    rows = staged(vectors(table))
    index, books = indexed(rows)
    chosen = rows.filter(F.col("id") % every == 0)
    numbered = staged(_numbered(chosen))
    everything = F.array(F.struct(F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high")))
    queries = numbered.select("anchor", F.col("row").alias("own"), "label", "vec", everything.alias("windows"))
    found = search(queries, index, books, True, positives)
    window = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")) - 1
    found = staged(found.select("anchor", window.alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # a negative score leaves no room between its shares
    span = F.struct((F.col("positive_score") * shares[0]).alias("low"), (F.col("positive_score") * shares[1]).alias("high"))
    usable = found.filter("positive_score >= 0")
    windows = usable.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", span.alias("span")))), lambda x: x.span).alias("windows"))
    queries = numbered.select("anchor", F.col("row").alias("own"), "label", "vec").join(windows, "anchor")
    got = search(queries, index, books, False, negatives)
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row"))
    got = got.withColumn("rank", rank).join(usable.withColumnRenamed("place", "window"), ["anchor", "window"])
    return got.join(numbered.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a dense number ``anchor``, counted by part and then over the parts."""
    part: Column = F.shiftright("row", 33)
    inside = Window.partitionBy("part").orderBy("row")
    rows = rows.withColumn("part", part).withColumn("place", F.row_number().over(inside) - 1)
    sums = rows.groupBy("part").agg(F.count("*").alias("n"))
    sums = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a part
    return rows.join(sums, "part").withColumn("anchor", F.col("place") + F.col("before")).drop("part", "place", "before")
