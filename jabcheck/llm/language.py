"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from jabcheck.llm.common import learned_from, staged, text_blocks

#: Each softmax is over 32 parts. The first is over classes: 16 of frequent tokens by rank,
#: 16 of all others by hash. The next ones are over the words of a class, or its sub-classes.
BITS = 5
WIDTH = 1 << BITS
CLASSES = TAILS = WIDTH // 2
FREQUENT = CLASSES * WIDTH
#: Kinds of features: the token before, the one before that (skip), and both.
KINDS = 3
#: Tokens whose counts tasks know by themselves, at most; other counts come by a join.
KNOWN = 1 << 18
#: Passes of the training, each over all texts to learn from.
ROUNDS = 1
#: Share of the first update that is made, and occurrences a feature is thought to have had
#: before. Later updates take one share in ``KINDS``, with which the likelihood only rises.
RATE, PRIOR = 0.5, 10.0
BATCH = 16_384
#: Sums that are added up at once, and numbers in a piece of a sum.
FAN, PIECE = 64, 1 << 18

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: No word is empty, so the empty one is the end of a text.
END = b""
_SMOOTH = 0.1
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token a code, the distinct tokens by code, and where each text ends.

    Words are split at ASCII white space after A-Z went to lower case; each text has an end.
    """
    flat: list[bytes] = []
    ends = []
    for text in texts:
        flat += (text or "").encode("utf-8", "replace").translate(_LOWER).split()
        flat.append(END)
        ends.append(len(flat))
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    return codes, distinct, np.array(ends, np.int64)


def hashes(distinct: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token."""
    return pd.util.hash_array(distinct, categorize=False).view(np.int64)


@dataclass
class Vocabulary:
    """Counts of the most frequent tokens, sorted by hash, and the frequent ones' ranks."""

    keys: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray  # rank among the frequent tokens, or -1

    def looked_up(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, count (-1 if not held) and rank (-1 if not frequent) of each."""
        keys = hashes(distinct)
        if not len(self.keys):
            return keys, np.full(len(keys), -1), np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        held = self.keys[at] == keys
        return keys, np.where(held, self.counts[at], -1), np.where(held, self.ranks[at], -1)


@dataclass(frozen=True)
class Shape:
    """How far tail classes are divided, and how many rows of weights a level has.

    Both grow with the square root of the number of distinct tokens, without a bound.
    """

    depth: int
    rows: int

    @staticmethod
    def of(kinds: int) -> Shape:
        root = max(1, kinds) ** 0.5
        depth, rows = 1, 1 << 12
        while TAILS << BITS * depth < 4 * root:
            depth += 1
        while rows < 16 * root:
            rows *= 2
        return Shape(depth, rows)

    @property
    def cells(self) -> int:
        return TAILS << BITS * self.depth

    def nodes(self, level: int) -> int:
        """Softmaxes of a level: one over the classes, one a class, then one a part of a tail class."""
        return (1, WIDTH)[level] if level < 2 else TAILS << BITS * (level - 1)

    def slots(self, level: int) -> int:
        """Rows of weights that contexts are hashed to, for each softmax and kind; a power of two."""
        return max(1, self.rows // self.nodes(level))

    def cell_of(self, keys: np.ndarray) -> np.ndarray:
        """The last part that a tail token falls in: its class and ``depth`` digits of its hash."""
        return self._top(keys.view(np.uint64), self.depth)

    @staticmethod
    def _top(u: np.ndarray, digits: int) -> np.ndarray:
        return (u >> np.uint64(60 - BITS * digits)).astype(np.int64)

    def path(self, keys: np.ndarray, ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level the tokens it concerns, the softmax of each, and the part it takes there."""
        u = keys.view(np.uint64)
        tail = ranks < 0
        group = np.where(tail, CLASSES + self._top(u, 0), ranks >> BITS)
        digit = np.where(tail, self._top(u, 1), ranks) & (WIDTH - 1)
        every = np.arange(len(keys))
        out = [(every, np.zeros(len(keys), np.int64), group), (every, group, digit)]
        some = np.flatnonzero(tail)
        for level in range(2, self.depth + 1):
            out.append((some, self._top(u[some], level - 1), self._top(u[some], level) & (WIDTH - 1)))
        return out

    def rows_of(self, level: int, node: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """The row of weights of each token; rows belong to one softmax each."""
        slots = self.slots(level)
        return node * slots + ((hashed >> np.uint64(24)) & np.uint64(slots - 1)).astype(np.int64)


def contexts(keys: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each kind of feature a hash of the tokens it looks at; before a text stands 0."""
    u = keys.view(np.uint64)
    one, two = np.zeros(len(u), np.uint64), np.zeros(len(u), np.uint64)
    one[1:], two[2:] = u[:-1], u[:-2]
    first = np.r_[0, ends[:-1]]
    one[first] = 0
    two[first] = 0
    second = first + 1
    two[second[second < np.minimum(ends, len(u))]] = 0
    pair = (one * _MIX[0]) ^ (two * _MIX[1])
    return [one * _MIX[0], two * _MIX[0], (pair ^ (pair >> np.uint64(31))) * _MIX[0]]


@dataclass
class Model:
    """Logarithms of the shares of all parts, and weights of the features by level and kind."""

    shape: Shape
    shares: list[np.ndarray]
    weights: list[list[np.ndarray]] | None

    @staticmethod
    def from_counts(shape: Shape, frequent: np.ndarray, cells: np.ndarray) -> Model:
        """Without context the model is the smoothed unigram model."""
        counts = [cells.reshape(-1, WIDTH)]
        for _ in range(shape.depth - 1):
            counts.append(counts[-1].sum(1).reshape(-1, WIDTH))
        classes = np.concatenate([frequent.reshape(CLASSES, WIDTH), counts.pop()])
        shares = []
        for table in [classes.sum(1, keepdims=True).T, classes, *counts[::-1]]:
            smooth = table + 0.05
            shares.append(np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32))
        return Model(shape, shares, None)

    def logged(self, level: int, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """The logarithms of a softmax over the shares and the feature rows."""
        total = self.shares[level][node]
        if self.weights:
            for table, r in zip(self.weights[level], rows, strict=True):
                total += table[r]
            total -= np.log(np.exp(total).sum(1, keepdims=True))
        return total

    def batches(self, keys: np.ndarray, ranks: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        """For each level and some of its tokens: tokens, softmax, part, and a row for each kind."""
        hashed = contexts(keys, ends)
        for level, (at, node, part) in enumerate(self.shape.path(keys, ranks)):
            for low in range(0, len(at), BATCH):
                s = slice(low, low + BATCH)
                yield level, at[s], node[s], part[s], [self.shape.rows_of(level, node[s], h[at[s]]) for h in hashed]

    def log10(self, keys: np.ndarray, ranks: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token; of a tail token, that of its cell."""
        out = np.zeros(len(keys))
        for level, at, node, part, rows in self.batches(keys, ranks, ends):
            out[at] += self.logged(level, node, rows)[np.arange(len(at)), part]
        return out / np.log(10)

    def tables(self, kind: type) -> list[list[np.ndarray]]:
        """A table of zeros for each level and kind of feature."""
        n = [self.shape.nodes(i) * self.shape.slots(i) for i in range(self.shape.depth + 1)]
        return [[np.zeros((rows, WIDTH), kind) for _ in range(KINDS)] for rows in n]

    def observe(self, sums: list[list[np.ndarray]], keys: np.ndarray, ranks: np.ndarray, ends: np.ndarray) -> None:
        """Count which parts follow each feature."""
        for level, _, _, part, rows in self.batches(keys, ranks, ends):
            for table, r in zip(sums[level], rows, strict=True):
                np.add.at(table.reshape(-1), r * WIDTH + part, 1)

    def expect(self, sums: list[list[np.ndarray]], keys: np.ndarray, ranks: np.ndarray, ends: np.ndarray) -> None:
        """Add up which parts the model expects after each feature."""
        for level, _, node, _, rows in self.batches(keys, ranks, ends):
            likely = np.exp(self.logged(level, node, rows))
            for table, r in zip(sums[level], rows, strict=True):
                order = np.argsort(r, kind="stable")
                ordered = r[order]
                start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                table[ordered[start]] += np.add.reduceat(likely[order], start, 0)

    def updated(self, observed: list[list[np.ndarray]], expected: list[list[np.ndarray]] | None) -> Model:
        """One step up the gradient, which is observed less expected, scaled for each weight.

        A weight grows by the logarithm of observed over expected. Without weights, a row
        expects the shares of its softmax, so its occurrences tell all.
        """
        weights, rate = [], 1 / KINDS if self.weights else RATE
        for level, tables in enumerate(observed):
            share = np.repeat(np.exp(self.shares[level]), self.shape.slots(level), 0)
            row = []
            for kind, seen in enumerate(tables):
                due = expected[level][kind] if expected else seen.sum(1, keepdims=True) * share
                step = rate * np.log((seen + PRIOR * share) / (due + PRIOR * share))
                old = self.weights[level][kind] if self.weights else 0
                row.append(np.clip(old + step, -20, 20).astype(np.float32))
            weights.append(row)
        return Model(self.shape, self.shares, weights)


def counted(docs: DataFrame) -> DataFrame:
    """``key, c``: how often each token occurs in the rows to learn from, end included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.Series] = []
        size = 0
        for block in text_blocks(batches, "text", 1_000_000):
            codes, distinct, _ = tokens(block.column("text").to_pylist())
            held.append(pd.Series(np.bincount(codes, minlength=len(distinct)), hashes(distinct)))
            size += len(distinct)
            if size > 1_000_000:
                yield _folded(held)
                held, size = [], 0
        if held:
            yield _folded(held)

    rows = docs.filter(learned_from(10)).select("text")
    return rows.mapInArrow(run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def _folded(held: list[pd.Series]) -> pa.RecordBatch:
    counts = pd.concat(held)
    out = counts.groupby(level=0).sum()
    return pa.RecordBatch.from_pydict({"key": out.index.to_numpy(), "c": out.to_numpy()})


def _vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The tokens that tasks hold, and the least count among them.

    A histogram of the logarithms of counts, of some hundred cells, gives the count from
    which tokens are at most ``KNOWN``; only those come to the driver.
    """
    cell = F.floor(F.log2("c") * 8).cast("int")
    cells = sorted(((r["cell"], r["n"], r["least"]) for r in counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    least, total = 2**62, 0
    for _, n, low in cells:
        total += n
        if total > KNOWN:
            break
        least = low
    held = counts.filter(F.col("c") >= least).select("key", "c").toPandas().sort_values("key")
    keys, number = held["key"].to_numpy(np.int64), held["c"].to_numpy(np.int64)
    end = hashes(np.array([END], dtype=object))[0]
    order = np.lexsort((keys, -number, keys != end))[:FREQUENT]  # the end comes first
    ranks = np.full(len(keys), -1)
    ranks[order] = np.arange(len(order))
    return Vocabulary(keys, number, ranks), least


def _pieces(tables: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
    for table in (t for level in tables for t in level):
        flat = table.reshape(-1)
        for low in range(0, len(flat), PIECE):
            yield flat[low : low + PIECE]


def _packed(part: np.ndarray) -> bytes:
    return pa.compress(part.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _added(docs: DataFrame, vocabulary, model: Model, kind: type) -> list[list[np.ndarray]]:
    """What is observed (``np.int64``) or expected (``np.float64``) after each feature, over all texts.

    A task adds up its texts; the sums of the tasks are added by ranges of rows of weights, as
    a tree of ``FAN`` branches.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    in_task = np.int32 if kind is np.int64 else np.float64

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for block in text_blocks(batches, "text", 1_000_000):
            here = sent.value
            sums = here.tables(in_task) if sums is None else sums
            codes, distinct, ends = tokens(block.column("text").to_pylist())
            keys, _, ranks = vocabulary.value.looked_up(distinct)
            (here.observe if kind is np.int64 else here.expect)(sums, keys[codes], ranks[codes], ends)
        if sums is None:
            return
        task = TaskContext.get().partitionId()
        for piece, part in enumerate(_pieces(sums)):
            yield pa.RecordBatch.from_pydict(
                {"task": [task], "piece": [piece], "n": [len(part)], "sum": pa.array([_packed(part.astype(kind))], pa.binary())}
            )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for batch in batches:
            first = first or batch
            for raw, n in zip(batch.column("sum"), batch.column("n").to_pylist(), strict=True):
                part = _unpacked(raw.as_py(), n, kind)
                total = part.copy() if total is None else total + part
        row = {c: first.column(c).slice(0, 1) for c in ("task", "piece", "n")}
        yield pa.RecordBatch.from_pydict(row | {"sum": pa.array([_packed(total)], pa.binary())})

    rows = docs.filter(learned_from(10)).select("text")
    sums = staged(rows.mapInArrow(run, "task bigint, piece bigint, n bigint, sum binary"))
    tasks = (sums.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        sums = sums.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "piece").applyInArrow(summed, sums.schema)
        tasks = -(-tasks // FAN)
    total = model.tables(kind)
    found = {row["piece"]: row for row in sums.collect()}  # as large as one model
    for piece, part in enumerate(_pieces(total)):
        if piece in found:
            part[:] = _unpacked(bytes(found[piece]["sum"]), found[piece]["n"], kind)
    sent.unpersist()
    return total


def _trained(docs: DataFrame, vocabulary, model: Model, rounds: int) -> Model:
    """The model after ``rounds`` steps, each up the gradient over all texts to learn from."""
    if rounds < 1:
        return model
    observed = _added(docs, vocabulary, model, np.int64)
    model = model.updated(observed, None)
    for _ in range(rounds - 1):
        model = model.updated(observed, _added(docs, vocabulary, model, np.float64))
    return model


def _cells(counts: DataFrame, words: Vocabulary, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct tokens of each cell, of all that are not frequent."""
    cell = F.shiftrightunsigned("key", 60 - BITS * shape.depth)
    rare = counts.filter(~F.col("key").isin(words.keys[words.ranks >= 0].tolist()))
    found = rare.groupBy(cell.alias("cell")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toPandas()
    sums = np.zeros(shape.cells), np.zeros(shape.cells)
    for total, column in zip(sums, ("c", "n"), strict=True):
        total[found["cell"].to_numpy(np.int64)] = found[column]
    return sums


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    ``base_score`` is log10 of the text under smoothed token counts, ``score`` under the
    maximum-entropy model: a softmax over classes given the two tokens before (each, and the
    pair, hashed), then one over the words of the class if it is one of frequent words. All
    other words are in classes that are divided by softmaxes into cells, about as many as
    the square root of the vocabulary or more, and have their smoothed share of the cell, in
    which unseen tokens are one token more. Both sums run over all words and the end. With
    one round, which adds up whole numbers, scores do not depend on files. Counts cover every row whose ``doc_id`` crc32 is no multiple of
    10; a NULL id is held out. NULL and empty texts are one end. With nothing to learn from,
    counts are 0. Repeated rows count each time; extra columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    counts = staged(counted(docs))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, least = _vocabulary(counts)
    frequent = np.zeros(FREQUENT)
    ranked = words.ranks >= 0
    frequent[words.ranks[ranked]] = words.counts[ranked]
    shape = Shape.of(kinds)
    cell_tokens, cell_kinds = _cells(counts, words, shape)
    sent_words = context.broadcast(words)
    model = _trained(docs, sent_words, Model.from_counts(shape, frequent, cell_tokens), rounds)
    sent = context.broadcast(model)
    below = np.log10(total + _SMOOTH * (kinds + 1))
    sent_cells = context.broadcast(np.log10(cell_tokens + _SMOOTH * (cell_kinds + 1)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for block in text_blocks(batches, "text", 1_000_000):
            codes, distinct, ends = tokens(block.column("text").to_pylist())
            key, count, ranks = sent_words.value.looked_up(distinct)
            starts = np.r_[0, ends[:-1]]
            held = np.where(count >= 0, np.log10(np.maximum(count, 0) + _SMOOTH), 0.0)
            share = np.where(ranks < 0, held - sent_cells.value[shape.cell_of(key)], 0.0)
            summed = lambda x: np.add.reduceat(x, starts)
            row = np.repeat(np.arange(len(ends)), ends - starts)
            asked = count[codes] < 0
            pair, times = np.unique(row[asked] * np.int64(len(distinct)) + codes[asked], return_counts=True)
            bounds = np.searchsorted(pair, np.arange(len(ends) + 1) * np.int64(len(distinct)))
            offsets = pa.array(bounds.astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "row": number + np.arange(len(ends)),
                "doc_id": block.column("doc_id"),
                "held_out": block.column("held_out"),
                "n_tokens": ends - starts,
                "known": summed((count >= 0)[codes].astype(np.int64)),
                "base": summed(held[codes]) - (ends - starts) * below,
                "model": summed(sent.value.log10(key[codes], ranks[codes], ends) + share[codes]),
                "keys": pa.ListArray.from_arrays(offsets, pa.array(key[pair % len(distinct)])),
                "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            })
            number += len(ends)

    rows = docs.select(docs["doc_id"].alias("doc_id"), (~learned_from(10)).alias("held_out"), docs["text"].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    part = staged(
        rows.mapInArrow(
            run,
            f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, model double, keys array<bigint>, times array<int>",
        )
    )
    asked = part.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    rare = counts.filter(F.col("c") < least).select("key", "c")
    c = F.coalesce("c", F.lit(0))
    more = (
        asked.join(rare, "key", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10(c + _SMOOTH)).alias("more"),
        )
    )
    return part.drop("keys", "times").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
