"""A quality score: histogram gradient-boosted trees over statistics of the text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jabcheck.llm.common import learned_from, staged, text_blocks

#: Labelled rows a model is fitted on, at most. This bounds what the driver holds.
SAMPLE = 20_000
#: A score of at least this is a prediction of 1.
THRESHOLD = 0.3
#: Words in a part of a text that gets statistics of its own.
PART = 64

MEASURES = (
    "upper", "digit", "space", "mark", "odd_mark", "bang", "bar", "non_ascii", "line_feed",
    "mean_word", "long_word", "distinct", "top_word", "repeats", "marked_end", "upper_word", "capital_word",
)
FEATURES = ("log_chars", "log_words", "log_lines", *MEASURES, "repeated_lines", *(f"worst_{m}" for m in MEASURES))

_CLASS = np.zeros(256, np.uint8)
for _number, _bytes in enumerate(
    (range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b".,;:'\"()-", b"#$%&*@^~+=<>/\\_{}[]`?", b"!", b"|", range(128, 256), b"\n"), 1
):
    _CLASS[list(_bytes)] = _number


def _measured(words: list[str], text: str) -> list[float]:
    """``MEASURES`` of some words and the text they stand in."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    shares = np.bincount(_CLASS[raw], minlength=10)[1:] / max(1, len(raw))
    n = max(1, len(words))
    counts = Counter(words)
    return [
        *shares.tolist(),
        sum(map(len, words)) / n,
        sum(len(w) > 20 for w in words) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(not w[-1].isalnum() for w in words) / n,
        sum(map(str.isupper, words)) / n,
        sum(w[0].isupper() for w in words) / n,
    ]


def features(text: str | None) -> list[float]:
    """``FEATURES`` of a whole text; NULL counts as empty.

    Besides the text as a whole, every run of ``PART`` words is measured, and the value
    farthest from the text's own is kept, so that junk inside a sound text shows.
    """
    text = text or ""
    words, lines = text.split(), [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    whole = _measured(words, text)
    parts = [words[i : i + PART] for i in range(0, len(words), PART)]
    if len(parts) > 1:
        if len(parts[-1]) < PART // 2:
            parts[-1] = words[-PART:]
        each = np.array([_measured(p, " ".join(p)) for p in parts])
        far = each[np.abs(each - whole).argmax(0), np.arange(len(MEASURES))]
        worst = far.tolist()
    else:
        worst = whole
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    sizes = [float(np.log1p(x)) for x in (len(text), len(words), len(lines))]
    return [*sizes, *whole, repeated, *worst]


@dataclass(frozen=True)
class Trees:
    """Boosted trees as arrays: one row per tree, its nodes in level order."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right if the value is over this
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row: all trees descend together, level by level."""
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        row = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            total += leaf[node - (leaf.shape[0] - 1)]
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 15, ridge: float = 1.0
) -> Trees:
    """Trees grown level by level on histograms of gradients, for the log loss."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    inner, out = 2**depth - 1, []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            place = (node - first) * bins
            best = np.zeros(nodes)
            for j in range(width):
                cell = place + binned[:, j]
                gs, hs, cs = (np.bincount(cell, w, nodes * bins).reshape(nodes, bins).cumsum(1) for w in (g, h, None))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(cs < least) | (ct - cs < least)] = 0
                gain = gain[:, : len(edges[j])]
                if not gain.size:
                    continue
                where = gain.argmax(1)
                top = gain[np.arange(nodes), where]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k] = top[k]
                    feature[first + k], at[first + k], cut[first + k] = j, where[k], edges[j][where[k]]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > at[node])
        leaf = node - inner
        leaves = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += leaves[leaf]
        out.append((feature, cut, leaves))
    if not out:
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    return Trees(base, *map(np.stack, zip(*out)))


def _featured(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id, learn, x`` and, if asked, ``row`` with all columns of ``docs``."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), learned_from(5).alias("learn"), docs["text"].alias("text"))
    if carry:
        rows = docs.select(*[docs[c].alias(c) for c in ("doc_id", "text")], learned_from(5).alias("learn"), F.struct(*docs.columns).alias("row"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            values = np.array([features(t) for t in block.column("text").to_pylist()], np.float32)
            flat = pa.array(values.ravel())
            columns = {
                "doc_id": block.column("doc_id"),
                "learn": block.column("learn"),
                "x": pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)), flat),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"row": block.column("row")} if carry else {}))

    return rows.mapInArrow(run, f"doc_id {kind}, learn boolean, x array<float>{more}")


def learned(featured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` labelled rows, those whose ids hash lowest.

    Rows without a label, with NULL or with a held-out id teach nothing. Of several labels of
    one id the smallest counts. Without any labelled row every score is 0.5.
    """
    known = (
        labels.filter("doc_id is not null and quality is not null")
        .filter(learned_from(5))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # the rows of the sample are bounded, so this broadcast is
    rows = featured.filter("learn").join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    pairs = rows.select("x", "quality").collect()
    if not pairs:
        return fit(np.zeros((2, len(FEATURES))), np.array([0.0, 1.0]), trees=0)
    x = np.array([r[0] for r in pairs], np.float32).astype(float)
    return fit(x, np.array([float(r[1] > 0) for r in pairs]))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    A score depends on the text alone. NULL and empty texts are scored like any other, by
    statistics that are all 0. Each row gives one row; ids may be NULL or repeat, extra
    columns are ignored.
    """
    featured = staged(_featured(docs))
    scored = _scored(featured, learned(featured, labels, sample))
    return scored.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns."""
    featured = staged(_featured(docs, carry=True))
    scored = _scored(featured, learned(featured, labels, sample))
    return scored.filter(F.col("score") >= threshold).select("row.*")


def _scored(featured: DataFrame, trees: Trees) -> DataFrame:
    """``featured`` with ``score`` in the place of ``x``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)).astype(float)
            rest = {c: batch.column(c) for c in batch.schema.names if c != "x"}
            yield pa.RecordBatch.from_pydict(rest | {"score": trees.score(x)})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in featured.schema if f.name != "x")
    return featured.mapInArrow(run, f"{kinds}, score double")
