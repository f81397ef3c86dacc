"""Mixing sources to target weights: blocks of words, drawn by shard through index permutations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from jabcheck.llm.common import SPACE, staged

#: Words of a block.
BLOCK = 64
#: Slots of an output shard, each of which takes one block.
SLOTS = 4096
#: A source gives each of its blocks at most so many times.
MOST = 3
#: Rows of a part of a source, in which places are counted by one task.
PART = 10_000
#: Shards whose draws are numbered by one task.
TOGETHER = 1000
#: Sources of a mix at most; more are an error.
MOST_SOURCES = 100_000
#: Copies of one row that are unrolled from one array.
CHUNK = 10_000


def size_of(text: Column) -> Column:
    """The number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """``source``, ``source_size`` with ``number`` (from 0), ``weight`` and ``target``.

    Sources come in order of their code points, NULL last, and weigh 1, 2, 3, 1, ... They share
    the sum of sizes by weight, but none gets more than :data:`MOST` times its size: the
    targets are the smaller of that and a level times the weight. The level is found in one
    pass over the sources by the level at which each reaches its limit. One short row a source
    is all that the windows hold.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rows = sources.withColumn("number", F.row_number().over(by_name) - 1)
    rows = rows.withColumns({"weight": F.col("number") % 3 + 1, "most": MOST * F.col("source_size")})
    before = Window.orderBy(F.col("most") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left / weights)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    rows = rows.withColumn("level", F.max(fits).over(every))
    return rows.select("source", "source_size", "number", "weight", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, number, size, start`` of each row, and the sources with targets and ``blocks``.

    The words of a source lie behind one another; ``start`` is where a row's words begin. The
    order is by a hash of id and text, so it does not depend on files. Equal rows are folded
    first and unrolled after. A source is dealt into parts of about :data:`PART` rows by that
    hash; places are counted in parts, and the sums of parts by source.
    """
    text = docs["text"]
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        docs["source"].alias("source"),
        size_of(text).alias("size"),
        F.xxhash64(text).alias("content"),
    )
    rows = staged(rows.groupBy("doc_id", "source", "size", "content").agg(F.count(F.lit(1)).alias("copies")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = targets(sizes).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("bigint"))
    sources = staged(sources)
    parts = -(-rows.count() // PART) or 1
    mixed = F.xxhash64("doc_id", "content")
    rows = rows.join(sources.select("source", "number"), rows["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "number", "size", "content", "copies", mixed.alias("mixed"), F.pmod(F.hash("doc_id", "content"), F.lit(parts)).alias("part")
    )
    inside = Window.partitionBy("number", "part").orderBy("mixed", "doc_id", "content", "size")
    rows = staged(
        rows.withColumn("total", F.col("size") * F.col("copies")).withColumn("start", F.sum("total").over(inside) - F.col("total"))
    )
    sums = rows.groupBy("number", "part").agg(F.sum("total").alias("total"))
    over = Window.partitionBy("number").orderBy("part")
    sums = staged(sums.select("number", "part", (F.sum("total").over(over) - F.col("total")).alias("offset")))
    rows = rows.join(sums, ["number", "part"]).withColumn("start", F.col("start") + F.col("offset"))
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(CHUNK).cast("bigint")))
    rows = rows.withColumn("chunk", chunk)
    copy = F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + CHUNK, F.col("copies")) - 1))
    rows = rows.withColumn("copy", copy).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    return staged(rows.select("doc_id", "number", "size", "content", "start")), sources


def shard_draws(sources: DataFrame, seed: int) -> DataFrame:
    """``shard, number, n, first, before, size, blocks``: how many blocks each shard draws from each source.

    A source's slots are in proportion to its target, counted in its own blocks. A shard gives
    each source the whole part of its expectation; the slots left over are drawn from a
    multinomial over the fractions, so shares are near the targets at any size. ``first``
    numbers the draws of a source through all shards, ``before`` those of a shard through all
    sources. The sources are parameters of every draw, so their number is bounded.
    """
    wanted = sources.filter("source_size > 0 and target > 0").orderBy("number").limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"a mix has {MOST_SOURCES} sources at most")
    number, blocks = np.array([r["number"] for r in wanted], np.int64), np.array([r["blocks"] for r in wanted], np.int64)
    share = np.array([r["target"] * r["blocks"] / r["source_size"] for r in wanted])
    slots = int(round(share.sum()))
    share = share / share.sum() if len(share) else share

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"].tolist():
                size = min(SLOTS, slots - shard * SLOTS)
                n = np.floor(size * share).astype(np.int64)
                left = int(size - n.sum())
                if left > 0:
                    rest = size * share - n
                    n += np.random.default_rng([seed, shard]).multinomial(left, rest / rest.sum())
                yield pd.DataFrame({"shard": shard, "number": number, "n": n, "before": np.cumsum(n) - n, "size": size, "blocks": blocks})

    rows = sources.sparkSession.range(-(-slots // SLOTS))
    counts = staged(rows.mapInPandas(draw, "shard bigint, number int, n bigint, before bigint, size bigint, blocks bigint").filter("n > 0"))
    counts = counts.withColumn("many", F.floor(F.col("shard") / TOGETHER))
    inside = Window.partitionBy("number", "many").orderBy("shard")
    sums = counts.groupBy("number", "many").agg(F.sum("n").alias("total"))
    over = Window.partitionBy("number").orderBy("many")
    sums = staged(sums.select("number", "many", (F.sum("total").over(over) - F.col("total")).alias("offset")))
    first = F.sum("n").over(inside) - F.col("n") + F.col("offset")
    return counts.join(sums, ["number", "many"]).withColumn("first", first).drop("many", "total", "offset")


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each index in a pseudorandom permutation of ``0 .. n - 1`` that ``key`` names.

    A Feistel network of four rounds permutes the smallest square of a power of two that holds
    ``n``; places beyond ``n`` are permuted again, which stays a permutation.
    """
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo].astype(np.int64).view(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            mixed = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def mixture(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix, the rows in their places and the sources.

    The mix is ``shard, slot, number, block, doc_id, start, first, words``: each slot of a
    shard holds a block of one source, and a block the pieces of one or more rows, each
    ``words`` words from its word ``first`` on. ``number`` is that of the source; ``number``
    and ``start`` name the row. Draws of a source run through a permutation of its blocks, then
    through another one, so no block is taken again before all others have been, and none more
    than :data:`MOST` times; the few draws beyond that, when a target is at its limit, stay empty.
    """
    rows, sources = placed(docs)
    draws = shard_draws(sources, seed)

    @pandas_udf("bigint")
    def shuffled(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), n.to_numpy(), key.to_numpy()))

    slots = draws.withColumn("j", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    slots = slots.filter(F.col("j") < MOST * F.col("blocks"))
    turn = F.floor(F.col("j") / F.col("blocks"))
    slots = slots.select(
        "shard",
        shuffled(F.col("before") + F.col("j") - F.col("first"), "size", F.xxhash64(F.lit(seed), "shard")).alias("slot"),
        "number",
        shuffled(F.col("j") % F.col("blocks"), "blocks", F.xxhash64(F.lit(seed), "number", turn)).alias("block"),
    )
    slots = staged(slots)  # its size is known then, so it is broadcast only where it is small
    begin, end = F.col("start"), F.col("start") + F.col("size")
    last = F.floor((end - 1) / BLOCK)
    pieces = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(begin / BLOCK), last)))
    low, high = F.greatest(begin, F.col("block") * BLOCK), F.least(end, (F.col("block") + 1) * BLOCK)
    pieces = pieces.select("doc_id", "number", "start", "block", (low - begin).alias("first"), (high - low).alias("words"))
    mix = slots.join(staged(pieces), ["number", "block"])
    return mix.select("shard", "slot", "number", "block", "doc_id", "start", "first", "words"), rows, sources


def taken(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row: the words that the mix takes of it.

    Sizes are words; NULL texts and those of white space have none and give none. A NULL
    source is a source of its own, a NULL id is an id. Equal rows are rows of their own. No row
    gives more than :data:`MOST` times its words. Equal input gives equal results, whatever
    the files. Extra columns are ignored.
    """
    mix, rows, sources = mixture(docs, seed)
    sums = mix.groupBy("number", "start").agg(F.sum("words").alias("taken"))
    has = rows["size"] > 0
    joined = rows.alias("r").join(sums.alias("t"), (F.col("r.number") == F.col("t.number")) & (F.col("r.start") == F.col("t.start")) & has, "left")
    joined = joined.join(sources.alias("s"), F.col("r.number") == F.col("s.number"))
    return joined.select("r.doc_id", "r.size", "s.source_size", F.col("s.target"), F.coalesce("t.taken", F.lit(0).cast("bigint")).alias("taken"))
