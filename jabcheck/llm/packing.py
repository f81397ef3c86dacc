"""Packing by length buckets that waste the least padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jabcheck.llm.common import SPACE, staged

#: Longest sequence in tokens; longer texts continue in further pieces.
LONGEST = 2048
BUCKETS = 16
#: Tokens of a batch, padding included.
BUDGET = 32_768
#: Pieces that one task ranks.
SHARD = 20_000


def word_count(text: Column) -> Column:
    """Words between white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0))


def bucket_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding in all.

    ``counts[n]`` is the number of pieces of length n, over all lengths up to the longest.
    Dynamic programming over (buckets used, last length); ties go to the smaller bound.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    number = counts[lengths].astype(float)
    below = np.r_[0, np.cumsum(number)]
    tokens = np.r_[0, np.cumsum(number * lengths)]
    least = np.r_[0, np.full(len(lengths), np.inf)]
    cuts = []
    for _ in range(min(buckets, len(lengths))):
        new, cut = np.full(len(lengths) + 1, np.inf), np.zeros(len(lengths) + 1, int)
        new[0] = 0
        for i in range(1, len(lengths) + 1):
            cost = least[:i] + lengths[i - 1] * (below[i] - below[:i]) - (tokens[i] - tokens[:i])
            cut[i] = np.argmin(cost)
            new[i] = cost[cut[i]]
        least = new
        cuts.append(cut)
    bounds, at = [], len(lengths)
    for cut in reversed(cuts):
        if at == 0:
            break
        bounds.append(int(lengths[at - 1]))
        at = int(cut[at])
    return bounds[::-1]


def pack(
    docs: DataFrame,
    n_tokens: Column | None = None,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """``doc_id, piece, start, n_tokens, bucket, batch, slot, padding``, a row for each piece.

    A text of more than ``longest`` tokens is cut into full pieces and a rest, so all of it is
    packed. ``bucket`` is the length its pieces are padded to. Inside each bucket a batch takes
    ``budget // bucket`` pieces (one at least), in an order by hash of id and piece; only the
    last batch of a bucket has fewer. ``n_tokens`` is the words of ``text`` unless another
    expression is given. NULL and empty texts have no tokens and give no piece. Rows without
    an id or with equal ids are packed like others. Other columns are ignored.

    The driver sees the histogram of piece lengths, ``longest`` numbers, and no more. Ranks
    inside a bucket come from shards of about 20,000 pieces and the running total of the
    shards' sizes, so a bucket with most pieces is still many tasks.
    """
    count = (word_count(F.col("text")) if n_tokens is None else F.coalesce(n_tokens, F.lit(0))).cast("bigint")
    pieces = (
        docs.select(F.col("doc_id"), count.alias("all_tokens"))
        .filter("all_tokens > 0")
        .select("doc_id", "all_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("all_tokens") - 1) / longest))).alias("piece"))
        .select(
            "doc_id",
            "piece",
            (F.col("piece") * longest).alias("start"),
            F.least(F.lit(longest), F.col("all_tokens") - F.col("piece") * longest).cast("int").alias("n_tokens"),
        )
    )
    pieces = staged(pieces)
    counts = np.zeros(longest + 1, np.int64)
    for n, c in pieces.groupBy("n_tokens").count().collect():
        counts[n] = c
    bounds = bucket_bounds(counts, buckets)
    shards = int(max(1, -(-counts.sum() // SHARD)))
    bucket = F.lit(None).cast("int")
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, bound).otherwise(bucket)
    mixed = F.xxhash64("doc_id", "piece", "n_tokens")
    placed = pieces.withColumns({"bucket": bucket, "mixed": mixed, "shard": F.pmod(mixed, F.lit(shards))})
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("size"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("bucket", "shard").orderBy("mixed", "doc_id", "piece")
    ranked = placed.withColumn("rank", F.row_number().over(own) - 1).join(sizes, ["bucket", "shard"])
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    place = F.col("before") + F.col("rank")
    return ranked.select(
        "doc_id",
        "piece",
        "start",
        "n_tokens",
        "bucket",
        F.floor(place / fits).alias("batch"),
        (place % fits).alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
