"""Boilerplate lines by their share of a site's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jabcheck.llm.common import staged

#: A line on more than this share of a site's pages is boilerplate.
RATIO = 0.05
#: A line that no other page of the site has is none.
LEAST_PAGES = 2


def dedup_lines(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, once: bool = False
) -> DataFrame:
    """The rows of ``docs`` without boilerplate lines, with ``n_lines`` and ``n_dropped``.

    Lines end at a line feed and are compared without white space around them. Empty lines
    are never dropped. A line is boilerplate where the pages of its host that contain it are
    at least ``least_pages`` and more than ``ratio`` of the host's pages; a line that repeats
    within a page counts once there. All rows of a host count as pages, copies and empty ones
    too; with ``once``, all rows of a host with one text count as one page, for the line and
    in the total, so the lines of a text are not boilerplate because it has copies. A NULL
    host is a host of its own. A NULL text has no lines and stays NULL. Rows that share id and
    host lose the same lines. All columns of ``docs`` are kept; existing ``n_lines`` and
    ``n_dropped`` are replaced.

    Pages are counted by (host, line hash) with map-side sums, so a line on a third of all
    pages is a few rows. Only boilerplate lines are joined back, on their hash, and come to a
    page as one short list, so texts are moved once.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lines = (
        docs.select(
            F.col("doc_id").alias("id"),
            F.col(host).alias("host"),
            *([_page().alias("page")] if once else []),
            F.explode(
                F.array_distinct(
                    F.transform(F.split("text", "\n"), lambda x: _key(x))
                )
            ).alias("key"),
        )
        .filter("key.size > 0")
    )
    lines = staged(lines)
    counted, held = lines, docs.select(F.col(host).alias("host"), *([_page().alias("page")] if once else []))
    if once:
        counted, held = lines.select("host", "key", "page").distinct(), held.distinct()
    pages = held.groupBy("host").agg(F.count("*").alias("pages"))
    common = counted.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    common = common.alias("c").join(pages.alias("p"), F.col("c.host").eqNullSafe(F.col("p.host")))
    common = staged(common.filter(F.col("n") > ratio * F.col("pages")).select("c.host", "key"))
    met = lines.alias("l").join(
        common.alias("c"), (F.col("l.key") == F.col("c.key")) & F.col("l.host").eqNullSafe(F.col("c.host"))
    )
    drop = met.groupBy(F.col("l.id").alias("id"), F.col("l.host").alias("host")).agg(F.collect_set("l.key").alias("drop"))
    joined = docs.join(drop, docs["doc_id"].eqNullSafe(drop["id"]) & docs[host].eqNullSafe(drop["host"]), "left")
    split = F.split(docs["text"], "\n")
    keep = F.filter(
        split, lambda x: ~F.array_contains(drop["drop"], _key(x))
    )
    kept = F.when(drop["drop"].isNull(), split).otherwise(keep)
    return joined.select(
        *[
            F.when(drop["drop"].isNull(), docs["text"]).otherwise(F.array_join(keep, "\n")).alias("text")
            if c == "text"
            else docs[f"`{c}`"]
            for c in docs.columns
        ],
        F.coalesce(F.size(split), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(split) - F.size(kept), F.lit(0)).alias("n_dropped"),
    )


def _page() -> Column:
    """What texts are compared by: two hashes and the length."""
    return _hashed(F.col("text"))


def _key(line: Column) -> Column:
    """What lines are compared by: two hashes and the length of the trimmed line."""
    return _hashed(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _hashed(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("hash"), F.hash(line).alias("other"), F.length(line).alias("size"))
