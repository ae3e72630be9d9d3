"""Connected components of a table of links, as Spark jobs.

Large-star and small-star rounds alternate: a node sends its larger neighbours to its smallest
one, then its smaller ones. A neighbourhood is never gathered: its minimum is an aggregate that
combines before the shuffle, and the links are joined with it, a plain equi-join that adaptive
execution splits at a node with very many links. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.workspace import fresh_path


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both).select("a", F.least("a", "low").alias("low"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    low = _lowest(links)
    moved = links.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).distinct()


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as read back, and a signature of the set of them."""
    path, seen = fresh_path(links.sparkSession, "links"), Observation()
    mixed = F.xxhash64("a", "b")
    links.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.sum(mixed % 1_000_000_007).alias("mixed"), F.bit_xor(mixed).alias("xor")
    ).write.parquet(path)
    return links.sparkSession.read.schema(links.schema).parquet(path), tuple(seen.get.values())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that is linked to a smaller one; ``root`` is the smallest reachable.

    ``links`` has two columns of one ordered type. Their order, repeated links and links of a node
    to itself do not matter; links with a null are none. The smallest node of a component has no
    row: it is its own root. No links give no rows.
    """
    left, right = links.columns
    links = links.filter(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("a"), F.least(left, right).alias("b")
    )
    links, signature = _written(links.distinct())
    while signature[0]:
        links, now = _written(_small_star(_large_star(links)))
        if now == signature:
            break
        signature = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
