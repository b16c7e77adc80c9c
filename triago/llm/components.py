"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triago.llm.common import written


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its partners. Sums go before the shuffle; the join's hot side can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return pairs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _least(down)
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v: the same ordered type) that is not its component's least node.

    Each step is written to the shared folder. Steps end when the links no longer change; every link then joins a node
    with the least one of its component. Links of a node with itself count for nothing; an empty table gives none.
    """
    links, before = written(links.where("u <> v").select("u", "v").distinct()), None
    while True:
        links = written(_small_star(_large_star(links).distinct()).where("u <> v").distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
