"""Connected components of a link table by alternating large-star and small-star steps.

Each step is an aggregation and an equi-join; no node's neighbours are ever
gathered in one row. Between rounds the links are written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reverie.llm.common import cut, drop_table


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. ``links`` has a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node in ``links`` (columns a, b, any order); component: the smallest node.

    Loops and repeated links are allowed; null ends are left out; no links, no rows.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a < b").distinct()
    links = cut(links)
    state = _state(links)
    for _ in range(most_rounds):
        if not state[0]:
            break
        new = cut(_small_star(_large_star(links)))
        drop_table(links)
        links, before = new, state
        state = _state(links)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select("a", F.col("a")).distinct())
