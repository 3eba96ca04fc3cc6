"""Connected components of a table of links, as rounds of joins.

Alternating large-star and small-star steps: every round points nodes at the
smallest neighbour they know, until each component is a star around its
smallest member. A round is two grouped minima, combined before the shuffle,
each joined back on the node, where the minimum side has one row per node: a
hub only makes a skewed partition, which is split. Rounds are written to the
shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewise.sources.scratch import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    ``links`` has the columns a and b (long), in either direction, repeats
    allowed; links to itself and links with a null end are left out.
    """
    links = materialize(links.filter("a <> b").distinct(), "links")
    before, now = None, _state(links)
    while now[0] and now != before:
        starred = _small_star(_large_star(links).distinct()).distinct()
        links = materialize(starred, "links")
        before, now = now, _state(links)
    return links.filter("a > b").select(F.col("a").alias("node"), F.col("b").alias("root"))
