"""Connected components of an edge table by alternating large and small stars.

Every round connects each node to the smallest neighbour known so far, first
for its larger neighbours (large star), then for its smaller ones (small
star), until the edges form stars around the smallest node of each
component. Minima are taken with map-side combining, so a hub with a third
of all edges sends one row per task; the join that hands the minimum back is
a plain equi-join that adaptive execution splits when one key is hot. Each
round's edges are written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut


def _handed_back(edges: DataFrame, key: str) -> DataFrame:
    """``edges`` (big, small) with ``low``: the smallest neighbour of the node in ``key``."""
    other = "small" if key == "big" else "big"
    # written, so that both sides of the join are plain exchanges, which adaptive execution can split
    low = cut(edges.groupBy(key).agg(F.min(other).alias("low")))
    return edges.join(low, key)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("big", "small").union(edges.select(F.col("small").alias("big"), F.col("big").alias("small")))
    low = cut(both.groupBy("big").agg(F.min("small").alias("low")).withColumn("low", F.least("big", "low")))
    return (both.where("small > big").join(low, "big")
            .select(F.col("small").alias("big"), F.col("low").alias("small")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    seen = _handed_back(edges, "big")
    return (seen.select("big", F.col("low").alias("small"))
            .union(seen.where("small != low").select(F.col("small").alias("big"), F.col("low").alias("small")))
            .distinct())


def _is_star_forest(edges: DataFrame) -> bool:
    many = edges.groupBy("big").count().where("count > 1").limit(1).count()
    if many:
        return False
    centres = edges.select(F.col("small").alias("big")).distinct()
    return edges.join(centres, "big", "left_semi").limit(1).count() == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link; ``root`` is the smallest node of its component.

    Nodes without links do not appear; a root appears with itself. No edges
    give an empty result; repeated edges and self-links change nothing.
    """
    e = cut(edges.where(F.col(a) != F.col(b))
            .select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).distinct())
    while not _is_star_forest(e):
        e = cut(_small_star(_large_star(e)))
    return (e.select(F.col("big").alias("node"), F.col("small").alias("root"))
            .union(e.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct()))
