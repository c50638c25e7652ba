"""Connected components of a graph given as edges, by alternating stars.

Every round links each node's larger neighbours to its smallest one, then each
node's smaller neighbours likewise (large-star and small-star); after a number of
rounds that grows with the logarithm of the size, each node is linked straight to
the smallest node of its component.  Rounds are equi-joins and aggregates on
narrow rows, cut from their lineage by a checkpoint; a node with very many
neighbours is pre-aggregated, and adaptive execution may split its join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node with an edge: the smallest node of its component.

    Loops and repeated edges are allowed; edges with a null end are ignored.
    """
    links = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    said = None
    while True:
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if now == said or now[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        said = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
