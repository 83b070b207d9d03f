"""Connected components of a stored link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.scale.storage import lay_down


def _toward_smallest(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: neighbours of each node are tied to its smallest neighbour.

    Large steps move the larger neighbours, small steps the node and its smaller
    ones. Only minima are gathered per node; a hub's links stay rows.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not larger:
        both = both.where("v < u")
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_v"))
    least = least.select("_u", F.least("_u", "_v").alias("_m"))
    met = both.join(least, F.col("u") == F.col("_u"))
    if larger:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(
            least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has a link.

    ``links`` holds bigint columns u and v, in any direction, repeated or not;
    links of a node to itself give nothing. Large and small star steps alternate
    until the edges stand still; every step is stored.
    """
    up = F.greatest("u", "v")
    edges = lay_down(
        links.where("u <> v").select(up.alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    state = None
    while True:
        edges = lay_down(_toward_smallest(lay_down(_toward_smallest(edges, True), "large-star"), False), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
