"""Connected components by alternating large-star and small-star rounds, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def settled(links: DataFrame) -> bool:
    """Whether links (a, b), b < a and distinct, are stars: each a has one b, which is no a itself. Another round wouldn't change them."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a long, b long): root is the component's smallest node.

    Each round points nodes at smaller neighbours and halves the depth of what remains, so the rounds grow as the logarithm of the
    longest path. A round is two aggregations and two joins on node ids and is written to the shared folder; only
    whether a node still has two neighbours or a parent that isn't a root comes to the driver. Loops (a = b) and repeated edges are fine; no edges give no rows.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(both.select(F.col("v"), F.col("u")))
        if not large:
            both = both.where("v <= u")
        # stored, so that the join below deals both sides out itself and may split a node with very many neighbours
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        far = both.where("v > u" if large else "v < u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            far = far.union(least.select(F.col("u"), F.col("m")))
        return far.where("a <> b").distinct()

    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while not settled(links):
        links = stored(star(star(links, True), False), "links")
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), F.col("root"))).distinct()
