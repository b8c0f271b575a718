"""Connected components of a link table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b), any order, any kind of value that sorts -> (node, root): the smallest node that
    each node reaches. Nodes without a link to another do not appear; an empty table gives no rows.

    Large star: each node links its larger neighbours to its smallest one. Small star: each node
    links its smaller neighbours and itself to the smallest. Both keep components, and links only
    ever move towards the root, so after about log(n) rounds only stars are left. Aggregates shrink
    before the shuffle, and no neighbour list is ever gathered. Rounds end in a written table.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    links = common.materialize(links, "links")
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = common.materialize(small.unionByName(smallest.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "links")
        # Only stars are left once no node that others hang from hangs from another itself and each has one link.
        inner = after.select(F.col("b").alias("a")).distinct().join(after, "a", "left_semi").limit(1).count()
        links = after
        if not inner and after.groupBy("a").count().where("count > 1").limit(1).count() == 0:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
    raise RuntimeError("links did not settle")
