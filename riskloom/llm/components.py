"""Connected components of a link table, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import written
from riskloom.session import scratch

MAX_ROUNDS = 60


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """The smallest node reachable from every linked node: (``node``, ``root``).

    Alternates two steps on links (child, parent) with child > parent. Large star:
    every node links its larger neighbours to its smallest neighbour. Small star:
    every node links its smaller neighbours to the smallest of them.
    Both keep what is connected, and repeat until nothing changes; the rounds grow with the logarithm of
    the longest path. Each node's minimum is an aggregate with map-side combination,
    and links of a node with very many of them meet it in a merge join that Spark can split.

    Nodes without links are not returned; an empty link table gives no rows. Repeated links and links of a node with itself
    change nothing. Raises if ``MAX_ROUNDS`` do not suffice.
    """
    with scratch(links.sparkSession) as folder:
        edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
        for _ in range(MAX_ROUNDS):
            both = edges.union(edges.select("parent", "child")).toDF("node", "other")
            least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
            large = both.where("other > node").join(least, "node").select(F.col("other").alias("child"), F.col("m").alias("parent"))
            first = large.groupBy("child").agg(F.min("parent").alias("m"))
            small = large.join(first, "child")
            after = (
                small.select(F.col("parent").alias("child"), F.col("m").alias("parent"))
                .union(first.select("child", F.col("m").alias("parent")))
                .where("child != parent")
                .distinct()
            )
            after = written(after, folder)
            # Done when every child has one parent and no parent is a child: the links are stars.
            roles = after.select("child", F.lit(1).alias("of")).union(after.select("parent", F.lit(0)))
            held = roles.groupBy("child").agg(F.sum("of").alias("parents"), F.min("of").alias("least"))
            if held.where("parents > 1 or parents > 0 and least = 0").isEmpty():
                tops = after.select("parent").distinct()
                return written(after.toDF("node", "root").union(tops.select("parent", "parent")))
            edges = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
