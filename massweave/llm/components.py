"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that has a link; ``root`` is the smallest node reachable.

    ``links`` has the columns ``a, b`` of any sortable type. Each round is two joins on links and is
    written to the shared folder; rounds grow with the logarithm of a component's diameter. A hub
    meets one pre-aggregated row, which is written before the join, so that adaptive execution can
    split the partition of a hub of any size.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large)
        near = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(near, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(small)
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(edges)
        for step in (large, least, near):
            discard(step)
        edges = after
        if seen == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
