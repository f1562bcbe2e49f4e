"""Connected components of a link table, by turns of large-star and small-star.

Each turn is two aggregations with partial sums and two joins, both of which Spark splits where one node has very
many links. Turns are stored in the shared folder; the driver sees only two numbers per turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.tables import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, "a").filter("b != m").select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every node (`a`, the larger end) and its smaller neighbours are linked to the least of these."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (a, b); the root is the least node that can be reached.

    Null ends and links of a node to itself count as no link. An empty table gives an empty result.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = materialize(
        links.filter("a is not null and b is not null and a != b").select(a.alias("a"), b.alias("b")).distinct()
    )

    def mark(frame: DataFrame) -> tuple:
        sign = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        return tuple(frame.agg(F.count("*"), sign).first())

    before = mark(now)
    while True:
        now = materialize(_small_star(_large_star(now)))
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
