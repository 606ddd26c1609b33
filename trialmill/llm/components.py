"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is a minimum per vertex and one join; a vertex with a third of all links is
combined before the shuffle (minimum) and split by the adaptive skew join (join).  The
rows of a round are written to the shared folder, so plans stay short and a lost executor
repeats one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id in ``links(a, b)``; component_id is the smallest reachable id.

    Links may repeat, point either way or join an id with itself.  Empty input gives an empty table.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct(), "links"
    )
    while True:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        # Large star: each larger neighbour of x points to the smallest one around x.
        large = cut(both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v > u").distinct(), "large")
        # Small star: x and its smaller neighbours point to the smallest of them.
        small_least = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        joined = large.withColumnRenamed("v", "x").join(small_least, "x")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small_least.select(F.col("x").alias("v"), F.col("m").alias("u")))
        after = cut(small.where("v > u").distinct(), "small")
        # Done when every vertex points at one root and no root points on.
        tips = after.groupBy("v").agg(F.count("*").alias("n"))
        roots = after.select(F.col("u").alias("v")).distinct()
        if not tips.where("n > 1").limit(1).count() and not tips.join(roots, "v", "left_semi").limit(1).count():
            break
        edges = after
    return after.select(F.col("v").alias("id"), F.col("u").alias("component_id")).union(roots.select(F.col("v").alias("id"), F.col("v").alias("component_id")))
