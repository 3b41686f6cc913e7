"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piisieve.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of the edges (a, b); the component is its smallest node.

    Each round hangs a node's larger neighbours below the smallest one around it, then the smaller ones, until
    every component is a star; the number of rounds grows with the logarithm of the longest chain. Rounds are
    joins and groupings of the edges, each written to the shared folder, so that lineage stays short. Nulls and loops are passed over.
    """
    a, b = F.col("a"), F.col("b")
    stars = written(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.where("v > u").join(around, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(below, "u")
            .where(F.col("v") != F.col("low"))
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(below.select("u", F.col("low").alias("v")))
            .distinct()
        )
        stars = written(small)
        state = stars.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
