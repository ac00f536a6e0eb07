"""Connected components by alternating large-star and small-star steps, each a few joins and aggregates.

Every step is written to the shared folder, which cuts the lineage and survives lost executors. Minima are
combined within tasks, and joins on a vertex with very many edges are inner equality joins that AQE may split,
so a vertex that a third of the graph hangs on is no bottleneck. Nothing but two counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.common import new_folder, stored


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours of each vertex to the least vertex around it."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = edges.join(least, "u")
    if larger_only:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, root) for every vertex u that is not the least of its component; edges are (u, v) of long ids."""
    spark = edges.sparkSession
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(down, new_folder(spark, name))
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, True).distinct()
        small = _stars(large, False).filter("u <> v").distinct()
        now = stored(small, new_folder(spark, name))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select("u", F.col("v").alias("root"))
        before = state
