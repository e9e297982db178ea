"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: From so many edges on, what is joined is written first, so that Spark can split the rows of a hub.
SPLIT = 1_000_000


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id that occurs in edges (a, b); component is the least id that can be reached.

    Each round hangs the larger neighbours of every node on its least neighbour, then the smaller ones; a chain or a star of any size
    shrinks geometrically, and no node's neighbours are ever gathered. Null ends and loops count for nothing.
    """
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "components")
    for _ in range(most_rounds):
        used = [e]

        def ready(df: DataFrame, split: bool = e.count() >= SPLIT) -> DataFrame:
            if not split:
                return df
            used.append(written(df, "components"))
            return used[-1]

        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ready(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = ready(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = ready(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        discard(*used)
        # done when every edge is from a node to a root: no node is below two others, or below one and above another
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 OR below > 0 AND above > 0").isEmpty():
            break
    else:
        raise RuntimeError(f"components need more than {most_rounds} rounds")
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    found = written(found, "components")
    discard(e)
    return found
