"""Connected components of links held in a DataFrame, by alternating large-star and small-star steps.

Every step is an aggregation and a join on the vertex, so a vertex with very many links is summed before the shuffle and its
join is split by AQE.  Each round is written to the shared folder; a few rounds suffice for star-like links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Hang each larger neighbour (or, for the small star, each smaller one and the vertex itself) on the least of them."""
    if both:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    hung = around.join(least.withColumn("m", F.least("u", "m")), "u")
    if both:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, label) of every vertex that has a link; the label is the least vertex reachable.  links: u, v."""
    now = common.written(links.where("u <> v").select("u", "v").distinct())
    for _ in range(most_rounds):
        now = common.written(_star(_star(now, True), False))
        if _settled(now):
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("label")).unionByName(
                now.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct()
            )
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars already: every vertex hangs on one other or is hung upon, never both."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.max("holds").alias("m")).where("n > 1 or (n > 0 and m > 0)").isEmpty()
