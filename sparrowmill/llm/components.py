"""Connected components by alternating large and small stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): root is the least node of its component.

    Each round points neighbours at the least one they know; the rounds grow with the logarithm of the longest path.
    A round is two aggregations and two joins on the node, so a hub's rows are combined before they are shuffled, and
    is written to the shared folder. Edges of a node to itself, null ends and repeated edges do no harm. Not having ended
    after `most_rounds` is an error, never a labelling.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at = Stored(e)
    before = None
    for _ in range(most_rounds):
        e = at.df
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = Stored(small.select("x.u", "x.v").where("u <> v").distinct())
        now = new.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        at.drop()
        at = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    e = at.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
