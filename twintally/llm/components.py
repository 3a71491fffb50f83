"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintally.sources.staging import stage


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its least node.

    Large-star and small-star steps take turns until nothing changes: every node is hung on the least node it knows,
    above and below itself. Each round is written. With ``rounds``, it ends early; equal names then still mean
    connection, but connected nodes may have different names.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, state, done = stage(edges, "links"), None, 0
    while done != rounds:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.*").where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done += 1
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return found.unionByName(roots.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
