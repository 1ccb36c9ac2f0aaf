"""Connected components by minimum labels with pointer jumping, over edges of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkloom.session import Scratch


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` with the smallest node as the name; nulls and loops make no edge.

    A round takes the smallest label of the neighbourhood and then the label of that label; labels only fall, so the
    number of changed ones ends the loop. Both joins have one row per node on one side.
    """
    scratch = Scratch(edges.sparkSession, "components")
    plain = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    both = scratch.save(plain.unionAll(plain.select("v", "u")).distinct())
    labels = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        low = labels.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        hop = labels.select(F.col("u").alias("m"), F.col("l").alias("h"))
        watch = Observation()
        step = low.join(hop, "m").select("u", "l", F.least("m", "h").alias("m"))
        fresh = scratch.save(step.observe(watch, F.count_if(F.col("l") != F.col("m")).alias("changed")).select("u", F.col("m").alias("l")))
        scratch.drop(labels)
        labels = fresh
        if not watch.get.get("changed"):
            scratch.drop(both)
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
