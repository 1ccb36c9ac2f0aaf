"""Consolidating pairwise matches into groups.

Match graphs have one giant component and very many tiny ones. The giant is peeled off first: a breadth-first search
from the vertex of highest degree, one join of the edges with the small frontier a round, visits it; its vertices are
then joined away from the edges. What remains are small components, labelled by minimum propagation (every vertex hands
the smallest id it sees to its neighbours, alternately to the larger and the smaller ones), which ends after a
logarithmic number of rounds.

The search stops when a level adds less than a hundredth of what has been visited: a long tail of thin levels is left to
the propagation. Everything visited then stands as one vertex, under its smallest id, in the remaining edges, so the
result is exact wherever the search stops.

A vertex with a third of all pairs is handled by minima that are pre-aggregated before the shuffle and by joins whose
other side has one row per vertex. Only counts, checksums and single ids reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkloom.session import Scratch

#: A level smaller than this share of the visited vertices ends the search.
THIN_LEVEL = 0.01


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _checksum(*cols: str):
    h = F.xxhash64(*cols)
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")]


def group_pairs(pairs: DataFrame, a: str, b: str, *, thin_level: float = THIN_LEVEL) -> DataFrame:
    """Group of every paired item: ``item, group`` with the smallest item of the group as its name.

    Null ends name nothing and an item paired with itself makes no link; repeated and reversed pairs count once. Further
    columns are ignored. No pairs give an empty result. thin_level only says when the search hands over.
    """
    spark, scratch = pairs.sparkSession, Scratch(pairs.sparkSession, "groups")
    ends = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b")
    edges = scratch.save(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    both = scratch.save(_both_ways(edges))
    top = both.groupBy("u").count().orderBy(F.desc("count"), "u").head()
    if top is None:
        return edges.select(F.col("u").alias("item"), F.col("v").alias("group"))

    visited = _peel(scratch, both, top["u"], thin_level)
    scratch.drop(both)
    name = visited.agg(F.min("u")).head()[0]
    seen_u, seen_v = visited.select("u", F.lit(True).alias("in_u")), visited.select(F.col("u").alias("v"), F.lit(True).alias("in_v"))
    rest = edges.join(seen_u, "u", "left").join(seen_v, "v", "left").filter("in_u is null or in_v is null")
    rest = rest.select(F.when(F.col("in_u"), F.lit(name)).otherwise(F.col("u")).alias("u"), F.when(F.col("in_v"), F.lit(name)).otherwise(F.col("v")).alias("v"))
    stars = propagate_minima(scratch, rest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    scratch.drop(edges)

    # The visited vertices may hang on a smaller one that the search did not reach.
    over = stars.filter(F.col("u") == name).head()
    giant = over["v"] if over else name
    leaves = stars.filter(F.col("u") != name).select(F.col("u").alias("item"), F.col("v").alias("group"))
    heads = stars.filter(F.col("v") != name).select(F.col("v").alias("item"), F.col("v").alias("group")).distinct()
    return leaves.unionAll(heads).unionAll(visited.select(F.col("u").alias("item"), F.lit(giant).alias("group")))


def _peel(scratch: Scratch, both: DataFrame, start: str, thin_level: float) -> DataFrame:
    """Vertices reached from the start, level by level, until the search is done or a level is thin.

    A neighbour of a level lies in it, in the one before or in the next, so only these two are joined away."""
    frontier = scratch.save(scratch.spark.createDataFrame([(start,)], "u string"))
    levels, total = [frontier], 1
    while True:
        near = both.join(frontier, "u").select(F.col("v").alias("u")).distinct()
        watch = Observation()
        fresh = near.join(scratch.together(*levels[-2:]), "u", "left_anti")
        frontier = scratch.save(fresh.observe(watch, F.count(F.lit(1)).alias("n")))
        n = watch.get.get("n") or 0
        levels.append(frontier)
        total += n
        if n <= thin_level * total:
            return scratch.together(*levels)


def propagate_minima(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Edges ``u > v`` turned into one star per component: every other vertex u with the smallest one v."""
    watch = Observation()
    edges = scratch.save(edges.observe(watch, *_checksum("u", "v")))
    before = watch.get
    while True:
        # Larger neighbours get the smallest of a vertex' neighbourhood ...
        both = _both_ways(edges)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # An edge u > v has v as the vertex and u as its larger neighbour.
        up = edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        up = up.filter("u != v").distinct()
        # ... and so do the smaller ones, the vertex itself among them.
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        near = up.join(low, "u").select("u", "v", "m")
        down = near.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        watch = Observation()
        fresh = scratch.save(down.filter("u != v").distinct().observe(watch, *_checksum("u", "v")))
        after = watch.get
        scratch.drop(edges)
        edges = fresh
        if after == before:
            return edges
        before = after
