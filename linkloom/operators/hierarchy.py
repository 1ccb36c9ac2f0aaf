"""Parent-child links to whole hierarchies by parallel tree contraction.

A round looks once at every active node and its number of children.

* *Rake*: a node without children leaves the active set; the record (node, parent, distance) is kept.
* *Compress*: on unary chains an independent set of nodes (hash rank above both neighbours) is spliced out; its only
  child takes over the parent with the summed distance, and the record (node, parent, distance) is kept.

Leaves halve bushy trees and splicing shortens chains by a constant factor, so the number of rounds is logarithmic in
the number of nodes whatever the depth. A loop never loses a node by raking; splicing shrinks it to one node that is
its own parent, which exposes it, and the smallest id of the spliced nodes travels along. Going back through the
records in reverse order gives root and depth of every removed node from its anchor, which is always removed later.

Every round is one written table, so nothing is recomputed after a lost executor. Joins have a unique key on one side;
a parent named by a third of all rows is split by adaptive skew handling and pre-counted before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkloom.session import Scratch


def first_rows(df: DataFrame, id_col: str, order_col: str, keep: list[str]) -> DataFrame:
    """Of several rows with one id the one with the smallest order value; ties by the smallest kept values."""
    # Values are aliased so that extra columns of any name in the input can't clash.
    picked = df.select(F.col(id_col).alias("_id"), F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in keep]).alias("_v"))
    best = picked.filter("_id is not null").groupBy("_id").agg(F.min("_v").alias("_v"))
    return best.select(F.col("_id").alias(id_col), F.col("_v._o").alias(order_col), *[F.col(f"_v.{c}").alias(c) for c in keep])


def _rank(column, salt: int):
    return F.xxhash64(column, F.lit(salt))


def expand_hierarchy(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", *, with_path: bool = False) -> DataFrame:
    """Root, depth and, if asked for, path of every node.

    Input: one row per node, ids not null and unique (see :func:`first_rows`); a parent that is null or no node's id
    makes a root. Further columns are ignored. Result: ``id, root, depth[, path]``; a node in a loop or below one has
    depth -1, the smallest id of the loop as root and a null path. An empty table gives an empty result.
    """
    spark, scratch = nodes.sparkSession, Scratch(nodes.sparkSession, "hierarchy")
    plain = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).filter("id is not null")
    plain = scratch.save(plain)
    known = plain.select(F.col("id").alias("pid"))
    via = [F.array().cast("array<string>").alias("via")] if with_path else []
    active = plain.join(known, plain.parent == known.pid, "left").select("id", F.col("pid").alias("parent"), F.lit(1).alias("w"), F.lit(None).cast("string").alias("low"), *via)

    rounds: list[DataFrame] = []
    while True:
        salt = len(rounds)
        own = F.col("parent").isNotNull() & (F.col("parent") != F.col("id"))
        kids = active.filter(own).groupBy(F.col("parent").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max(_rank("id", salt)).alias("kid_rank"))
        seen = active.join(kids, active.id == kids.k, "left").drop("k")
        spliced = own & (F.col("n") == 1) & (_rank("id", salt) > F.col("kid_rank")) & (_rank("id", salt) > _rank("parent", salt))
        step = F.when(F.col("n").isNull(), F.when(own, "rake").otherwise("end")).when(spliced, "splice").otherwise("keep")
        watch = Observation()
        table = scratch.save(seen.withColumn("step", step).drop("n", "kid_rank").observe(watch, F.count_if(F.col("step") == "keep").alias("kept")))
        rounds.append(table)
        if len(rounds) == 1:
            scratch.drop(plain)
        left = watch.get.get("kept") or 0
        if not left:
            break
        kept = table.filter("step = 'keep'").drop("step")
        gone = table.filter("step = 'splice'").select(*[F.col(c).alias(f"s_{c}") for c in kept.columns])
        low = F.least(F.coalesce("low", "id"), F.coalesce("s_low", "s_id"))
        active = kept.join(gone, kept.parent == gone.s_id, "left").select(
            "id",
            F.when(F.col("s_id").isNull(), F.col("parent")).otherwise(F.col("s_parent")).alias("parent"),
            (F.col("w") + F.coalesce("s_w", F.lit(0))).alias("w"),
            F.when(F.col("s_id").isNull(), F.col("low")).otherwise(low).alias("low"),
            *([F.when(F.col("s_id").isNull(), F.col("via")).otherwise(F.concat("s_via", F.array("s_id"), "via")).alias("via")] if with_path else []),
        )

    # An anchor is kept longer than what hangs on it: spliced nodes hang on nodes of later rounds, raked ones also on
    # nodes spliced in their own round.
    done: list[DataFrame] = []
    for table in reversed(rounds):
        loop = F.col("parent").isNotNull()
        ends = table.filter("step = 'end'").select(
            "id",
            F.when(loop, F.coalesce("low", "id")).otherwise(F.col("id")).alias("root"),
            F.when(loop, -1).otherwise(0).alias("depth"),
            *([F.when(~loop, F.array("id")).alias("path")] if with_path else []),
        )
        spliced = _resolve(table.filter("step = 'splice'"), scratch.together(*done), with_path) if done else None
        done.append(scratch.save(ends if spliced is None else ends.unionByName(spliced)))
        raked = _resolve(table.filter("step = 'rake'"), scratch.together(*done), with_path)
        if table is rounds[0]:
            return scratch.together(*done).unionByName(raked)
        done.append(scratch.save(raked))
        scratch.drop(table)
    raise AssertionError("there is always a first round")


def _resolve(records: DataFrame, known: DataFrame, with_path: bool) -> DataFrame:
    up = known.select(F.col("id").alias("u_id"), F.col("root"), F.col("depth").alias("u_depth"), *([F.col("path").alias("u_path")] if with_path else []))
    hit = records.select("id", "parent", "w", *(["via"] if with_path else [])).join(up, F.col("parent") == F.col("u_id"))
    return hit.select(
        "id",
        "root",
        F.when(F.col("u_depth") < 0, -1).otherwise(F.col("u_depth") + F.col("w")).alias("depth"),
        *([F.concat("u_path", "via", F.array("id")).alias("path")] if with_path else []),
    )


def descendants(paths: DataFrame) -> DataFrame:
    """All pairs ``ancestor, descendant, distance`` from the paths of :func:`expand_hierarchy`, loops left out."""
    walk = paths.filter("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return walk.filter(F.col("at") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
