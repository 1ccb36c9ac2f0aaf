"""Joins that check what they join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class JoinError(ValueError):
    """Rows that must have a partner have none."""


def required_join(left: DataFrame, right: DataFrame, on: list[str], *, examples: int = 5) -> DataFrame:
    """Left rows with their one right row; an error if any has none. Right values may be null, right rows not repeated."""
    repeated = right.groupBy(*on).count().filter("count > 1").limit(examples).collect()
    missing = left.join(right, on, "left_anti").select(*on).distinct().limit(examples).collect()
    if missing or repeated:
        raise JoinError(f"without a partner: {[tuple(r) for r in missing]}; more than one: {[tuple(r)[:-1] for r in repeated]}")
    return left.join(right, on)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, n_left, n_right, status``: matched, left_only, right_only or repeated, for every key of either side."""
    n = lambda df, name: df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias(name))
    both = n(left, "n_left").join(n(right, "n_right"), "key", "full").fillna(0, ["n_left", "n_right"])
    status = F.when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated").when(F.col("n_right") == 0, "left_only").when(F.col("n_left") == 0, "right_only").otherwise("matched")
    return both.select(F.col("key").alias(key), "n_left", "n_right", status.alias("status"))


def any_of(left: DataFrame, right: DataFrame, conditions: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """Left and right rows that agree in at least one pair of columns, once each: a union of equi joins, no nested loop."""
    joined = [left.join(right, F.col(a) == F.col(b)).select(*keep) for a, b in conditions]
    return reduce(DataFrame.unionByName, joined).distinct()


def nearest_in_group(points: DataFrame, targets: DataFrame, group: list[str], limit: float) -> DataFrame:
    """Each point with the nearest target of its group, ties by id, null beyond the limit: ``<group>, id, target, distance``.

    Both sides: ``<group>, id, x, y``. The minimum is taken before anything is sorted.
    """
    t = targets.select(*group, F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    near = points.join(t, group).withColumn("distance", F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))).filter(F.col("distance") <= limit)
    best = near.groupBy(*group, "id").agg(F.min(F.struct("distance", "target")).alias("b"))
    return points.select(*group, "id").join(best, [*group, "id"], "left").select(*group, "id", F.col("b.target").alias("target"), F.col("b.distance").alias("distance"))


def best_predictions(truth: DataFrame, predictions: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Every truth and prediction with its role: ``key, prediction, role`` of matched, duplicate, extra or missing.

    truth: ``key``, unique; predictions: ``key, prediction`` and what the order names. The first prediction of a key counts.
    """
    ranked = predictions.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    known = truth.select(F.col(key).alias("_t"))
    both = ranked.join(known, F.col(key) == F.col("_t"), "full")
    role = F.when(F.col(key).isNull(), "missing").when(F.col("_t").isNull(), "extra").when(F.col("_rn") == 1, "matched").otherwise("duplicate")
    return both.select(F.coalesce(F.col(key), F.col("_t")).alias(key), "prediction", role.alias("role"))


def constrained_pairs(pairs: DataFrame, constraints: DataFrame) -> DataFrame:
    """The pairs ``a < b`` with ``constraint``: same, different or null; a pair under both is ``conflict``.

    constraints: ``a, b, kind`` in either order, repeated or not.
    """
    c = constraints.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind").groupBy("a", "b").agg(F.min("kind").alias("k"), F.max("kind").alias("l"))
    kind = F.when(F.col("k") != F.col("l"), "conflict").otherwise(F.col("k"))
    return pairs.join(c, ["a", "b"], "left").withColumn("constraint", kind).drop("k", "l")


def with_missing(rows: DataFrame, expected: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """The rows and one placeholder for each expected key that has none."""
    absent = expected.select(key).distinct().join(rows, key, "left_anti")
    return rows.select(key, *defaults).unionByName(absent.select(key, *[c.alias(name) for name, c in defaults.items()]))
