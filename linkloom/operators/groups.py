"""Aggregates whose groups may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import Scratch


def nearest_ranks(df: DataFrame, group: str, value: str, shares: dict[str, float], *, buckets: int = 4096, few: int = 100_000) -> DataFrame:
    """``group, <name>...``: the value at place ``min(n - 1, int(n * p))`` of the group's sorted values, nulls left out.

    Values are counted in equal ranges between the smallest and the largest, at most ``buckets`` a group and summed
    before the shuffle; only the range that holds a wanted place is looked at again, until it has at most ``few`` rows
    or one value. No window ever holds more rows than that, whatever the size of a group.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    rows = df.select(F.col(group).alias("g"), F.col(value).alias("x")).filter("x is not null")
    whole = rows.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = lambda p: F.least(F.col("c") - 1, F.floor(F.col("c") * F.lit(p))).cast("long")
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), place(p).alias("rank")) for k, p in shares.items()]))
    wanted = scratch.save(whole.select("g", "c", "lo", "hi", names.alias("w")).select("g", "c", "lo", "hi", "w.name", "w.rank"))

    def inside() -> DataFrame:
        spans = wanted.select(F.col("g").alias("sg"), "lo", "hi").distinct()
        return rows.join(spans, F.col("g").eqNullSafe(F.col("sg")) & F.col("x").between(F.col("lo"), F.col("hi"))).drop("sg")

    def narrowed(counts: DataFrame, order: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy(order))
        counts = counts.withColumn("upto", upto).select(*[F.col(c).alias(f"k_{c}") for c in (*counts.columns, "upto")])
        same = F.col("g").eqNullSafe(F.col("k_g")) & (F.col("lo") == F.col("k_lo")) & (F.col("hi") == F.col("k_hi"))
        return wanted.join(counts, same & (F.col("rank") < F.col("k_upto")) & (F.col("rank") >= F.col("k_upto") - F.col("k_n")))

    while (wanted.filter("lo < hi").agg(F.max("c")).head()[0] or 0) > few:
        part = F.least(F.lit(buckets - 1), F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * buckets))
        counts = inside().withColumn("b", F.coalesce(part, F.lit(0))).groupBy("g", "lo", "hi", "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("from"), F.max("x").alias("to"))
        at = narrowed(counts, "b")
        wanted = scratch.save(at.select("g", F.col("k_n").alias("c"), F.col("k_from").alias("lo"), F.col("k_to").alias("hi"), "name", (F.col("rank") - F.col("k_upto") + F.col("k_n")).alias("rank")))
    counts = inside().groupBy("g", "lo", "hi", "x").agg(F.count(F.lit(1)).alias("n"))
    found = narrowed(counts, "x").groupBy("g").agg(*[F.max(F.when(F.col("name") == k, F.col("k_x"))).alias(k) for k in shares])
    return found.withColumnRenamed("g", group)
