"""Splits that keep related records together.

Records and the entities they name make a bipartite graph. Minimum labels travel from records to entities and back;
after each round every record also takes the label of the record its own label names, which halves long chains. The
blocks are then assigned to the parts so that every part gets its proportion of every stratum.

The hot entity (a very busy video) is one row on one side of each join, and its minimum is pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from linkloom.functions.ids import id_form
from linkloom.session import Scratch

#: Words that stand for "not known", compared in the id form; values without any letter or digit count as such too.
STAND_INS = ("n/a", "na", "nan", "nil", "none", "null", "undefined", "unknown", "unk", "tbd", "missing", "not known", "not available", "未知", "不明", "不详", "无", "未填", "待定")


def known(column: Column | str, stand_ins: tuple[str, ...] = STAND_INS) -> Column:
    """The id in comparison form, null where it says that nothing is known."""
    c = id_form(column)
    return F.when(~c.isin(*stand_ins) & c.rlike(r"[\p{L}\p{N}]"), c)


def related_blocks(records: DataFrame, key: str, entities: list[str], *, stand_ins: tuple[str, ...] = STAND_INS) -> DataFrame:
    """Blocks of records that share a known entity directly or through others: ``key, block_id``.

    key: a unique integer column; rows with a null key are left out. block_id is the smallest key of the block. A record
    that shares nothing is a block of its own. Equal values in different entity columns are different entities.
    A value among stand_ins (in comparison form), or without any letter or digit, is shared by nobody.
    """
    spark, scratch = records.sparkSession, Scratch(records.sparkSession, "blocks")
    named = F.array(*[F.when(F.col(c).isNotNull(), F.concat_ws("\x01", F.lit(c), F.col(c))) for c in entities])
    rows = records.select(F.col(key).cast("long").alias("r"), *[known(c, stand_ins).alias(c) for c in entities]).filter("r is not null")
    rows = scratch.save(rows.select("r", F.array_compact(named).alias("named")))
    links = rows.select("r", F.explode("named").alias("e")).distinct()
    shared = links.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("l")).filter("n > 1")
    links = scratch.save(links.join(shared.select("e"), "e"))
    # The first round needs no labels: the smallest record of every entity.
    by_entity = links.groupBy("e").agg(F.min("r").alias("l"))
    state = None
    while True:
        fresh = links.join(by_entity, "e").groupBy("r").agg(F.min("l").alias("l"))
        hop = fresh.select(F.col("r").alias("l"), F.col("l").alias("ll"))
        jumped = fresh.join(hop, "l").select("r", F.least("l", "ll").alias("l"))
        watch = Observation()
        total = F.sum(F.col("l").cast("decimal(38,0)")).alias("total")
        new = scratch.save(jumped.observe(watch, total))
        after = watch.get.get("total")
        if state is not None:
            scratch.drop(state[0])
        # Labels only ever fall, so an equal sum means that none has changed.
        if state is not None and state[1] == after:
            break
        state = (new, after)
        by_entity = links.join(new, "r").groupBy("e").agg(F.min("l").alias("l"))
    scratch.drop(links)
    return rows.join(new, "r", "left").select(F.col("r").alias(key), F.coalesce("l", "r").alias("block_id"))


#: Blocks of at least this share of the rows are placed one after another; there are at most 1 / HEAVY of them.
HEAVY = 0.001
#: The commonest labels are a stratum each, all others share the last one.
STRATA = 64
#: Slices of the hash order in which the rows of one stratum are summed up side by side.
SLICES = 256


def assign_parts(blocks: DataFrame, key: str, label: str, proportions: dict[str, float]) -> DataFrame:
    """A part for every row of ``key, block_id, label``, equal within a block: ``key, block_id, part``.

    Blocks of at least a thousandth of the rows (at most a thousand of them, with at most STRATA counts each) are placed
    greedily, the largest first, where they leave the smallest squared deviation from the wanted rows of part and
    stratum. All others go by their commonest stratum: in a hash order, each takes the part on whose share of the
    still missing rows the middle of its rows falls. Strata are labels, null among them; those after the STRATA - 1
    commonest share one.
    """
    parts = list(proportions)
    whole = sum(proportions.values())
    share = [proportions[p] / whole for p in parts]
    scratch = Scratch(blocks.sparkSession, "parts")
    named = blocks.select(F.col(key).alias("k"), "block_id", F.col(label).cast("string").alias("label"))
    common = [r["label"] for r in named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(STRATA - 1).collect()]
    strata = blocks.sparkSession.createDataFrame(list(enumerate(common)), "s int, known string")
    rows = named.join(F.broadcast(strata), F.col("label").eqNullSafe(F.col("known")), "left")
    rows = scratch.save(rows.select("k", "block_id", F.coalesce("s", F.lit(STRATA - 1)).alias("s")))
    counts = scratch.save(rows.groupBy("block_id", "s").agg(F.count(F.lit(1)).alias("n")))
    wanted = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    total = sum(wanted.values())
    sizes = counts.groupBy("block_id").agg(F.sum("n").alias("size"), F.max(F.struct("n", "s")).alias("m")).select("block_id", "size", F.col("m.s").alias("s"))
    heavy_ids = sizes.filter(F.col("size") >= F.lit(max(2.0, HEAVY * total))).select("block_id")
    heavy: dict[int, dict[int, int]] = {}
    for r in counts.join(heavy_ids, "block_id").collect():
        heavy.setdefault(r["block_id"], {})[r["s"]] = r["n"]

    have = {(p, s): 0.0 for p in range(len(parts)) for s in wanted}
    placed = []
    for block, by in sorted(heavy.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        goal = lambda p, s: share[p] * wanted[s]
        cost = [sum((have[p, s] + n - goal(p, s)) ** 2 - (have[p, s] - goal(p, s)) ** 2 for s, n in by.items()) for p in range(len(parts))]
        best = min(range(len(parts)), key=lambda p: (cost[p], p))
        placed.append((block, best))
        for s, n in by.items():
            have[best, s] += n
    bounds = []
    for s in wanted:
        left = [max(0.0, share[p] * wanted[s] - have[p, s]) for p in range(len(parts))]
        left = left if sum(left) else share
        run = 0.0
        edges = []
        for x in left[:-1]:
            run += x / sum(left)
            edges.append(run)
        bounds.append((s, edges))

    spark = blocks.sparkSession
    placed_df = spark.createDataFrame(placed, "block_id long, p int")
    light = sizes.join(heavy_ids, "block_id", "left_anti").withColumn("h", F.xxhash64("block_id"))
    light = light.withColumn("slice", F.floor((F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))) * SLICES).cast("int"))
    per = light.groupBy("s", "slice").agg(F.sum("size").alias("slice_rows"))
    before = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("s", "slice", F.coalesce(F.sum("slice_rows").over(before), F.lit(0)).alias("base"), F.sum("slice_rows").over(Window.partitionBy("s")).alias("all"))
    inside = Window.partitionBy("s", "slice").orderBy("h", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    edges_df = spark.createDataFrame(bounds, "s int, edges array<double>")
    at = light.withColumn("run", F.sum("size").over(inside)).join(per, ["s", "slice"]).join(F.broadcast(edges_df), "s")
    middle = (F.col("base") + F.col("run") - F.col("size") / 2) / F.col("all")
    chosen = at.select("block_id", F.size(F.filter("edges", lambda e: e <= middle)).alias("p"))
    names = F.array(*[F.lit(p) for p in parts])
    both = chosen.unionAll(placed_df)
    return rows.join(both, "block_id").select(F.col("k").alias(key), "block_id", F.element_at(names, F.col("p") + 1).alias("part"))
