"""Scored pairs: exact top-k recall in blocks, gates, scores that cede weight, margins and decisions."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_topk(features: DataFrame, *, key: str, side: str, category: str, vector: str, k: int, block_rows: int = 2048, digits: int = 6) -> DataFrame:
    """For every row and every other side the k most similar rows of that side in the same category.

    Result ``src, dst, src_side, dst_side, score``: cosine clamped to [0, 1] and rounded, ties by the smaller dst. All
    pairs are compared and none is emitted but the k best of a block: a category is cut into blocks of about block_rows,
    and one task holds two blocks, however large the category is. Null keys, sides, categories or vectors take no part.
    """
    rows = features.select(F.col(key).alias("id"), F.col(side).alias("side"), F.col(category).alias("cat"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter("id is not null and side is not null and cat is not null and size(v) > 0")
    counts = rows.groupBy("cat").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n"))
    placed = rows.join(counts, "cat").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = placed.select("cat", F.col("b").alias("i"), other.alias("j"), F.lit(True).alias("is_left"), "id", "side", "v")
    right = placed.select("cat", other.alias("i"), F.col("b").alias("j"), F.lit(False).alias("is_left"), "id", "side", "v")
    id_type, side_type = rows.schema["id"].dataType.simpleString(), rows.schema["side"].dataType.simpleString()

    def best(group: pa.Table) -> pa.Table:
        flag = group.column("is_left").to_numpy(zero_copy_only=False)
        ids, sides = np.array(group.column("id").to_pylist()), np.array(group.column("side").to_pylist())
        vec = group.column("v").combine_chunks()
        vec = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        vec = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
        a, b = np.flatnonzero(flag), np.flatnonzero(~flag)
        b = b[np.argsort(ids[b], kind="stable")]
        sims = np.round(np.clip(vec[a] @ vec[b].T, 0.0, 1.0), digits)
        src, dst, score = [], [], []
        for s in np.unique(sides[b]) if len(b) else []:
            cols, own = np.flatnonzero(sides[b] == s), np.flatnonzero(sides[a] != s)
            if len(own):
                part = sims[np.ix_(own, cols)]
                # Columns are in id order, so a stable sort breaks ties by id.
                top = np.argsort(-part, axis=1, kind="stable")[:, :k]
                src.append(np.repeat(a[own], top.shape[1]))
                dst.append(b[cols[top.ravel()]])
                score.append(np.take_along_axis(part, top, 1).ravel())
        at, to, val = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((src, int), (dst, int), (score, float)))
        return pa.table({"src": ids[at].tolist(), "dst": ids[to].tolist(), "src_side": sides[at].tolist(), "dst_side": sides[to].tolist(), "score": val}, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"src {id_type}, dst {id_type}, src_side {side_type}, dst_side {side_type}, score double"
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    local = left.unionByName(right).groupBy("cat", "i", "j").applyInArrow(best, ddl)
    rank = Window.partitionBy("src", "dst_side").orderBy(F.desc("score"), "dst")
    return local.withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= k).drop("rn")


def first_hit_rank(features: DataFrame, *, key: str, query: Column, label: str, vector: str, block_rows: int = 2048, digits: int = 6) -> DataFrame:
    """The rank at which every query first meets a row of its own label: ``src, label, rank, score``, null without one.

    The others are ranked by rounded cosine clamped to [0, 1], ties by the smaller key. The best row of the own label is
    found first; its rank is one more than the number of rows before it, counted in blocks, so no list of ranked rows is
    built however far down it stands. Null keys, labels or vectors take no part.
    """
    rows = features.select(F.col(key).alias("id"), query.cast("int").alias("side"), F.col(label).alias("lab"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter("id is not null and side is not null and lab is not null and size(v) > 0")
    best = blocked_topk(rows, key="id", side="side", category="lab", vector="v", k=1, block_rows=block_rows, digits=digits).filter("src_side = 1")
    asked = rows.filter("side = 1").join(best.select(F.col("src").alias("id"), "dst", "score"), "id")
    n_left, n_right = (max(1, -(-rows.filter(f"side = {k}").count() // block_rows)) for k in (1, 0))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(block(n_left).alias("i"), every(n_right).alias("j"), "id", "v", "dst", "score")
    right = rows.filter("side = 0").select(every(n_left).alias("i"), block(n_right).alias("j"), "id", "v", F.lit(None).cast(rows.schema["id"].dataType).alias("dst"), F.lit(None).cast("double").alias("score"))

    def count(group: pa.Table) -> pa.Table:
        ids, score = np.array(group.column("id").to_pylist()), group.column("score").to_numpy(zero_copy_only=False)
        vec = group.column("v").combine_chunks()
        vec = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        vec = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
        a, b = np.flatnonzero(~np.isnan(score)), np.flatnonzero(np.isnan(score))
        sims = np.round(np.clip(vec[a] @ vec[b].T, 0.0, 1.0), digits)
        limit, first = score[a, None], np.array([x for x in group.column("dst").to_pylist() if x is not None])
        before = (sims > limit) | ((sims == limit) & (ids[b][None, :] < first[:, None])) if len(a) else np.zeros((0, len(b)), bool)
        return pa.table({"src": pa.array(ids[a].tolist(), id_type), "before": pa.array(before.sum(1), pa.int64())})

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    counted = left.unionByName(right).groupBy("i", "j").applyInArrow(count, f"src {rows.schema['id'].dataType.simpleString()}, before long")
    ranks = counted.groupBy("src").agg((F.sum("before") + 1).alias("rank")).join(best.select("src", "score"), "src")
    return rows.filter("side = 1").select(F.col("id").alias("src"), F.col("lab").alias("label")).join(ranks, "src", "left")


def symmetric_union(recalled: DataFrame) -> DataFrame:
    """Recalls of both ends as pairs ``a < b``, once each, with both ends' sides."""
    swap = F.col("src") > F.col("dst")
    return recalled.select(
        F.least("src", "dst").alias("a"),
        F.greatest("src", "dst").alias("b"),
        F.when(swap, F.col("dst_side")).otherwise(F.col("src_side")).alias("a_side"),
        F.when(swap, F.col("src_side")).otherwise(F.col("dst_side")).alias("b_side"),
        "score",
    ).distinct()


def endpoint_margins(pairs: DataFrame) -> DataFrame:
    """The pairs with ``margin``: a pair's score less the best other score of an endpoint toward the same side, the
    smaller one of both endpoints; without another candidate the other score counts as 0."""

    def other_best(end: str, side: str) -> Column:
        w = Window.partitionBy(end, side)
        ranked = Window.partitionBy(end, side).orderBy(F.desc("score"), "a", "b")
        first, second = F.max("score").over(w), F.max(F.when(F.col(f"_r_{end}") > 1, F.col("score"))).over(w)
        return F.when(F.col(f"_r_{end}") > 1, first).otherwise(F.coalesce(second, F.lit(0.0))), F.row_number().over(ranked)

    out = pairs
    for end, side in (("a", "b_side"), ("b", "a_side")):
        best, rank = other_best(end, side)
        out = out.withColumn(f"_r_{end}", rank).withColumn(f"_m_{end}", F.col("score") - best)
    return out.withColumn("margin", F.least("_m_a", "_m_b")).drop("_r_a", "_r_b", "_m_a", "_m_b")


def bidirectional_top1(recalled: DataFrame) -> DataFrame:
    """Pairs in which each end is the other's best toward its side: ``a, b, score``."""
    w = Window.partitionBy("src", "dst_side").orderBy(F.desc("score"), "dst")
    top = recalled.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("src", "dst", "score")
    back = top.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return top.join(back, ["src", "dst"]).filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "score")


def mutual_cap(pairs: DataFrame, n: int) -> DataFrame:
    """Pairs that are among the n best of both ends toward the other's side."""
    wa = Window.partitionBy("a", "b_side").orderBy(F.desc("score"), "b")
    wb = Window.partitionBy("b", "a_side").orderBy(F.desc("score"), "a")
    ranked = pairs.withColumn("ra", F.row_number().over(wa)).withColumn("rb", F.row_number().over(wb))
    return ranked.filter((F.col("ra") <= n) & (F.col("rb") <= n)).drop("ra", "rb")


def reasons(rules: dict[str, Column]) -> Column:
    """The names of all rules that hold, in order: a gate that records instead of dropping."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def attribute_agreement(pairs: list[tuple[Column, Column]], unknown: str = "unknown") -> Column:
    """Share of equal attributes among those known on both sides; null where none is."""

    def told(x: Column) -> Column:
        return x.isNotNull() & (x != unknown)

    both = [told(a) & told(b) for a, b in pairs]
    equal = reduce(lambda x, y: x + y, [F.when(ok & (a == b), 1.0).otherwise(0.0) for ok, (a, b) in zip(both, pairs, strict=True)])
    known = reduce(lambda x, y: x + y, [F.when(ok, 1.0).otherwise(0.0) for ok in both])
    return F.when(known > 0, equal / known)


def ceding_score(terms: list[tuple[float, Column]]) -> Column:
    """Weighted mean of the terms that are not null; a null term cedes its weight."""
    total = reduce(lambda x, y: x + y, [F.coalesce(F.lit(w) * t, F.lit(0.0)) for w, t in terms])
    weight = reduce(lambda x, y: x + y, [F.when(t.isNotNull(), F.lit(w)).otherwise(0.0) for w, t in terms])
    return F.when(weight > 0, total / weight)


def aspect_similarity(a: Column, b: Column) -> Column:
    """exp(-|ln(a / b)|); one half where either is missing or 0."""
    return F.when((a > 0) & (b > 0), F.exp(-F.abs(F.ln(a / b)))).otherwise(0.5)


def rounded(x: Column, digits: int = 6) -> Column:
    """``round(x, digits)`` without its decimal arithmetic where no tie is near.

    Near ties, nulls and values that are negative, huge or not finite go by round itself. x should be a plain column, as it
    is written out several times.
    """
    scaled = x * float(10**digits)
    clear = (x >= 0) & (x <= 1000) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)
    return F.when(clear, F.floor(scaled + 0.5) / float(10**digits)).otherwise(F.round(x, digits))


def block_pairs(rows: DataFrame, *, block: list[str], key: str, chunk_rows: int = 2048) -> DataFrame:
    """Rows of one block joined with each other, ``a.key < b.key``, under the aliases a and b.

    A block is cut into chunks of about chunk_rows, and two chunks meet as one unit of work, so that neither the file a
    small table is read from nor a large block decides how many tasks share the pairs. Null keys and blocks pair with
    nothing.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    told = rows.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*block, key)]))
    counts = told.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_n"))
    placed = told.join(counts, block).withColumn("_c", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = placed.withColumn("_i", F.col("_c")).withColumn("_j", every).repartition(tasks, *block, "_i", "_j").alias("a")
    b = placed.withColumn("_j", F.col("_c")).withColumn("_i", every).repartition(tasks, *block, "_i", "_j").hint("merge").alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*block, "_i", "_j")])
    return a.join(b, same & (F.col(f"a.{key}") < F.col(f"b.{key}")))


def swept_pairs(rows: DataFrame, *, block: list[str], key: str, value: str, same: str, settings: list[tuple[float, float]], digits: int, label: str | None = None, unknown: str = "unknown") -> DataFrame:
    """How many pairs of each block's rows reach every threshold, counted from sorted values without forming a pair.

    settings: weight and threshold. A pair's score is ``round(weight * agree + (1 - weight) * aspect, digits)``, aspect
    that of ``aspect_similarity`` and agree 1 where the labels are known and equal, 0 where known and different, else one
    half. Result ``weight, threshold, n_pairs, n_hits, n_true, n_all``: pairs that reach the threshold, those of them with
    an equal value of ``same``, all with an equal one, and all pairs; one row a setting, none if there is no pair. Rows with
    equal keys are no pair, nor are rows with a null key or block.

    One task holds the values of a block. For every value the smallest one that still reaches is found by binary search;
    what lies within 1e-12 of the limit is judged by the score itself. A value of NaN reaches every threshold, as NaN is
    the largest number; two whose ratio leaves the range of doubles have aspect 0.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    kind = F.lit(None).cast("string") if label is None else F.when(F.col(label) != unknown, F.col(label).cast("string"))
    x = rows.select(*block, F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"), F.col(same).alias("_same"), kind.alias("_kind"))
    x = x.filter(reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in (*block, "_key")]))
    unit = Decimal(1).scaleb(-digits)

    def reaches(weight: float, threshold: float, agree: float, aspect: float) -> bool:
        score = weight * agree + (1 - weight) * aspect
        return float(Decimal(repr(score)).quantize(unit, ROUND_HALF_UP)) >= threshold

    def count(group: pa.Table) -> pa.Table:
        v = group.column("_v").to_numpy()
        if group.column("_v").null_count:
            v = np.where(np.asarray(group.column("_v").is_valid()), v, 0.0)
        word, tag, ident = (group.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_same", "_kind", "_key"))
        flat, odd = v <= 0, np.isnan(v)
        levels, rank = np.unique(np.where(flat | odd, 1.0, v), return_inverse=True)
        width = len(levels) + 1
        # By agreement: the lowest rank that reaches each setting from every rank.
        limits = {g: [_lowest(levels, w, t, g, digits, reaches) for w, t in settings] for g in (0.5, 0.0, 1.0)}
        steady = {g: np.array([reaches(w, t, g, 0.5) for w, t in settings]) for g in limits}

        def pairs_of(part: np.ndarray, at: np.ndarray) -> dict[float, np.ndarray]:
            """Pairs within each part of the rows at that reach each setting, by agreement; None has all of them."""
            part, own = part[at], ~(flat | odd)[at]
            two = lambda mask: int((n := np.bincount(part[mask])) @ (n - 1)) // 2 if mask.any() else 0
            everything, usable, plain = two(np.ones(len(at), bool)), two(~flat[at]), two(own)
            codes = np.sort(part[own] * width + rank[at][own])
            first = codes - codes % width
            place = np.arange(len(codes))
            out = {None: np.full(len(settings), everything)}
            for g, lowest in limits.items():
                met = [plain if low is None else int(np.maximum(0, place - np.searchsorted(codes, first + low[codes % width])).sum()) for low in lowest]
                out[g] = np.array(met) + (usable - plain) + steady[g] * (everything - usable)
            return out

        def hits(at: np.ndarray, split: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            known = at[tag[at] >= 0]
            all_, told, alike = pairs_of(_joint(split, len(v)), at), pairs_of(_joint(split, len(v)), known), pairs_of(_joint([*split, tag], len(v)), known)
            return all_[0.5] - told[0.5] + told[0.0] - alike[0.0] + alike[1.0], all_[None]

        every, named = np.arange(len(v)), np.flatnonzero(word >= 0)
        n_pairs, n_all = hits(every, [])
        n_hits, n_true = hits(named, [word])
        if (twice := np.bincount(ident) > 1).any():
            again = twice[ident]
            less = [*hits(every[again], [ident]), *hits(named[again[named]], [ident, word])]
            n_pairs, n_all, n_hits, n_true = n_pairs - less[0], n_all - less[1], n_hits - less[2], n_true - less[3]
        w, t = zip(*settings, strict=True)
        return pa.table({"weight": pa.array(w, pa.float64()), "threshold": pa.array(t, pa.float64()), "n_pairs": n_pairs, "n_hits": n_hits, "n_true": n_true, "n_all": n_all})

    per = x.repartition(tasks, *block).groupBy(*block).applyInArrow(count, "weight double, threshold double, n_pairs long, n_hits long, n_true long, n_all long")
    sums = [F.sum(c).alias(c) for c in ("n_pairs", "n_hits", "n_true", "n_all")]
    return per.groupBy("weight", "threshold").agg(*sums).filter("n_all > 0")


def _joint(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Dense numbers of the combinations of n rows' codes, which start at -1."""
    out = np.zeros(n, np.int64)
    for c in columns:
        out = np.unique(out * (c.max(initial=0) + 2) + c + 1, return_inverse=True)[1].reshape(-1)
    return out


def _lowest(levels: np.ndarray, weight: float, threshold: float, agree: float, digits: int, reaches) -> np.ndarray | None:
    """For each of the sorted levels the rank of the smallest one whose aspect with it reaches the threshold, its own rank
    plus one where none does; None where every pair does."""
    own = np.arange(len(levels))
    if reaches(weight, threshold, agree, 0.0):
        return None
    if not reaches(weight, threshold, agree, 1.0):
        return own + 1
    limit = (threshold - 0.5 * 10.0**-digits - weight * agree) / (1 - weight)
    low = np.searchsorted(levels, levels * (limit * (1 - 1e-12)))
    high = np.minimum(np.searchsorted(levels, levels * (limit * (1 + 1e-12)), "right"), own)
    for i in np.flatnonzero(low < high):
        while low[i] < high[i] and not reaches(weight, threshold, agree, math.exp(-abs(math.log(levels[low[i]] / levels[i])))):
            low[i] += 1
    return np.minimum(low, own)


def quantile_transplant(df: DataFrame, group: list[str], base: str, new: str, key: list[str], out: str = "calibrated") -> DataFrame:
    """Within each group the i-th best row by ``new`` gets the i-th largest ``base`` value: order changes, values don't.

    Ties go by ``base``, then by the key. One shuffle on the group for both rankings.
    """
    by_new = Window.partitionBy(*group).orderBy(F.desc(new), F.desc(base), *key)
    by_base = Window.partitionBy(*group).orderBy(F.desc(base), *key)
    ranked = df.withColumn("_i", F.row_number().over(by_new)).withColumn("_j", F.row_number().over(by_base))
    values = ranked.select(*group, F.col("_j").alias("_i"), F.col(base).alias(out))
    return ranked.join(values, [*group, "_i"]).drop("_i", "_j")


def blend(total: Column, old: Column, new: Column, weight: float, denominator: Column) -> Column:
    """The total with one of its weighted terms replaced; a null new term keeps it."""
    return F.coalesce(total + weight * (new - old) / denominator, total)


def reconcile(rows: DataFrame, key: str, tiers: list[tuple[DataFrame, Column, float]]) -> DataFrame:
    """``key, status, target, confidence`` by several vocabularies ``k, target`` with the column of the rows that must
    equal k. All hits count: one distinct target is mapped with the best confidence, several are a conflict with 0, none
    is unmapped. Vocabulary rows are first reduced to the distinct targets of a key, at most two of which are told apart.
    """
    hits = None
    for terms, column, confidence in tiers:
        known = terms.groupBy(F.col("k").alias("_k")).agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
        one = rows.select(F.col(key).alias("_key"), column.alias("_k")).join(known, "_k").select("_key", "lo", "hi", F.lit(confidence).alias("c"))
        hits = one if hits is None else hits.unionAll(one)
    best = hits.groupBy("_key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("c").alias("c"))
    clear = F.col("lo") == F.col("hi")
    status = F.when(F.col("c").isNull(), "unmapped").when(clear, "mapped").otherwise("conflict")
    return rows.select(key).join(best, F.col(key) == F.col("_key"), "left").select(key, status.alias("status"), F.when(clear, F.col("lo")).alias("target"), F.when(clear, F.col("c")).otherwise(0.0).alias("confidence"))


def resolve_by_containment(rows: DataFrame, key: str, name: str, aliases: DataFrame, *, most_words: int = 6) -> DataFrame:
    """``key, target, n_targets``: the target if exactly one has an alias that is a run of whole words of the name, or of
    which the name is one.

    aliases: ``alias, target``, both sides in label form. Runs of words are joined by equality, so nothing is compared with
    everything; aliases and names of more than most_words words are only found whole.
    """
    from linkloom.functions.text import word_runs

    a = aliases.select(F.col("alias").alias("_alias"), F.col("target").alias("_target")).filter("_alias != ''").distinct()
    r = rows.select(F.col(key).alias("_key"), F.col(name).alias("_name"))
    inside = r.select("_key", F.explode(word_runs(F.col("_name"), most_words)).alias("_alias")).join(a, "_alias")
    around = r.join(a.select(F.explode(word_runs(F.col("_alias"), most_words)).alias("_name"), "_target"), "_name")
    per = inside.select("_key", "_target").unionAll(around.select("_key", "_target")).groupBy("_key").agg(F.countDistinct("_target").alias("n"), F.min("_target").alias("t"))
    return rows.select(key).join(per, F.col(key) == F.col("_key"), "left").select(key, F.when(F.col("n") == 1, F.col("t")).alias("target"), F.coalesce("n", F.lit(0)).alias("n_targets"))
