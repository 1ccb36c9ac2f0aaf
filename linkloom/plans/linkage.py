"""Queries of the linkage, evaluation and audit operators over the star-schema tables, whole tables each.

Embeddings stand for tracklets: the clip is ``vec_id % 3``, the category the label, an entity's views the vectors with
one ``vec_id // 4``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import kernels as K
from linkloom.operators import components, folds, groups, pairs
from linkloom.session import Scratch
from linkloom.sources.tables import table

QUERIES: dict = {}


def query_into(queries: dict):
    """A decorator that registers a query under its name."""

    def register(f):
        queries[f.__name__] = f
        return f

    return register


query = query_into(QUERIES)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 3).cast("int").alias("clip"), "label", "embedding")


def _recalled(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    return pairs.blocked_topk(_features(spark, d), key="vec_id", side="clip", category="label", vector="embedding", k=k)


# --- recall, margins, decisions ---------------------------------------------------------------------------------------


@query
def pair_recall(spark, d):
    """Symmetric top-3 recall between clips."""
    return pairs.symmetric_union(_recalled(spark, d)).select("a", "b", "score")


@query
def pair_margin_decisions(spark, d):
    """Margin and three-way decision of every recalled pair."""
    m = pairs.endpoint_margins(pairs.symmetric_union(_recalled(spark, d)))
    decision = F.when((F.col("score") >= 0.45) & (F.col("margin") >= 0.02), "MATCHED").when(F.col("score") >= 0.3, "SUSPECTED_DUPLICATE").otherwise("NEW_ENTITY")
    return m.select("a", "b", "score", F.round("margin", 6).alias("margin"), decision.alias("decision"))


@query
def bidirectional_top1(spark, d):
    return pairs.bidirectional_top1(_recalled(spark, d, 1))


@query
def mutual_cap(spark, d):
    return pairs.mutual_cap(pairs.symmetric_union(_recalled(spark, d, 5)), 2).select("a", "b", "score")


@query
def linkage_entities(spark, d):
    """Recall, one-to-one assignment per clip pair and component, constrained union: an entity for every vector."""
    scratch = Scratch(spark, "linkage")
    viable = scratch.save(pairs.symmetric_union(_recalled(spark, d, 3)).filter("score >= 0.3"))
    comp = components.connected_components(viable.select("a", "b"), "a", "b")
    tagged = viable.join(comp.select(F.col("node").alias("a"), "component"), "a")
    # The matching is oriented from the lower clip to the higher one.
    up = F.col("a_side") < F.col("b_side")
    oriented = tagged.select("component", F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("b"), "score", F.least("a_side", "b_side").alias("s1"), F.greatest("a_side", "b_side").alias("s2"))
    chosen = folds.assign_pairs(oriented, ["component", "s1", "s2"], 0.3)

    def unite(pdf):
        pdf = pdf.sort_values(["score", "a", "b"], ascending=[False, True, True])
        side = {x: s for c, s in (("a", "s1"), ("b", "s2")) for x, s in zip(pdf[c], pdf[s], strict=True)}
        head, _ = folds.constrained_union(list(zip(pdf["a"], pdf["b"], strict=True)), side)
        import pandas as pd

        return pd.DataFrame({"vec_id": list(head), "head": list(head.values())})

    heads = chosen.groupBy("component").applyInPandas(unite, "vec_id long, head long")
    return _features(spark, d).select("vec_id").join(heads, "vec_id", "left").select("vec_id", F.coalesce("head", "vec_id").alias("entity_head"))


@query
def similarity_components(spark, d):
    """Components of the graph of strong mutual pairs."""
    strong = pairs.symmetric_union(_recalled(spark, d)).filter("score >= 0.4")
    return components.connected_components(strong, "a", "b").select(F.col("node").alias("vec_id"), "component")


# --- scores -----------------------------------------------------------------------------------------------------------


def _parts(spark, d):
    unknown = F.lit("unknown")
    return table(spark, d, "part").select(
        "p_partkey", "p_brand", "p_size", "p_retailprice",
        F.when(F.col("p_partkey") % 7 == 0, unknown).otherwise(F.col("p_type")).alias("kind"),
        F.when(F.col("p_partkey") % 5 == 0, unknown).otherwise(F.element_at(F.split("p_name", " "), 1)).alias("word"),
    )


def _part_pairs(spark, d):
    return pairs.block_pairs(_parts(spark, d), block=["p_brand", "p_size"], key="p_partkey")


@query
def attribute_score(spark, d):
    """Blocked pairs with attribute agreement, aspect similarity and a score whose missing terms cede their weight."""
    j = _part_pairs(spark, d)
    agree = pairs.attribute_agreement([(F.col("a.kind"), F.col("b.kind")), (F.col("a.word"), F.col("b.word"))])
    aspect = pairs.aspect_similarity(F.col("a.p_retailprice"), F.col("b.p_retailprice"))
    # Step by step: each value is computed once, and no generated method grows beyond what the JVM compiles.
    g = j.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), agree.alias("agree"), aspect.alias("aspect"))
    g = g.withColumn("score", pairs.ceding_score([(0.6, F.col("agree")), (0.4, F.col("aspect"))]))
    return g.select("a", "b", pairs.rounded(F.col("agree")).alias("agreement"), *[pairs.rounded(F.col(c)).alias(c) for c in ("aspect", "score")])


@query
def pair_gates(spark, d):
    """Gate reasons per pair and how many pairs have each set of them."""
    gates = pairs.reasons({
        "SAME_SIDE": F.col("a.p_partkey") % 3 == F.col("b.p_partkey") % 3,
        "LOW_QUALITY": F.least("a.p_retailprice", "b.p_retailprice") < 950,
        "CATEGORY_CONFLICT": (F.col("a.kind") != "unknown") & (F.col("b.kind") != "unknown") & (F.col("a.kind") != F.col("b.kind")),
    })
    j = _part_pairs(spark, d).select(F.array_join(gates, ",").alias("reasons"))
    return j.groupBy("reasons").agg(F.count(F.lit(1)).alias("n_pairs"))


@query
def quantile_calibration(spark, d):
    """Within customer, orders take over the price of their rank by date."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day"))
    return pairs.quantile_transplant(o, ["o_custkey"], "o_totalprice", "day", ["o_orderkey"]).select("o_orderkey", F.round("calibrated", 2).alias("calibrated"))


@query
def multiview_similarity(spark, d):
    """Best pair, mean chamfer and symmetric top-2 between the view sets of an entity and the next one."""
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("g"), "vec_id", K.unit(F.col("embedding")).alias("v"))
    a, b = v.select("g", F.col("vec_id").alias("i"), F.col("v").alias("x")), v.select((F.col("g") - 1).alias("g"), F.col("vec_id").alias("j"), F.col("v").alias("y"))
    s = a.join(b, "g").select("g", "i", "j", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), K.dot(F.col("x"), F.col("y")))), 6).alias("s"))
    row = s.groupBy("g", "i").agg(F.max("s").alias("m")).groupBy("g").agg(F.avg("m").alias("r"))
    col = s.groupBy("g", "j").agg(F.max("s").alias("m")).groupBy("g").agg(F.avg("m").alias("c"))
    best = s.groupBy("g").agg(F.min(F.struct((-F.col("s")).alias("n"), "i", "j")).alias("b"))
    second = s.join(best, "g").filter((F.col("i") != F.col("b.i")) & (F.col("j") != F.col("b.j"))).groupBy("g").agg(F.max("s").alias("s2"))
    out = best.join(row, "g").join(col, "g").join(second, "g", "left")
    chamfer = (F.col("r") + F.col("c")) / 2
    top2 = F.when(F.col("s2").isNull(), -F.col("b.n")).otherwise((F.col("s2") - F.col("b.n")) / 2)
    return out.select(F.col("g").alias("entity"), (-F.col("b.n")).alias("max_pair"), F.round(chamfer + 1e-9, 5).alias("chamfer"), F.round((chamfer + top2) / 2 + 1e-9, 5).alias("symmetric_top2"))


@query
def weighted_mean_vector(spark, d):
    """Weighted mean vector of each entity's views, component by component."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("entity"), (F.col("vec_id") % 3 + 1).alias("w"), F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("entity", "pos").agg((F.round(F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w"), 5) + 0.0).alias("mean"))


@query
def box_geometry(spark, d):
    """Overlap measures of the boxes of neighbouring lines of an order."""
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 10 + F.col("l_tax") * 100).alias("x2"), (y + 5).alias("y2"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", box.alias("box"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    both = li.withColumn("next", F.lead("box").over(w)).filter("next is not null")
    return both.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(K.iou("box", "next"), 6).alias("iou"), F.round(K.intersection_over_smaller("box", "next"), 6).alias("iom"), F.round(K.center_distance("box", "next"), 6).alias("distance")
    )


def _boxes(spark, d):
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    return table(spark, d, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("day"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("score"),
        x.alias("x1"), y.alias("y1"), (x + 10).alias("x2"), (y + 5).alias("y2"),
    )


@query
def suppressed_boxes(spark, d):
    """Greedy suppression of overlapping boxes of one supplier and month."""
    b = _boxes(spark, d).withColumn("frame", F.date_format("day", "yyyy-MM")).drop("day")
    return folds.suppress_boxes(b, ["l_suppkey", "frame"], 0.4).select("l_suppkey", "frame", "id")


@query
def tracked_boxes(spark, d):
    """Tracks of one supplier's boxes over the months."""
    b = _boxes(spark, d).withColumn("frame", (F.year("day") * 12 + F.month("day")).cast("int")).drop("day", "score")
    return folds.track_boxes(b, ["l_suppkey"]).select("l_suppkey", "frame", "id", "track")


# --- evaluation -------------------------------------------------------------------------------------------------------


@query
def retrieval_metrics(spark, d):
    """Recall at 1 and 5 and mean reciprocal rank of vectors of clip 0 among those of clips 1 and 2, by label."""
    first = pairs.first_hit_rank(_features(spark, d), key="vec_id", query=F.col("clip") == 0, label="label", vector="embedding")
    within = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6)
    return first.groupBy("label").agg(F.count(F.lit(1)).alias("n_queries"), within(1).alias("recall_1"), within(5).alias("recall_5"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


@query
def rank_auc(spark, d):
    """Area under the curve of price for urgent orders, ties one half, per status."""
    o = table(spark, d, "orders").select("o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("s"), (F.col("o_orderpriority") == "1-URGENT").alias("y"))
    # Ranks come from counts per distinct score, so no window sorts all rows of a status.
    c = o.groupBy("o_orderstatus", "s").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("p"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("o_orderstatus").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = c.withColumn("rank", below + (F.col("n") + 1) / 2)
    s = r.groupBy("o_orderstatus").agg(F.sum(F.col("rank") * F.col("p")).alias("rs"), F.sum("p").alias("np"), F.sum(F.col("n") - F.col("p")).alias("nn"))
    auc = (F.col("rs") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))
    return s.filter("np > 0 and nn > 0").select("o_orderstatus", F.col("np").alias("n_pos"), F.col("nn").alias("n_neg"), F.round(auc, 6).alias("auc"))


@query
def wilson_by_group(spark, d):
    """Share of long documents with its interval, by language and kind and by language alone."""
    docs = table(spark, d, "documents").select("lang", "doc_kind", (F.col("n_chars") > 500).alias("long"))
    g = docs.groupingSets([["lang", "doc_kind"], ["lang"]], "lang", "doc_kind").agg(F.grouping("doc_kind").cast("int").alias("whole_lang"), F.count(F.lit(1)).alias("total"), F.count_if("long").alias("hits"))
    low, high = K.wilson(F.col("hits"), F.col("total"))
    return g.select("lang", "doc_kind", "whole_lang", "total", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query
def mcnemar_paired(spark, d):
    """Exact test of two yes-or-no readings of the same documents, by kind."""
    docs = table(spark, d, "documents").select("doc_kind", (F.col("n_chars") > 600).alias("x"), (F.col("doc_id") % 3 == 0).alias("y"))
    c = docs.groupBy("doc_kind").agg(F.count_if(F.col("x") & ~F.col("y")).alias("only_x"), F.count_if(~F.col("x") & F.col("y")).alias("only_y"))
    return c.select("doc_kind", "only_x", "only_y", F.round(K.mcnemar_p(F.col("only_x"), F.col("only_y")) + 1e-9, 6).alias("p"))


@query
def nearest_rank_quantiles(spark, d):
    """Nearest-rank quantiles of the price by priority."""
    return groups.nearest_ranks(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query
def seed_statistics(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n")
    )


@query
def array_differences(spark, d):
    """Profile of the differences between each vector with an even id and the next id's, over what is finite in both."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    a, b = e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    j = a.join(b, "vec_id").withColumn("same_pattern", F.transform("v", finite) == F.transform("w", finite))
    x = j.select("vec_id", "same_pattern", F.explode(F.zip_with("v", "w", lambda p, q: F.when(finite(p) & finite(q), F.abs(p - q)))).alias("x")).filter("x is not null")
    at = lambda p: F.round(F.percentile("x", p) + 1e-9, 5)
    return x.groupBy("vec_id", "same_pattern").agg(F.round(F.max("x"), 6).alias("max_abs"), F.round(F.avg("x"), 6).alias("mean_abs"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rmse"))


@query
def ranked_overlap(spark, d):
    """Overlap of the customers' hundred dearest and hundred latest orders, by segment: same ranks, Jaccard."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = o.withColumn("r", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("r <= 100").select("c_mktsegment", F.col("o_orderkey").alias("k"), F.col("r").alias("ra"))
    b = o.withColumn("r", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_orderdate"), "o_orderkey"))).filter("r <= 100").select("c_mktsegment", F.col("o_orderkey").alias("k"), F.col("r").alias("rb"))
    j = a.join(b, ["c_mktsegment", "k"], "full")
    both = F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull())
    return j.groupBy("c_mktsegment").agg(both.alias("shared"), F.count_if(F.col("ra") == F.col("rb")).alias("same_rank"), F.round(both / F.count(F.lit(1)), 6).alias("jaccard"))


# --- votes, facts, time -----------------------------------------------------------------------------------------------


@query
def consensus_vote(spark, d):
    """Each user's event type by strict plurality of the confident events, with at least a fifth of all events behind it."""
    e = table(spark, d, "events")
    all_ = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    votes = e.filter("value >= 2").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("v"))
    w = Window.partitionBy("user_id").orderBy(F.desc("v"), "event_type")
    top = votes.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("v").over(w)).filter("rn = 1")
    ok = (F.col("v") > F.coalesce("second", F.lit(0))) & (F.col("v") >= 0.2 * F.col("n"))
    return all_.join(top, "user_id", "left").select("user_id", F.when(ok, F.col("event_type")).alias("consensus"), F.coalesce("v", F.lit(0)).alias("votes"), "n")


@query
def majority_label(spark, d):
    """The commonest priority of each customer's orders, ties to the first in order."""
    c = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("o_custkey").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("o_orderpriority").alias("p"))).alias("b"))
    return best.select("o_custkey", F.col("b.p").alias("priority"), (-F.col("b.m")).alias("n"))


@query
def tri_state_fact(spark, d):
    """Whether a user's values are near, not near, in conflict or unknown; missing evidence stays unknown."""
    near, far = F.bool_or(F.col("value") > 20), F.bool_or((F.col("value") < 0.5) & (F.col("event_type") == "error"))
    e = table(spark, d, "events").groupBy("user_id").agg(F.coalesce(near, F.lit(False)).alias("near"), F.coalesce(far, F.lit(False)).alias("far"))
    return e.select("user_id", F.when(F.col("near") & F.col("far"), "CONFLICT").when(F.col("near"), "NEAR").when(F.col("far"), "NOT_NEAR").otherwise("UNKNOWN").alias("fact"))


@query
def gap_islands(spark, d):
    """Runs of a user's events less than six hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("user_id", "event_id", "ts", us.alias("us"))
    e = e.withColumn("fresh", F.coalesce((F.col("us") - F.lag("us").over(w) > 6 * 3600 * 1_000_000).cast("int"), F.lit(1)))
    e = e.withColumn("island", F.sum("fresh").over(w))
    return e.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), ((F.max("us") - F.min("us")) / F.lit(1_000_000)).cast("long").alias("seconds"))


@query
def mad_signature(spark, d):
    """Median and median absolute deviation of the values by user and type."""
    e = table(spark, d, "events").select("user_id", "event_type", "value")
    med = e.groupBy("user_id", "event_type").agg(F.median("value").alias("m"))
    return e.join(med, ["user_id", "event_type"]).groupBy("user_id", "event_type").agg(F.round(F.first("m"), 6).alias("median"), F.round(F.median(F.abs(F.col("value") - F.col("m"))), 6).alias("mad"), F.count(F.lit(1)).alias("n"))


@query
def linear_trend(spark, d):
    """Slope of the values over time, per user."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000
    e = table(spark, d, "events").select("user_id", (us - 19_723).alias("day"), "value")
    return e.groupBy("user_id").agg(F.round(F.regr_slope("value", "day"), 5).alias("slope"), F.round(F.regr_intercept("value", "day"), 4).alias("start"))


@query
def representative_row(spark, d):
    """One event for each user and day: the largest value, then the earliest."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), "event_id", "event_type", "value")
    best = e.groupBy("user_id", "day").agg(F.min(F.struct((-F.col("value")).alias("m"), "event_id", "event_type")).alias("b"))
    return best.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("b.event_id").alias("event_id"), F.col("b.event_type").alias("event_type"))


@query
def interleaved_views(spark, d):
    """Round robin over the lines of a customer's orders: first lines first, then second ones."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("turn"))
    return li.select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("turn", "l_orderkey", "l_partkey")).alias("place"))


# --- division, sets, checks -------------------------------------------------------------------------------------------


@query
def complete_cover(spark, d):
    """Customers who have ordered in every priority: relational division."""
    o = table(spark, d, "orders")
    need = o.agg(F.countDistinct("o_orderpriority").alias("need"))
    per = o.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"), F.count(F.lit(1)).alias("n_orders"))
    return per.join(F.broadcast(need), F.col("n") == F.col("need")).select("o_custkey", "n_orders")


@query
def stable_category(spark, d):
    """Suppliers with at least two lines in every year that has any lines."""
    li = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"))
    years = li.agg(F.countDistinct("y").alias("need"))
    per = li.groupBy("l_suppkey", "y").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_years"), F.min("n").alias("least"))
    return per.join(F.broadcast(years), F.col("n_years") == F.col("need")).select("l_suppkey", "least")


@query
def constraint_violations(spark, d):
    """Violated rules and how often: unique keys, references, ranges."""
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    doc = table(spark, d, "documents")
    rules = [
        ("lineitem.key_unique", li.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")),
        ("lineitem.order_exists", li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        ("orders.customer_exists", o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        ("documents.lang_known", doc.filter(~F.coalesce(F.col("lang"), F.lit("")).isin("en", "zh"))),
        ("documents.text_present", doc.filter("text is null or trim(text) = ''")),
    ]
    out = None
    for name, bad in rules:
        one = bad.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("rule"), "n_violations")
        out = one if out is None else out.unionByName(one)
    return out


@query
def trace_replay(spark, d):
    """Message log audit by correlation: messages, repeated deliveries, causes that come later or nowhere."""
    log = table(spark, d, "message_log").select(F.lower(F.btrim("message_id", F.lit(" \t"))).alias("mid"), "ordinal", F.lower(F.btrim("causation_id", F.lit(" \t"))).alias("cause"), F.lower(F.btrim("correlation_id", F.lit(" \t"))).alias("run"))
    first = log.groupBy("mid").agg(F.min("ordinal").alias("first"))
    rows = log.join(first.select("mid", F.col("first").alias("own")), "mid").join(first.select(F.col("mid").alias("cause"), F.col("first").alias("parent")), "cause", "left")
    named = F.coalesce(F.col("cause") != "", F.lit(False))
    return rows.groupBy(F.nullif("run", F.lit("")).alias("run")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("ordinal") > F.col("own")).alias("n_again"),
        F.count_if(named & F.col("parent").isNull()).alias("n_missing"), F.count_if(F.col("parent") >= F.col("own")).alias("n_later"),
    )


# --- texts, hashes, parsing -------------------------------------------------------------------------------------------


@query
def vocab_resolution(spark, d):
    """Part names resolved by whole-word containment of aliases, only if exactly one alias fits."""
    p = table(spark, d, "part").select("p_partkey", K.label_form(F.col("p_name")).alias("name"))
    words = p.select("p_partkey", "name", F.explode(F.array_distinct(F.split("name", " "))).alias("w"))
    alias = table(spark, d, "part").select(F.element_at(F.split(K.label_form(F.col("p_name")), " "), -1).alias("w")).distinct()
    hit = words.join(alias, "w").groupBy("p_partkey").agg(F.countDistinct("w").alias("n"), F.min("w").alias("alias"))
    return p.join(hit, "p_partkey", "left").select("p_partkey", F.when(F.col("n") == 1, F.col("alias")).alias("canonical"), F.coalesce("n", F.lit(0)).alias("n_targets"))


@query
def tolerant_json(spark, d):
    """Payloads and event properties read without failing on damaged ones, by table."""
    a = table(spark, d, "message_log").select(F.lit("message_log").alias("source"), F.col("payload").alias("t"))
    b = table(spark, d, "events").select(F.lit("events").alias("source"), F.col("props").alias("t"))
    x = a.unionAll(b).select("source", "t", F.get_json_object("t", "$.k").alias("k"), F.get_json_object("t", "$.action").alias("action"))
    return x.groupBy("source").agg(F.count("t").alias("n_texts"), F.count("k").alias("n_k"), F.sum(F.expr("try_cast(k as bigint)")).alias("sum_k"), F.count_if(F.col("action").isNotNull() & F.col("action").isin("PLACEMENT_READY", "TASKS_READY", "ENTITIES_READY")).alias("n_known_action"))


@query
def hash_bucket_split(spark, d):
    """Rows of each of eight buckets by hash of the document id."""
    return table(spark, d, "documents").groupBy(K.hash_bucket(F.col("doc_id").cast("string"), 8).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query
def entity_id_hash(spark, d):
    """A name for the set of parts of each order, independent of their order."""
    ids = F.collect_set(F.col("l_partkey").cast("string"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(K.set_id("entity_", ids).alias("entity_id"))


@query
def leave_last_out(spark, d):
    """Each supplier's lines of its last shipping day against the rest: rows and shared parts."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    last = li.withColumn("last", F.col("l_shipdate") == F.max("l_shipdate").over(Window.partitionBy("l_suppkey")))
    per = last.groupBy("l_suppkey", "l_partkey").agg(F.count_if("last").alias("t"), F.count_if(~F.col("last")).alias("r"))
    return per.groupBy("l_suppkey").agg(F.sum("t").alias("n_test"), F.sum("r").alias("n_train"), F.count_if((F.col("t") > 0) & (F.col("r") > 0)).alias("n_shared_parts"))


@query
def threshold_sweep(spark, d):
    """Recalled pairs judged at a grid of thresholds in one pass: precision against equal name words."""
    grid = [(0.0, x / 10) for x in range(5, 10)]
    g = pairs.swept_pairs(_parts(spark, d), block=["p_brand", "p_size"], key="p_partkey", value="p_retailprice", same="word", settings=grid, digits=6).select("threshold", "n_pairs", "n_hits")
    return g.withColumn("precision", F.round(F.try_divide("n_hits", "n_pairs"), 6))


@query
def required_sample_size(spark, d):
    """The smallest number of trials whose Wilson interval is no wider than 0.05, and 0.01, to either side, by language."""
    g = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_chars") > 500).alias("hits"))
    p = F.col("hits") / F.col("total")
    return g.select("lang", K.required_trials(p, 0.05).alias("n_needed"), K.required_trials(p, 0.01).alias("n_needed_01"))


@query
def label_reconciliation(spark, d):
    """Part names judged against two vocabularies: exact and unambiguous, ambiguous, or unmapped."""
    p = table(spark, d, "part").select("p_partkey", K.label_form(F.col("p_name")).alias("name"), "p_type", "p_size")
    exact = p.filter("p_size > 25").groupBy("name").agg(F.countDistinct("p_type").alias("n"), F.min("p_type").alias("target"))
    j = p.join(exact, "name", "left")
    status = F.when(F.col("n").isNull(), "unmapped").when(F.col("n") > 1, "conflict").otherwise("mapped")
    return j.select("p_partkey", status.alias("status"), F.when(F.col("n") == 1, F.col("target")).alias("target"), F.when(F.col("n") == 1, 1.0).otherwise(0.0).alias("confidence"))


@query
def first_known_value(spark, d):
    """The first known of three ordered readings of a document's language, and which one it was."""
    known = {"lang": F.lower(F.substring("lang", 1, 2)), "kind": F.when(F.col("doc_kind") == "journal", "en"), "length": F.when(F.col("n_chars") < 300, "zh")}
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in known.items()])
    return table(spark, d, "documents").select("doc_id", F.coalesce(*known.values()).alias("value"), source.alias("source"))


@query
def gate_report(spark, d):
    """Metrics held against their bounds, one row a gate."""
    li = table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("discount"), F.max("l_quantity").alias("quantity"), F.count_if(F.col("l_partkey").isNull()).alias("nulls"))
    gates = F.array(*[
        F.struct(F.lit(name).alias("gate"), F.col(col).cast("double").alias("value"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
        for name, col, low, high in (("rows", "n", 1, 1e15), ("mean_discount", "discount", 0.0, 0.04), ("quantity", "quantity", 1, 50), ("null_parts", "nulls", 0, 0))
    ])
    return li.select(F.inline(gates)).withColumn("passed", (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))


@query
def payload_hashes(spark, d):
    """Messages by type whose payload has the recorded hash, another one, or nothing to compare."""
    log = table(spark, d, "message_log").select("message_type", "payload", "payload_hash")
    same = F.sha2("payload", 256) == F.lower("payload_hash")
    return log.groupBy("message_type").agg(F.count_if(same).alias("n_same"), F.count_if(~same).alias("n_other"), F.count_if(same.isNull()).alias("n_open"))


@query
def event_windows(spark, d):
    """Counts and sums per day and type: the batch form of the windowed stream."""
    from linkloom.streaming.folds import windowed_counts

    w = windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def partition_check(spark, d):
    """Parts that several suppliers' line sets share: how many belong to one set, to several, to none."""
    p = table(spark, d, "part").select("p_partkey")
    own = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n"))
    j = p.join(own, F.col("p_partkey") == F.col("l_partkey"), "full")
    kind = F.when(F.col("l_partkey").isNull(), "none").when(F.col("p_partkey").isNull(), "unknown").when(F.col("n") == 1, "one").otherwise("several")
    return j.groupBy(kind.alias("membership")).agg(F.count(F.lit(1)).alias("n_parts"))
