"""Queries of the track, join, evaluation and text operators, whole tables each.

Events stand for observations: the video is the user, the label the event type, a track the events of one user, type and
third of the ids, its times the days. Lines of an order stand for boxes in a frame of supplier and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import kernels as K
from linkloom.functions import text as X
from linkloom.functions.ids import id_form
from linkloom.operators import folds, joins, pairs, tracks
from linkloom.plans.linkage import _boxes, _part_pairs, _parts, _recalled, query_into
from linkloom.session import Scratch
from linkloom.sources.tables import table

QUERIES: dict = {}
query = query_into(QUERIES)


# --- tracks -----------------------------------------------------------------------------------------------------------


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("video"), F.col("event_type").alias("label"), (F.col("event_id") % 3).alias("part"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"), "value")
    t = tracks.track_features(e, ["video", "label", "part"], time="day", quality="value", size="value")
    return t.withColumn("track", F.col("video") * 100 + F.dense_rank().over(Window.partitionBy("video").orderBy("label", "part")))


@query
def track_features(spark, d):
    """Observations, span, best quality and median size of every track."""
    return _tracks(spark, d).select("track", "video", "label", "n", "first", "last", "quality", F.round("size", 6).alias("size"), F.size("times").cast("long").alias("n_times"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return tracks.stitch_candidates(_tracks(spark, d), video="video", label="label", key="track", max_gap=60)


@query
def stitch_candidates(spark, d):
    """Tracks of one video and label that are never seen together."""
    return _candidates(spark, d)


def _stitched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = Scratch(spark, "tracks").save(_tracks(spark, d))
    c = tracks.stitch_candidates(t, video="video", label="label", key="track", max_gap=60).withColumn("score", 1 / (1 + F.col("gap").cast("double")))
    return t, tracks.stitch(c, t, key="track")


@query
def stitched_tracks(spark, d):
    """The head of every track after stitching within the video."""
    return _stitched(spark, d)[1]


@query
def stitched_checks(spark, d):
    """What must hold of stitched tracks: every track once, a head of its own cluster, one video and label, no time twice."""
    t, heads = _stitched(spark, d)
    heads = Scratch(spark, "heads").save(heads)
    j = t.join(heads, "track")
    times = j.select("head", F.explode("times").alias("time"))
    twice = times.groupBy("head", "time").count().filter("count > 1")
    mixed = j.groupBy("head").agg(F.countDistinct("video", "label").alias("n"), F.min("track").alias("least")).filter("n > 1 or least != head")
    return heads.agg(F.count(F.lit(1)).alias("n_tracks"), F.countDistinct("track").alias("n_different")).join(twice.agg(F.count(F.lit(1)).alias("times_twice"))).join(mixed.agg(F.count(F.lit(1)).alias("mixed")))


@query
def merged_features(spark, d):
    """Tracks of a user and type as one cluster: weighted means and the member that names it."""
    t = _tracks(spark, d)
    heads = t.groupBy("video", "label").agg(F.min("track").alias("head"))
    m = tracks.merged_features(t, t.join(heads, ["video", "label"]).select("track", "head"), "track")
    return m.select("head", "n_tracks", "n", "quality", F.round("size", 5).alias("size"), "hero")


@query
def low_evidence_tags(spark, d):
    """Tracks with few or poor observations, by whether they are protected by another track of their user."""
    t = _tracks(spark, d)
    protected = t.filter("quality > 60").select("track")
    tagged = tracks.low_evidence(t, "track", protected, (F.col("n") <= 2) | (F.col("quality") < 5))
    return tagged.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("low_evidence").alias("n_low"))


@query
def entity_states(spark, d):
    """State and confidence of the components of strong links, weaker links making their ends doubtful."""
    from linkloom.operators import components

    p = Scratch(spark, "states").save(pairs.symmetric_union(_recalled(spark, d)).select("a", "b", "score").filter("score >= 0.3"))
    comp = components.connected_components(p.filter("score >= 0.45").select("a", "b"), "a", "b")
    vecs = table(spark, d, "embeddings").select("vec_id")
    members = vecs.join(comp.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("entity"))
    s = tracks.entity_states(members, p.withColumn("ambiguous", F.col("score") < 0.45), "vec_id")
    return s.select("entity", "n_members", "state", F.round("confidence", 6).alias("confidence"))


@query
def cycle_closures(spark, d):
    """Vectors of the third clip that complete a mutual best pair of the first two."""
    scratch = Scratch(spark, "cycles")
    links = scratch.save(pairs.symmetric_union(_recalled(spark, d)))
    top = scratch.save(pairs.bidirectional_top1(_recalled(spark, d, 1)).select("a", "b", F.lit(True).alias("t")))
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).cast("int").alias("side"))
    first = top.filter("a % 3 < 2 and b % 3 < 2")
    heads = first.select(F.explode(F.array("a", "b")).alias("id"), F.col("a").alias("head"))
    members = vecs.join(heads, "id", "left").select("id", "side", F.coalesce("head", "id").alias("entity"))
    marked = links.join(top, ["a", "b"], "left").select("a", "b", "score", F.coalesce("t", F.lit(False)).alias("top"))
    return tracks.close_cycles(members, marked.withColumn("assigned", F.col("top") & (F.col("score") >= 0.25)), new=0.15, match=0.25)


@query
def locked_assignment(spark, d):
    """What must hold of an assignment with locked pairs: all locked ones stand, no end twice, and nothing is lost to greed."""
    scratch = Scratch(spark, "locked")
    m = scratch.save(pairs.endpoint_margins(pairs.symmetric_union(_recalled(spark, d))).filter("a_side != b_side"))
    up = F.col("a_side") < F.col("b_side")
    m = scratch.save(m.select(F.concat_ws("-", F.least("a_side", "b_side"), F.greatest("a_side", "b_side")).alias("sides"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("b"), "score", "margin"))
    sure = folds.lock_baseline(m, m, match=0.4, margin=0.05)
    got = scratch.save(folds.assign_pairs(sure, ["sides"], 0.2))
    twice = lambda c: got.groupBy("sides", c).count().filter("count > 1").agg(F.count(F.lit(1)).alias(f"{c}_twice"))
    lost = sure.filter("locked").join(got, ["sides", "a", "b"], "left_anti").agg(F.count(F.lit(1)).alias("locked_lost"))
    # A pair above the floor both of whose ends stay free would have been taken.
    free = sure.filter("score > 0.2").join(got.select("sides", "a"), ["sides", "a"], "left_anti").join(got.select("sides", "b"), ["sides", "b"], "left_anti").agg(F.count(F.lit(1)).alias("left_free"))
    return sure.agg(F.count_if("locked").alias("n_locked")).join(lost).join(free).join(twice("a")).join(twice("b"))


@query
def prototype_vectors(spark, d):
    """Mean of the three best views of every tracklet, component by component; unusable vectors take no part."""
    v = table(spark, d, "track_embedding").select("vec_id", id_form("tracklet_id").alias("track"), "quality", "view_index", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    usable = (F.size("vector") == 96) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    best = tracks.best_views(v.filter("track is not null").filter(usable), "track", [F.desc_nulls_last("quality"), F.asc_nulls_last("view_index"), F.asc("vec_id")], 3)
    return best.select("track", F.posexplode("vector").alias("pos", "x")).groupBy("track", "pos").agg((F.round(F.avg("x") + 1e-9, 5) + 0.0).alias("mean"))


@query
def entity_views(spark, d):
    """Views of the tracklets of every recorded entity, and its tracklets without any."""
    e = table(spark, d, "object_entity").select(id_form("entity_id").alias("entity"), F.explode("tracklet_ids").alias("t")).select("entity", id_form("t").alias("track")).filter("entity is not null and track is not null").distinct()
    v = table(spark, d, "track_embedding").groupBy(id_form("tracklet_id").alias("track")).agg(F.count(F.lit(1)).alias("n_views"))
    j = e.join(v, "track", "left")
    return j.groupBy("entity").agg(F.count(F.lit(1)).alias("n_tracks"), F.coalesce(F.sum("n_views"), F.lit(0)).alias("n_views"), F.count_if(F.col("n_views").isNull()).alias("n_dangling"))


@query
def anchor_entities(spark, d):
    """Entities that hold confirmed tracklets of an identity: how many, whether they hold another identity's, and whether
    one entity holds all of them."""
    known = table(spark, d, "sf1_sample").select(id_form("identity_id").alias("anchor"), id_form("tracklet_id").alias("track")).filter("anchor is not null and track is not null and anchor rlike '_anchor_'").distinct()
    own = table(spark, d, "object_entity").select(id_form("entity_id").alias("entity"), F.explode("tracklet_ids").alias("t")).select("entity", id_form("t").alias("track")).filter("entity is not null and track is not null").distinct()
    j = known.join(own, "track")
    per = j.groupBy("anchor", "entity").agg(F.count(F.lit(1)).alias("n_shared"))
    foreign = j.groupBy("entity").agg(F.countDistinct("anchor").alias("n_anchors"))
    need = known.groupBy("anchor").agg(F.count(F.lit(1)).alias("need"))
    out = per.join(foreign, "entity").join(need, "anchor")
    return out.select("anchor", "entity", "n_shared", (F.col("n_anchors") > 1).alias("has_foreign"), ((F.col("n_shared") == F.col("need")) & (F.col("n_anchors") == 1)).alias("complete"))


# --- boxes ------------------------------------------------------------------------------------------------------------


@query
def box_policies(spark, d):
    """Overlap with clamped and plain areas and both normalised centre distances of neighbouring lines' boxes."""
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 10 - F.col("l_tax") * 200).alias("x2"), (y + 5).alias("y2"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", box.alias("box"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    both = li.withColumn("next", F.lead("box").over(w)).filter("next is not null")
    return both.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(K.iou("box", "next"), 6).alias("clamped"), F.round(K.iou_plain("box", "next"), 6).alias("plain"),
        F.round(K.center_distance("box", "next") / F.lit(K.diagonal(640, 480)), 6).alias("of_frame"), F.round(K.center_distance_relative("box", "next"), 6).alias("of_boxes"),
    )


@query
def polygon_boxes(spark, d):
    """The box around the points of every order's lines."""
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))).alias("points"))
    return p.select("l_orderkey", F.inline(F.array(K.polygon_box(F.col("points"))))).select("l_orderkey", *[F.round(c, 6).alias(c) for c in folds.BOX])


@query
def tile_grid(spark, d):
    """Overlapping tiles of a picture as wide as the supplier's number says."""
    s = table(spark, d, "supplier").select("s_suppkey", (640 + F.col("s_suppkey") % 97).cast("double").alias("w"), F.lit(480.0).alias("h"))
    return s.select("s_suppkey", F.inline(K.tiles(F.col("w"), F.col("h"), 3, 0.1)))


@query
def median_boxes(spark, d):
    """The component-wise median box of every supplier and month."""
    b = _boxes(spark, d).withColumn("frame", F.date_format("day", "yyyy-MM"))
    return b.groupBy("l_suppkey", "frame").agg(*[F.round(F.median(c), 6).alias(c) for c in folds.BOX])


def _framed(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    return table(spark, d, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("day"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("label"), F.col("l_partkey").alias("part"),
        x.alias("x1"), y.alias("y1"), (x + 10).alias("x2"), (y + 5).alias("y2"),
    )


@query
def frame_anchors(spark, d):
    """Boxes of other labels in the same frame that hardly overlap: pairs by supplier."""
    b = _framed(spark, d)
    own, other = (b.select("l_suppkey", "day", F.col("label").alias(f"l{k}"), F.struct(*folds.BOX).alias(f"b{k}")) for k in (1, 2))
    j = own.join(other, ["l_suppkey", "day"]).filter((F.col("l1") != F.col("l2")) & (F.round(K.iou("b1", "b2"), 9) < 0.3))
    return j.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_pairs"))


@query
def nearest_outlets(spark, d):
    """Each box with the nearest returned one of its frame within twelve units, if any."""
    p = _framed(spark, d).select("l_suppkey", "day", "id", "part", "label", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    p = p.withColumn("id", F.col("id") * 100_000 + F.col("part"))
    near = joins.nearest_in_group(p.filter("label != 'R'").select("l_suppkey", "day", "id", "x", "y"), p.filter("label = 'R'"), ["l_suppkey", "day"], 12.0)
    return near.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("n_near"), F.round(F.sum("distance"), 4).alias("total"))


@query
def frame_index(spark, d):
    """The parts seen in each frame, in order."""
    return _framed(spark, d).groupBy("l_suppkey", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x.cast("string")), ",").alias("parts"))


@query
def frame_scale(spark, d):
    """Median distance between the first boxes of the labels of a frame; null with fewer than two labels."""
    b = _framed(spark, d).withColumn("c", F.struct("id", "part", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")))
    top = b.groupBy("l_suppkey", "day", "label").agg(F.min("c").alias("c"))
    a, o = (top.select("l_suppkey", "day", F.col("label").alias(f"l{k}"), F.col("c").alias(f"c{k}")) for k in (1, 2))
    gap = F.hypot(F.col("c1.x") - F.col("c2.x"), F.col("c1.y") - F.col("c2.y"))
    s = a.join(o, ["l_suppkey", "day"]).filter("l1 < l2").groupBy("l_suppkey", "day").agg(F.median(gap).alias("scale"))
    frames = top.select("l_suppkey", "day").distinct()
    return frames.join(s, ["l_suppkey", "day"], "left").select("l_suppkey", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("scale", 6).alias("scale"))


@query
def box_filters(spark, d):
    """Boxes by the reasons that speak against them: at the edge of the tile, too small, below the threshold of their source."""
    b = _framed(spark, d).select("label", "x1", "x2", F.col("x1").alias("q"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) - F.col("x1") / 2).alias("area"))
    floor = F.create_map(*[F.lit(v) for kv in {"A": 5.0, "N": 10.0, "R": 20.0}.items() for v in kv])
    reasons = pairs.reasons({"TILE_EDGE": (F.col("x1") <= 1) | (F.col("x2") >= 59), "SMALL": F.col("area") < 30, "SOURCE": F.col("q") < F.try_element_at(floor, F.col("label"))})
    return b.groupBy(F.array_join(reasons, ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query
def motion_prediction(spark, d):
    """The value a straight line through the three events before predicts for a user's last event, and the error in spreads."""
    us = (F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000 - 19_723).alias("t")
    e = table(spark, d, "events").select("user_id", "event_id", us, "value")
    last = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id")))).filter("rn <= 4")
    old = F.col("rn") > 1
    f = last.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(F.when(old, F.col("value")), F.when(old, F.col("t"))).alias("slope"), F.regr_intercept(F.when(old, F.col("value")), F.when(old, F.col("t"))).alias("base"),
        F.max(F.when(~old, F.col("t"))).alias("t"), F.max(F.when(~old, F.col("value"))).alias("value"), (F.max("value") - F.min("value")).alias("spread"),
    )
    seen = f.filter("n = 4")
    predicted = F.col("base") + F.col("slope") * F.col("t")
    return seen.select("user_id", F.round(predicted, 3).alias("predicted"), F.round(F.abs(predicted - F.col("value")) / F.greatest(F.lit(1.0), "spread"), 4).alias("error"))


@query
def matched_frames(spark, d):
    """Invariants of the matching of accepted and rejected boxes per frame: no box twice, every match overlaps."""
    b = _framed(spark, d).withColumn("one", F.lit(0)).withColumn("id", F.col("id") * 100_000 + F.col("part"))
    truth, found = b.filter("label != 'R'"), b.filter("label = 'R'")
    m = Scratch(spark, "matched").save(folds.match_frames(truth.dropDuplicates(["l_suppkey", "day", "id"]), found.dropDuplicates(["l_suppkey", "day", "id"]), ["l_suppkey", "day"], "one", 0.3))
    twice = lambda c: m.filter(F.col(c).isNotNull()).groupBy("l_suppkey", "day", c).count().filter("count > 1").agg(F.count(F.lit(1)).alias(f"{c}_twice"))
    whole = m.agg(F.count("truth_id").alias("n_truth"), F.count("found_id").alias("n_found"), F.count_if(F.col("iou") < 0.3).alias("n_apart"))
    return whole.join(twice("truth_id")).join(twice("found_id"))


@query
def spaced_events(spark, d):
    """Of each user the calmer half of the events, spaced by five days, ten at most."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("day"), "value")
    return folds.spaced_best(e, ["user_id"], "day", "value", share=0.5, gap=5.0, most=10).select("user_id", "event_id")


@query
def box_clusters(spark, d):
    """Clusters of the boxes of each supplier and month."""
    b = _boxes(spark, d).withColumn("frame", F.date_format("day", "yyyy-MM")).drop("day", "score")
    return folds.cluster_boxes(b, ["l_suppkey", "frame"], 0.5).groupBy("l_suppkey", "frame").agg(F.countDistinct("cluster").alias("n_clusters"), F.count(F.lit(1)).alias("n"))


@query
def suppressed_checks(spark, d):
    """What must hold of suppressed boxes: no two kept ones overlap by the threshold, every dropped one overlaps a kept one
    that comes before it."""
    scratch = Scratch(spark, "suppressed")
    b = scratch.save(_boxes(spark, d).withColumn("frame", F.date_format("day", "yyyy-MM")).drop("day").withColumn("n", F.monotonically_increasing_id()))
    kept = scratch.save(folds.suppress_boxes(b, ["l_suppkey", "frame"], 0.4))
    own = b.join(kept.select("n", F.lit(True).alias("kept")), "n", "left").select("l_suppkey", "frame", "n", "score", "kept", F.struct(*folds.BOX).alias("own"))
    other = kept.select("l_suppkey", "frame", F.col("n").alias("m"), F.col("score").alias("s"), F.struct(*folds.BOX).alias("other"))
    near = own.join(other, ["l_suppkey", "frame"]).filter((F.col("n") != F.col("m")) & (K.iou("own", "other") >= 0.4))
    per = near.groupBy("n").agg(F.bool_or("kept").alias("kept"), F.bool_or(F.col("s") >= F.col("score")).alias("covered"))
    j = own.join(per.select("n", F.col("kept").alias("clash"), "covered"), "n", "left")
    return j.agg(F.count(F.lit(1)).alias("n_boxes"), F.count_if(F.col("clash")).alias("kept_overlapping"), F.count_if(F.col("kept").isNull() & ~F.coalesce("covered", F.lit(False))).alias("dropped_alone"))


@query
def tracked_checks(spark, d):
    """What must hold of tracks: one box a frame, neighbours overlap and lie at most three frames apart, two boxes at least."""
    b = _boxes(spark, d).withColumn("frame", (F.year("day") * 12 + F.month("day")).cast("int")).drop("day", "score")
    t = Scratch(spark, "tracked").save(folds.track_boxes(b, ["l_suppkey"]))
    w = Window.partitionBy("l_suppkey", "track").orderBy("frame", "id")
    step = t.select("l_suppkey", "track", "frame", F.struct(*folds.BOX).alias("own"), F.lag("frame").over(w).alias("before"), F.lag(F.struct(*folds.BOX)).over(w).alias("last"), F.count(F.lit(1)).over(Window.partitionBy("l_suppkey", "track")).alias("n"))
    held = step.agg(F.count_if(F.col("frame") == F.col("before")).alias("same_frame"), F.count_if(F.col("frame") - F.col("before") > 3).alias("far"), F.count_if(F.col("before").isNotNull() & (F.round(K.iou("own", "last"), 9) < 0.3)).alias("apart"), F.count_if(F.col("n") < 2).alias("short"))
    return b.agg(F.count(F.lit(1)).alias("n_boxes")).join(held)


@query
def linkage_checks(spark, d):
    """What must hold of linked entities: every vector once, one of each clip at most, named by the smallest, linked inside."""
    from linkloom.plans.linkage import linkage_entities

    e = Scratch(spark, "entities").save(linkage_entities(spark, d))
    per = e.groupBy("entity_head").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("vec_id") % 3).alias("clips"))
    bad = per.agg(F.count_if(F.col("least") != F.col("entity_head")).alias("misnamed"), F.count_if(F.col("n") != F.col("clips")).alias("clip_twice"))
    link = pairs.symmetric_union(_recalled(spark, d)).filter("score >= 0.3").select("a", "b")
    both = link.join(e.select(F.col("vec_id").alias("a"), F.col("entity_head").alias("ha")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("entity_head").alias("hb")), "b").filter("ha = hb")
    linked = both.select(F.explode(F.array("a", "b")).alias("vec_id")).distinct()
    alone = e.join(per.filter("n > 1").select("entity_head"), "entity_head").join(linked, "vec_id", "left_anti").agg(F.count(F.lit(1)).alias("unlinked"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_different")).join(bad).join(alone)


# --- joins that check -------------------------------------------------------------------------------------------------


@query
def required_sidecar(spark, d):
    """Orders with the sidecar row of their customer, which must exist; its balance may be null."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    o = joins.required_join(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), c, ["k"])
    return o.agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("n_known"), F.round(F.sum("balance"), 2).alias("total"))


@query
def one_to_one_status(spark, d):
    """Parts and parts ordered on one line only: how each key stands in a one-to-one check."""
    sold = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return joins.one_to_one(table(spark, d, "part"), sold, "p_partkey").groupBy("status").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_right").alias("n_right"))


@query
def any_of_join(spark, d):
    """Suppliers with the lines that name them as supplier or whose part has their number."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    j = joins.any_of(table(spark, d, "supplier").select("s_suppkey"), li, [("s_suppkey", "l_suppkey"), ("s_suppkey", "l_partkey")], ["s_suppkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])
    return j.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def prediction_roles(spark, d):
    """Error events as predictions of the users with an even number: matched, duplicate, extra or missing."""
    e = table(spark, d, "events")
    truth = e.filter("user_id % 2 = 0").select("user_id").distinct()
    found = e.filter("event_type = 'error' and value > 10").select("user_id", F.col("event_id").alias("prediction"), "value")
    r = joins.best_predictions(truth, found, "user_id", [F.desc("value"), F.asc("prediction")])
    return r.select("user_id", "prediction", "role")


@query
def detection_metrics(spark, d):
    """Recall, duplicates per matched truth and false positives, from the roles of the predictions."""
    r = prediction_roles(spark, d)
    n = lambda role: F.count_if(F.col("role") == role)
    return r.agg(F.round(n("matched") / (n("matched") + n("missing")), 6).alias("recall"), F.round(n("duplicate") / F.greatest(F.lit(1), n("matched")), 6).alias("fragmentation"), n("extra").alias("false_positives"))


@query
def constrained_gates(spark, d):
    """Blocked pairs under user constraints: how many must, must not, or are under both."""
    j = _part_pairs(spark, d).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), (F.col("a.p_partkey") + F.col("b.p_partkey")).alias("s"))
    own = j.filter("s % 29 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("same").alias("kind")).unionAll(j.filter("s % 31 = 0").select("a", "b", F.lit("different")))
    return joins.constrained_pairs(j.select("a", "b"), own).groupBy("constraint").agg(F.count(F.lit(1)).alias("n_pairs"))


@query
def missing_rows(spark, d):
    """Parts by the number of their large returned lines, with a row for each that has none."""
    sold = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit("OBSERVED"))
    return joins.with_missing(sold, table(spark, d, "part"), "p_partkey", {"n": F.lit(0).cast("long"), "status": F.lit("NOT_OBSERVED")})


@query
def display_names(spark, d):
    """How many lines show their part's name, its brand, or neither."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("name"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"))
    j = table(spark, d, "lineitem").select("l_partkey").join(p, "l_partkey", "left")
    source = F.when(F.col("name").isNotNull(), "name").when(F.col("brand").isNotNull(), "brand").otherwise("unknown")
    return j.groupBy(source.alias("source"), F.coalesce("name", "brand", F.lit("?")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


# --- scores and votes -------------------------------------------------------------------------------------------------


@query
def semantic_tiers(spark, d):
    """Blocked pairs by the tier of their labels' agreement."""
    tier = K.semantic_tier([(F.col("a.kind"), F.col("b.kind"), 1.0), (F.col("a.p_retailprice"), F.col("b.p_retailprice"), 0.9), (F.lower(F.trim("a.word")), F.lower(F.trim("b.word")), 0.75)], 0.25)
    return _part_pairs(spark, d).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n_pairs"))


@query
def multiview_blend(spark, d):
    """Totals whose instance term gives way to the calibrated one, weighted within the terms that count."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_totalprice") / 600_000).alias("inst"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day"))
    c = pairs.quantile_transplant(o, ["o_custkey"], "inst", "day", ["o_orderkey"])
    weight = F.lit(0.6) + F.when(F.col("o_orderpriority") != "5-LOW", 0.4).otherwise(0.0)
    total = F.col("inst") * 0.6 / weight
    return c.select("o_orderkey", F.round(pairs.blend(total, F.col("inst"), F.col("calibrated"), 0.6, weight) + 1e-9, 5).alias("total"))


@query
def context_blend(spark, d):
    """Scores of the middle band that have evidence, moved toward the calibrated context by its confidence; others stay."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_totalprice") / 500_000).alias("score"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day"))
    band = (F.col("score") > 0.2) & (F.col("score") < 0.8) & (F.col("o_orderpriority") != "5-LOW")
    inside = pairs.quantile_transplant(o.filter(band), ["o_custkey"], "score", "day", ["o_orderkey"])
    confidence = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.5)
    moved = inside.select("o_orderkey", (F.col("score") + 0.25 * confidence * (F.col("calibrated") - F.col("score"))).alias("blended"))
    return o.join(moved, "o_orderkey", "left").select("o_orderkey", F.round(F.coalesce("blended", "score") + 1e-9, 5).alias("score"), F.col("blended").isNotNull().alias("moved"))


@query
def semantic_blend(spark, d):
    """Label and attribute agreement of blocked pairs, renormalised over what is known; nothing known keeps the visual score."""
    kind = F.when((F.col("a.kind") != "unknown") & (F.col("b.kind") != "unknown"), (F.col("a.kind") == F.col("b.kind")).cast("double"))
    word = F.when((F.col("a.word") != "unknown") & (F.col("b.word") != "unknown"), (F.col("a.word") == F.col("b.word")).cast("double"))
    visual = pairs.aspect_similarity(F.col("a.p_retailprice"), F.col("b.p_retailprice"))
    semantic = pairs.ceding_score([(0.4, kind), (0.6, word)])
    j = _part_pairs(spark, d).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), semantic.alias("semantic"), visual.alias("visual"))
    j = j.select("a", "b", F.coalesce(0.75 * F.col("visual") + 0.25 * F.col("semantic"), "visual").alias("score"))
    return j.select("a", "b", pairs.rounded(F.col("score")).alias("score"))


@query
def view_votes(spark, d):
    """Votes, mean and best value of every type a user has, the strict majority, and a score of the hypothesis."""
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("votes"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    n = F.sum("votes").over(Window.partitionBy("user_id"))
    share = F.col("votes") / n
    score = 0.65 * F.least(F.lit(1.0), F.col("mean") / 50) + 0.05 * F.least(F.lit(1.0), F.col("most") / 50) + 0.2 * share + 0.1 * F.least(F.lit(1.0), F.col("votes") / 20)
    return v.select("user_id", "event_type", "votes", F.round(F.col("mean") + 1e-9, 4).alias("mean"), "most", (share > 0.5).alias("majority"), F.round(score + 1e-9, 4).alias("score"))


@query
def hypothesis_lists(spark, d):
    """Each user's types as hypotheses, the most votes first."""
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    h = v.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("event_type").alias("t")))).alias("h"))
    return h.select("user_id", F.array_join(F.transform("h", lambda x: F.concat(x["t"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("hypotheses"))


@query
def ordered_rule(spark, d):
    """The first fact of a user that is not certain decides: unknown asks, false rules out, all true triggers."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.avg("value").alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))
    bought = F.when(F.col("n") < 5, None).otherwise(F.col("bought"))
    calm = F.when(F.col("errors") > 30, None).otherwise(F.col("errors") < 20)
    status, by, confidence = K.first_uncertain([("bought", bought, F.lit(0.9)), ("rich", F.col("mean") > 9.5, F.lit(0.8)), ("calm", calm, F.lit(0.7))])
    return e.select("user_id", status.alias("status"), by.alias("decided_by"), confidence.alias("confidence"))


@query
def rank_displacement(spark, d):
    """How far a customer's orders move between the order of price and that of date."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    a = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    b = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    r = o.select("o_custkey", F.abs(a - b).alias("move"))
    return r.groupBy("o_custkey").agg(F.max("move").cast("long").alias("most"), F.round(F.avg("move"), 6).alias("mean"), F.count_if(F.col("move") == 0).alias("n_same"))


@query
def tier_gates(spark, d):
    """Three tiers of agreement between two readings of the orders of a customer: all alike, all near, nearly all near."""
    near = F.abs(F.col("o_totalprice") - F.round(F.col("o_totalprice"), -3)) <= 480
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") == F.round("o_totalprice", 0)).alias("strict"), F.bool_and(near).alias("diagnostic"), F.avg(near.cast("double")).alias("share"))
    return g.select("o_custkey", "strict", "diagnostic", (F.round("share", 9) >= 0.9).alias("revised"))


@query
def hard_negatives(spark, d):
    """Each vector's best of its own label in another clip against its best of another label: margins by label."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 3).cast("int").alias("clip"), "label", F.lit(0).alias("all"), "embedding")
    own = pairs.blocked_topk(e, key="vec_id", side="clip", category="label", vector="embedding", k=1).groupBy("src").agg(F.max("score").alias("own"))
    other = pairs.blocked_topk(e, key="vec_id", side="label", category="all", vector="embedding", k=1).groupBy("src", "src_side").agg(F.max("score").alias("other"))
    m = own.join(other, "src").withColumn("margin", F.col("own") - F.col("other"))
    return m.groupBy(F.col("src_side").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("margin"), 6).alias("margin"), F.count_if(F.col("margin") < 0).alias("n_wrong"), F.max("other").alias("hardest"))


@query
def unit_means(spark, d):
    """The mean vector of each entity's views, weighted and scaled to length one."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("entity"), (F.col("vec_id") % 3 + 1).alias("w"), F.posexplode("embedding").alias("pos", "x"))
    m = e.groupBy("entity", "pos").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("entity")))
    return m.select("entity", "pos", (F.round(F.col("m") / norm + 1e-9, 5) + 0.0).alias("unit"))


@query
def projected_vectors(spark, d):
    """The vectors through a head of two layers with fixed weights, component by component."""
    import numpy as np

    from linkloom.functions.vectors import project

    n = len(table(spark, d, "embeddings").select("embedding").head()[0])
    first, second = np.sin(np.arange(n * 8).reshape(8, n) + 1).T, np.cos(np.arange(64).reshape(8, 8) + 1).T
    p = table(spark, d, "embeddings").select("vec_id", F.posexplode(project(F.col("embedding"), first, second)).alias("pos", "x"))
    return p.select("vec_id", "pos", (F.round(F.col("x") + 1e-9, 5) + 0.0).alias("x"))


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    b = _framed(spark, d).withColumn("c", F.struct("id", "part", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")))
    top = b.groupBy("l_suppkey", "day", "label").agg(F.min("c").alias("c"))
    seen = top.groupBy("l_suppkey", "label").agg(F.count(F.lit(1)).alias("n_seen"))
    a, o = (top.select("l_suppkey", "day", F.col("label").alias(n), F.col("c").alias(f"c_{n}")) for n in ("label", "other"))
    gap = F.hypot(F.col("c_label.x") - F.col("c_other.x"), F.col("c_label.y") - F.col("c_other.y"))
    near = a.join(o, ["l_suppkey", "day"]).filter("label != other").select("l_suppkey", "label", "other", gap.alias("gap"))
    keys = ["l_suppkey", "label", "other"]
    mid = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median("gap").alias("median"))
    mad = near.join(mid.select(*keys, "median"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("gap") - F.col("median"))).alias("mad"))
    place = Window.partitionBy("l_suppkey", "label")
    s = mid.join(mad, keys).join(seen, ["l_suppkey", "label"])
    rank = (F.row_number().over(place.orderBy("median", "other")) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(place) - 1)
    return s.select(*keys, "n", (F.col("n") / F.col("n_seen")).alias("together"), "median", "mad", rank.alias("rank"))


@query
def neighbour_signatures(spark, d):
    """How far each label's box lies from those of other labels: median, spread, share of frames together, rank."""
    s = _signatures(spark, d)
    return s.select("l_suppkey", "label", "other", "n", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("together", "median", "mad", "rank")])


@query
def signature_similarity(spark, d):
    """Agreement of a label's neighbourhood between each supplier and the next: null where nothing is shared."""
    s = Scratch(spark, "signatures").save(_signatures(spark, d))
    a, b = s, s.select((F.col("l_suppkey") - 1).alias("l_suppkey"), "label", "other", *[F.col(c).alias(f"{c}2") for c in ("together", "median", "rank")])
    j = a.join(b, ["l_suppkey", "label", "other"])
    near = F.exp(-F.abs(F.ln((F.col("median") + 1) / (F.col("median2") + 1))))
    agree = 0.55 * near + 0.25 * (1 - F.abs(F.col("together") - F.col("together2"))) + 0.2 * (1 - F.abs(F.col("rank") - F.col("rank2")))
    sizes = lambda df, name: df.groupBy("l_suppkey", "label").agg(F.count(F.lit(1)).alias(name))
    per = j.groupBy("l_suppkey", "label").agg(F.count(F.lit(1)).alias("shared"), F.avg(agree).alias("agreement"), F.sum("n").alias("support"))
    all_ = per.join(sizes(a, "na"), ["l_suppkey", "label"]).join(sizes(b, "nb"), ["l_suppkey", "label"])
    overlap = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    confidence = F.least(F.lit(1.0), F.col("shared") / 3) * F.least(F.lit(1.0), F.cbrt(F.col("support") / 1000))
    return all_.select("l_suppkey", "label", F.round(0.5 * overlap + 0.5 * F.col("agreement") + 1e-9, 5).alias("score"), F.round(confidence + 1e-9, 5).alias("confidence"))


@query
def configuration_sweep(spark, d):
    """Weights and thresholds of a grid judged in one pass over the scored pairs, and the winner among those within the guard."""
    grid = [(w / 4, t / 10) for w in range(5) for t in (5, 7, 9)]
    per = pairs.swept_pairs(_parts(spark, d), block=["p_brand", "p_size"], key="p_partkey", value="p_retailprice", same="word", settings=grid, digits=9, label="kind").drop("n_all")
    per = per.withColumn("precision", F.round(F.try_divide("n_hits", "n_pairs"), 6)).withColumn("recall", F.round(F.try_divide("n_hits", "n_true"), 6))
    safe = F.coalesce(F.col("precision") >= 0.05, F.lit(False))
    first = F.row_number().over(Window.orderBy(F.desc("safe"), F.desc("recall"), F.desc("precision"), "weight", "threshold"))  # fifteen rows
    return per.withColumn("safe", safe).withColumn("wins", (first == 1) & F.col("safe")).drop("n_true")


@query
def assignment_sweep(spark, d):
    """The assignment run again at every threshold of a grid, in one job: what must hold of each."""
    scratch = Scratch(spark, "sweep")
    p = scratch.save(pairs.symmetric_union(_recalled(spark, d)).select(F.concat_ws("-", F.least("a_side", "b_side"), F.greatest("a_side", "b_side")).alias("sides"), "a", "b", "score", (F.col("a_side") < F.col("b_side")).alias("up")))
    p = p.select("sides", F.when(F.col("up"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("up"), F.col("b")).otherwise(F.col("a")).alias("b"), "score")
    grid = p.withColumn("threshold", F.explode(F.array(*[F.lit(x / 10) for x in (1, 2, 3)]))).filter("score > threshold")
    got = scratch.save(folds.assign_pairs(grid, ["threshold", "sides"], 0.0))
    free = grid.join(got.select("threshold", "sides", "a"), ["threshold", "sides", "a"], "left_anti").join(got.select("threshold", "sides", "b"), ["threshold", "sides", "b"], "left_anti")
    twice = got.groupBy("threshold", "sides", "a").count().filter("count > 1").unionAll(got.groupBy("threshold", "sides", "b").count().filter("count > 1"))
    n = lambda df, name: df.groupBy("threshold").agg(F.count(F.lit(1)).alias(name))
    out = n(grid, "n_pairs").join(n(free, "left_free"), "threshold", "left").join(n(twice, "twice"), "threshold", "left")
    return out.fillna(0, ["left_free", "twice"])


@query
def context_sidecar(spark, d):
    """A row for every recalled pair with the evidence of its parts, null where the neighbourhood doesn't cover both."""
    p = pairs.symmetric_union(_recalled(spark, d)).select("a", "b")
    evidence = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    x, y = (evidence.select(F.col("id").alias(c), F.col("mean").alias(f"m{c}"), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    j = p.join(x, "a", "left").join(y, "b", "left")
    return j.select("a", "b", F.round(F.exp(-F.abs(F.ln(F.col("ma") / F.col("mb")))) + 1e-9, 5).alias("context"), F.when(F.col("na").isNotNull() & F.col("nb").isNotNull(), F.least(F.lit(1.0), (F.col("na") + F.col("nb")) / 100)).alias("confidence"))


@query
def precision_by_group(spark, d):
    """Long documents as hits by language, kind and both, with the interval and whether enough have been seen to stop."""
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), "doc_kind", (F.col("n_chars") > 400).alias("hit"))
    g = docs.groupingSets([["lang", "doc_kind"], ["lang"], ["doc_kind"], []], "lang", "doc_kind").agg(F.grouping_id("lang", "doc_kind").cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    low, high = K.wilson(F.col("hits"), F.col("n"))
    return g.select("level", "lang", "doc_kind", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), (F.col("n") >= K.required_trials(F.col("hits") / F.col("n"), 0.1)).alias("enough"))


@query
def sampled_events(spark, d):
    """Eight events of each user at least two days apart: half by value, half by even steps."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("day"), "value")
    return folds.quota_sample(e, ["user_id"], "day", "value", quota=8, gap=2.0).select("user_id", "event_id")


@query
def covering_orders(spark, d):
    """Three orders of each customer that cover the most suppliers."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sets = li.groupBy("o_custkey", "o_orderkey").agg(F.collect_set("l_suppkey").alias("suppliers"))
    return folds.greedy_cover(sets, ["o_custkey"], "o_orderkey", "suppliers", 3)


# --- data sets and logs -----------------------------------------------------------------------------------------------


@query
def link_buckets(spark, d):
    """Pairs judged to be one, by what the labelled samples say of their ends: same, cross, one_sided or none."""
    s = table(spark, d, "sf1_sample").select(id_form("tracklet_id").alias("t"), id_form("identity_id").alias("i")).filter("t is not null and i rlike '_anchor_'").groupBy("t").agg(F.min("i").alias("i"))
    p = table(spark, d, "merge_pairs").select(id_form("tracklet_a").alias("a"), id_form("tracklet_b").alias("b")).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    j = p.join(s.select(F.col("t").alias("a"), F.col("i").alias("ia")), "a", "left").join(s.select(F.col("t").alias("b"), F.col("i").alias("ib")), "b", "left")
    bucket = F.when(F.col("ia") == F.col("ib"), "same").when(F.col("ia") != F.col("ib"), "cross").when(F.coalesce("ia", "ib").isNotNull(), "one_sided").otherwise("none")
    return j.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_pairs"))


@query
def labelled_pairs(spark, d):
    """Stitched pairs once each with the largest cosine, and whether their modes contradict one another."""
    s = table(spark, d, "stitch_map").select(id_form("a").alias("x"), id_form("b").alias("y"), "cosine", "mode").filter("x != y")
    return s.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("cosine").alias("cosine"), (F.countDistinct("mode") > 1).alias("conflict"))


@query
def last_video_out(spark, d):
    """Samples of each identity's last video against the others, and tracklets that would leak."""
    s = table(spark, d, "sf1_sample").select("vec_id", id_form("identity_id").alias("i"), id_form("video_id").alias("v"), id_form("tracklet_id").alias("t")).filter("i rlike '_anchor_' and v is not null")
    last = s.groupBy("i").agg(F.max("v").alias("last"), F.countDistinct("v").alias("n_videos"))
    j = s.join(last, "i").withColumn("test", (F.col("v") == F.col("last")) & (F.col("n_videos") > 1))
    leak = j.filter("t is not null").groupBy("t").agg(F.bool_or("test").alias("x"), F.bool_or(~F.col("test")).alias("y")).filter("x and y").agg(F.count(F.lit(1)).alias("n_leaking"))
    return j.agg(F.count_if("test").alias("n_test"), F.count_if(~F.col("test")).alias("n_train"), F.countDistinct("i").alias("n_identities")).join(leak)


@query
def ingest_difference(spark, d):
    """Lines and quantity per supplier of two years beside one another."""
    li = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), "l_quantity")
    a, b = (li.filter(F.col("y") == y).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias(f"n_{k}"), F.sum("l_quantity").alias(f"q_{k}")) for k, y in (("old", 1997), ("new", 1998)))
    z = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "l_suppkey", "full").select("l_suppkey", z("n_old").alias("n_old"), z("n_new").alias("n_new"), (z("n_new") - z("n_old")).alias("change"), F.round(z("q_new") - z("q_old"), 2).alias("quantity_change"))


@query
def entity_metrics(spark, d):
    """Recorded entities by state: rows, retired ones, tracklets, mean confidence."""
    e = table(spark, d, "object_entity")
    return e.groupBy(F.coalesce("identity_state", F.lit("UNKNOWN")).alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.count("retired_at").alias("n_retired"), F.coalesce(F.sum(F.when(F.col("tracklet_ids").isNotNull(), F.size("tracklet_ids"))), F.lit(0)).alias("n_tracklets"), F.round(F.avg("confidence"), 6).alias("confidence")
    )


@query
def data_fingerprint(spark, d):
    """A mark of the lines' content that depends on neither order nor partitioning: row count and sum of row hashes."""
    row = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")]), 256)
    h = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("mark"))


@query
def rounded_hashes(spark, d):
    """A hash of the prices of each order, rounded and sorted, so that neither order nor noise changes it."""
    p = F.transform(F.array_sort(F.collect_list(F.round("l_extendedprice", 2))), lambda x: F.format_string("%.4f", x))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(p, ","), 256).alias("hash"))


@query
def membership_counts(spark, d):
    """Group members by the number of groups that name them."""
    g = table(spark, d, "hero_groups").select(id_form("group_id").alias("g"), F.explode("entity_ids").alias("e")).select("g", id_form("e").alias("e")).filter("g is not null and e is not null").distinct()
    return g.groupBy("e").agg(F.count(F.lit(1)).alias("n_groups")).groupBy("n_groups").agg(F.count(F.lit(1)).alias("n_members"))


@query
def log_summary(spark, d):
    """Messages of every run: how many, with files, without a type, and how many types."""
    m = table(spark, d, "message_log").select(id_form("correlation_id").alias("run"), "message_type", "artifact_refs")
    some = F.coalesce(F.size(F.filter("artifact_refs", lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))) > 0, F.lit(False))
    return m.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("artifact_refs").isNotNull() & some).alias("n_with_files"), F.count_if(F.coalesce(F.trim("message_type"), F.lit("")) == "").alias("n_untyped"), F.countDistinct("message_type").alias("n_types"))


@query
def envelope_checks(spark, d):
    """Violated rules of the messages' envelope and how often."""
    m = table(spark, d, "message_log")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = {
        "no_message_id": blank("message_id"), "no_run": blank("correlation_id"), "no_type": blank("message_type"), "own_cause": F.coalesce(id_form("message_id") == id_form("causation_id"), F.lit(False)),
        "hash_shape": ~blank("payload_hash") & ~F.coalesce(F.col("payload_hash").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "received_early": F.coalesce(F.col("received_at") < F.col("created_at"), F.lit(False)),
    }
    return m.select(F.explode(pairs.reasons(rules)).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query
def exactly_one(spark, d):
    """Runs by whether each of four message types stands in them exactly once, some are missing or some are repeated."""
    kinds = ["PresenceResult", "PlacementComplianceResult", "VerificationRequest", "VerificationVerdict"]
    m = table(spark, d, "message_log").select(id_form("correlation_id").alias("run"), id_form("message_id").alias("id"), "message_type").filter("run is not null and id is not null").filter(F.col("message_type").isin(*kinds)).distinct()
    per = m.groupBy("run").agg(*[F.count_if(F.col("message_type") == k).alias(k) for k in kinds])
    status = F.when(F.least(*kinds) == 0, "missing").when(F.greatest(*kinds) > 1, "repeated").otherwise("exact")
    return per.select("run", status.alias("status"))


@query
def chain_checks(spark, d):
    """Runs by what is wrong with the chain of causes: later, in another run, named by more than one message."""
    m = table(spark, d, "message_log").select(id_form("message_id").alias("id"), "ordinal", id_form("causation_id").alias("cause"), id_form("correlation_id").alias("run")).filter("id is not null")
    first = m.groupBy("id").agg(F.min(F.struct("ordinal", "cause", "run")).alias("m")).select("id", "m.*")
    up = first.select(F.col("id").alias("cause"), F.col("ordinal").alias("above"), F.col("run").alias("other"))
    j = first.filter("cause is not null").join(up, "cause", "left")
    kids = j.groupBy("cause").agg(F.count(F.lit(1)).alias("n_kids"))
    j = j.join(kids, "cause")
    return j.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("above").isNull()).alias("n_missing"), F.count_if(F.col("above") >= F.col("ordinal")).alias("n_later"),
        F.count_if(F.col("run") != F.col("other")).alias("n_other_run"), F.count_if(F.col("n_kids") > 1).alias("n_shared_cause"),
    )


@query
def contained_names(spark, d):
    """Part names resolved by whole-word containment in either direction, only where exactly one type is meant."""
    p = table(spark, d, "part").select("p_partkey", K.label_form(F.col("p_name")).alias("name"), "p_size", "p_type")
    aliases = p.filter("p_size = 1").select(F.col("name").alias("alias"), F.col("p_type").alias("target")).unionAll(p.filter("p_size = 2").select(F.element_at(F.split("name", " "), 1), "p_type"))
    return pairs.resolve_by_containment(p, "p_partkey", "name", aliases)


@query
def dead_phrases(spark, d):
    """Part names of which no part was sold in the largest returned lines."""
    names = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    sold = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity = 50 and l_discount = 0").select(F.col("l_partkey").alias("p_partkey")).distinct()
    live = names.join(sold, "p_partkey", "left_semi").select("p_name", "p_size").distinct()
    return names.select("p_name", "p_size").distinct().join(live, ["p_name", "p_size"], "left_anti")


@query
def case_scores(spark, d):
    """Expected against found items of each order: hits, misses, extras, and whether the case is exact."""
    li = table(spark, d, "lineitem")
    want = li.filter("l_returnflag != 'R'").select("l_orderkey", "l_partkey").distinct().withColumn("w", F.lit(True))
    got = li.filter("l_quantity > 5").select("l_orderkey", "l_partkey").distinct().withColumn("g", F.lit(True))
    j = want.join(got, ["l_orderkey", "l_partkey"], "full")
    hit, miss, extra = F.count_if(F.col("w") & F.col("g")), F.count_if(F.col("g").isNull()), F.count_if(F.col("w").isNull())
    return j.groupBy("l_orderkey").agg(hit.alias("hits"), miss.alias("misses"), extra.alias("extras"), ((miss == 0) & (extra == 0)).alias("exact"))


@query
def top_fragments(spark, d):
    """The two largest part groups of every brand and the three dearest parts of each."""
    p = table(spark, d, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice")
    size = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    top = size.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).filter("place <= 2")
    best = p.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))).filter("rank <= 3")
    return best.join(top, ["p_brand", "p_type"]).select("p_brand", "p_type", "place", "rank", "p_partkey")


@query
def seeded_sample(spark, d):
    """Two hundred orders of a price band, drawn by the hash of a seed and the key."""
    o = table(spark, d, "orders").filter("o_totalprice between 100000 and 300000").select("o_orderkey", F.sha2(F.concat(F.lit("7|"), F.col("o_orderkey").cast("string")), 256).alias("h"))
    return o.orderBy("h", "o_orderkey").limit(200).select("o_orderkey")


@query
def phrase_ranking(spark, d):
    """Event types ranked by recall of users less false hits and fragments."""
    e = table(spark, d, "events").filter("value > 15").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    total = table(spark, d, "events").filter("user_id % 2 = 0").agg(F.countDistinct("user_id").alias("total"))
    real = F.col("user_id") % 2 == 0
    per = e.groupBy("event_type").agg(F.count_if(real).alias("hits"), F.count_if(~real).alias("false_hits"), F.coalesce(F.sum(F.when(real, F.col("n") - 1)), F.lit(0)).alias("fragments"))
    score = F.col("hits") / F.col("total") - 0.002 * F.col("false_hits") - 0.0001 * F.col("fragments")
    return per.join(F.broadcast(total)).select("event_type", "hits", "false_hits", "fragments", F.round(score, 6).alias("score"))


@query
def pair_metrics(spark, d):
    """Prices of urgent and other orders as scores: means, a low quantile of the one and a high one of the other, by status."""
    from linkloom.operators import groups

    o = table(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "own").otherwise("other").alias("kind"), F.col("o_totalprice").alias("score"))
    o = o.withColumn("g", F.concat_ws("|", "o_orderstatus", "kind"))
    ranks = groups.nearest_ranks(o, "g", "score", {"p10": 0.1, "p95": 0.95})
    means = o.groupBy("g", "o_orderstatus", "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    j = means.join(ranks, "g").groupBy("o_orderstatus").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k, c in (("own", "n"), ("other", "n"), ("own", "mean"), ("other", "mean"), ("own", "p10"), ("other", "p95"))])
    return j.select("o_orderstatus", "own_n", "other_n", F.round(F.col("own_mean") - F.col("other_mean"), 3).alias("separation"), "own_p10", "other_p95")


@query
def identity_checks(spark, d):
    """What is wrong with labelled samples: tracklets of several identities, names that belong to another video, repeats."""
    s = table(spark, d, "sf1_sample").select(id_form("tracklet_id").alias("t"), id_form("video_id").alias("v"), id_form("identity_id").alias("i"))
    known = s.filter("t rlike '_t[0-9]+$' and i rlike '_anchor_'")
    per = known.groupBy("t").agg(F.countDistinct("i").alias("n_i"), F.count(F.lit(1)).alias("n"))
    video = F.regexp_replace("t", "_t[0-9]+$", "")
    wrong = known.agg(F.count_if(F.col("v").isNotNull() & (F.col("v") != video)).alias("other_video"), F.count_if(F.col("v").isNull()).alias("no_video"))
    return per.agg(F.count(F.lit(1)).alias("n_tracklets"), F.count_if(F.col("n_i") > 1).alias("several_identities"), F.count_if(F.col("n") > 1).alias("repeated")).join(wrong)


@query
def edge_reasons(spark, d):
    """Stitched pairs by all reasons to reject them."""
    video = lambda c: F.regexp_replace(id_form(c), "_t[0-9]+$", "")
    reasons = pairs.reasons({
        "NO_END": id_form("a").isNull() | id_form("b").isNull(), "SELF": F.coalesce(id_form("a") == id_form("b"), F.lit(False)), "LOW_COSINE": F.coalesce(F.col("cosine") < 0.8, F.lit(True)),
        "OTHER_VIDEO": F.coalesce(video("a") != video("b"), F.lit(False)), "NO_MODE": F.coalesce(F.trim("mode") == "", F.lit(True)),
    })
    return table(spark, d, "stitch_map").groupBy(F.array_join(reasons, ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query
def vector_rules(spark, d):
    """Broken rules of the stored vectors, by table."""
    from linkloom.sources.files import vector_violations

    out = None
    for name in ("sf1_sample", "track_embedding"):
        bad = vector_violations(table(spark, d, name), "vec_id", "vector", 96).select(F.lit(name).alias("source"), F.explode("rules").alias("rule")).groupBy("source", "rule").agg(F.count(F.lit(1)).alias("n"))
        out = bad if out is None else out.unionByName(bad)
    return out


@query
def region_rows(spark, d):
    """One row a user as a region: agreed type, mean of the sure values, the reasons that hold it back, and its status."""
    e = table(spark, d, "events")
    n = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    place = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    top = n.withColumn("second", F.lead("n").over(place)).withColumn("all", F.sum("n").over(Window.partitionBy("user_id"))).withColumn("mean", F.sum("total").over(Window.partitionBy("user_id")) / F.col("all")).withColumn("rn", F.row_number().over(place)).filter("rn = 1")
    why = pairs.reasons({"TIE": F.coalesce(F.col("second") == F.col("n"), F.lit(False)), "WEAK": F.col("n") < 0.25 * F.col("all"), "FEW": F.col("all") < 10})
    r = top.select("user_id", F.when(F.col("n") > F.coalesce("second", F.lit(0)), F.col("event_type")).alias("agreed"), F.col("all").alias("n"), F.round("mean", 4).alias("mean"), F.array_join(why, ",").alias("reasons"))
    return r.withColumn("status", F.when(F.col("reasons") == "", "CONFIRMED").when(F.col("agreed").isNull(), "CONFLICT").otherwise("NEEDS_REVIEW"))


@query
def unique_choices(spark, d):
    """Each user's types as a scored answer: the one alone at the top after scores are held within 0 to 100, or none."""
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value") / 5, 3).alias("score"))
    answer = v.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "score")))).alias("answer"))
    return answer.select("user_id", X.scored_choice(F.col("answer"))[1].alias("choice"))


@query
def quarantined_scores(spark, d):
    """Shares of a user's types; with too few events all but views are set to nothing."""
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = v.groupBy("user_id").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    held = F.transform_values("m", lambda k, x: F.when((F.col("all") >= 66) | (k == "view"), F.round(x / F.col("all"), 6)).otherwise(F.lit(0.0)))
    return m.select("user_id", F.explode(held).alias("event_type", "share"))


# --- labels -----------------------------------------------------------------------------------------------------------


@query
def label_slugs(spark, d):
    """Slugs of the recorded labels and how many entities have each."""
    e = table(spark, d, "object_entity").filter("label is not null")
    return e.groupBy(X.slug(F.col("label")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query
def label_forms(spark, d):
    """Unicode form and anchor form of the recorded labels."""
    e = table(spark, d, "object_entity").filter("label is not null").select("label").distinct()
    return e.select("label", X.unicode_form(F.col("label")).alias("plain"), X.anchor_form(F.col("label")).alias("anchor"))


@query
def stable_ordinals(spark, d):
    """Numbers of the entities within their label's slug, by entity id."""
    e = table(spark, d, "object_entity").select(id_form("entity_id").alias("entity"), X.slug(F.col("label")).alias("slug")).filter("entity is not null and slug is not null").groupBy("entity").agg(F.min("slug").alias("slug"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("entity"))
    return e.select("entity", F.concat("slug", F.lit("_"), F.lpad(n.cast("string"), 4, "0")).alias("name"))


KEYS = ["box", "tool roll", "tool", "toy crane", "crane", "tote", "carton", "crate", "收纳箱", "箱", "周转筐", "布袋"]


@query
def keyword_counts(spark, d):
    """How often the documents name each thing, the longest name first at every place."""
    t = table(spark, d, "documents").filter("text is not null").select(F.explode(X.keywords(F.lower("text"), KEYS)).alias("keyword"))
    return t.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query
def slot_forms(spark, d):
    """Recorded labels as slots: punctuation and blanks gone, measure words cut, aliases resolved."""
    e = table(spark, d, "object_entity").filter("label is not null").select("label").distinct()
    return e.select("label", X.slot_form(F.col("label"), ["盆", "机", "set"], {"fruitbar": "snack"}).alias("slot"))


@query
def display_titles(spark, d):
    """Part names made different by their brand where several parts of a type share them."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    n = F.count(F.lit(1)).over(Window.partitionBy("p_type", "p_name"))
    same = F.count(F.lit(1)).over(Window.partitionBy("p_type", "p_name", "p_brand"))
    title = F.when(n == 1, F.col("p_name")).when(same == 1, F.concat("p_name", F.lit(" ("), F.col("p_brand"), F.lit(")"))).otherwise(F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", title.alias("title"))


@query
def reconciled_labels(spark, d):
    """Names mapped by exact alias, by exact label or by their only compound, with a confidence; two targets are a conflict."""
    p = table(spark, d, "part").select("p_partkey", K.label_form(F.col("p_name")).alias("name"))
    terms = table(spark, d, "part").select(K.label_form(F.col("p_name")).alias("name"), "p_type", "p_size", F.element_at(F.split(K.label_form(F.col("p_name")), " "), -1).alias("last"))
    tiers = [
        (terms.filter("p_size = 1").select(F.col("name").alias("k"), F.col("p_type").alias("target")), F.col("name"), 1.0),
        (terms.filter("p_size = 2").select(F.col("name").alias("k"), F.col("p_type").alias("target")), F.col("name"), 0.95),
        (terms.filter("p_size = 3").select(F.col("last").alias("k"), F.col("p_type").alias("target")), F.element_at(F.split("name", " "), -1), 0.8),
    ]
    return pairs.reconcile(p, "p_partkey", tiers)
