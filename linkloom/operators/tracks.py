"""Tracks: what their observations say, how fragments of one video are stitched, and what an entity made of them is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators import components, folds


def track_features(observations: DataFrame, track: list[str], *, time: str, quality: str, size: str) -> DataFrame:
    """``<track>, n, first, last, quality, size, times``: best quality, median size, sorted distinct times of every track.

    A track is bounded by its video; the times of one are one array.
    """
    return observations.groupBy(*track).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), F.max(quality).alias("quality"), F.median(size).alias("size"), F.array_sort(F.collect_set(time)).alias("times")
    )


def stitch_candidates(tracks: DataFrame, *, video: str, label: str, key: str, max_gap: float) -> DataFrame:
    """Pairs ``a < b`` of tracks of one video and label that share no time and lie at most max_gap apart: ``<video>, <label>,
    a, b, gap``. Null labels match nothing. The gap is how long after the end of one the other begins, 0 if they overlap."""
    t = tracks.select(video, label, F.col(key).alias("id"), "first", "last", "times")
    a, b = t.alias("a"), t.alias("b")
    j = a.join(b, (F.col(f"a.{video}") == F.col(f"b.{video}")) & (F.col(f"a.{label}") == F.col(f"b.{label}")) & (F.col("a.id") < F.col("b.id")))
    gap = F.greatest(F.lit(0), F.col("b.first") - F.col("a.last"), F.col("a.first") - F.col("b.last"))
    together = F.arrays_overlap("a.times", "b.times")
    return j.filter(~together & (gap <= max_gap)).select(F.col(f"a.{video}").alias(video), F.col(f"a.{label}").alias(label), F.col("a.id").alias("a"), F.col("b.id").alias("b"), gap.alias("gap"))


def stitch(candidates: DataFrame, tracks: DataFrame, *, key: str, forbidden: DataFrame | None = None) -> DataFrame:
    """The head of every track: ``key, head``. Candidates ``a, b, score`` are united from the best score on, ties by a and
    b, unless two members of the clusters share a time or are a forbidden pair ``a, b``; a head is the smallest member.

    Components of the candidates can't influence one another, so each is a fold of its own.
    """
    comp = components.connected_components(candidates, "a", "b")
    edges = candidates.select("a", "b", "score").join(comp.select(F.col("node").alias("a"), "component"), "a")
    edges = edges.select("component", "a", "b", "score", F.lit(None).cast("array<long>").alias("times"))
    members = tracks.select(F.col(key).alias("node"), "times").join(comp, "node")
    rows = edges.unionByName(members.select("component", F.col("node").alias("a"), F.lit(None).cast(edges.schema["b"].dataType).alias("b"), F.lit(None).cast("double").alias("score"), F.transform("times", lambda x: x.cast("long")).alias("times")))
    if forbidden is not None:
        foes = forbidden.select("a", "b").join(comp.select(F.col("node").alias("a"), "component"), "a")
        rows = rows.unionByName(foes.select("component", "a", "b", F.lit(float("-inf")).alias("score"), F.lit(None).cast("array<long>").alias("times")))

    def fold(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["score", "a", "b"], ascending=[False, True, True]).reset_index(drop=True)
        a, b, score, times = (pdf[c].tolist() for c in ("a", "b", "score", "times"))
        is_edge, barred = pdf["b"].notna().to_numpy(), np.isneginf(pdf["score"].to_numpy(float))
        out: dict[int, int] = {}
        for at in pdf.groupby("component").indices.values():
            side = {int(a[k]): frozenset(times[k]) for k in at if not is_edge[k]}
            foes = {(int(a[k]), int(b[k])) for k in at if is_edge[k] and barred[k]}
            links = [(int(a[k]), int(b[k])) for k in at if is_edge[k] and not barred[k]]
            out.update(folds.constrained_union(links, side, foes)[0])
        return pd.DataFrame({key: list(out), "head": list(out.values())})

    heads = folds.in_buckets(rows, ["component"]).groupBy("_bucket").applyInPandas(fold, f"{key} long, head long")
    return tracks.select(F.col(key)).join(heads, key, "left").select(key, F.coalesce("head", key).alias("head"))


def merged_features(tracks: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """``head, n_tracks, n, quality, size, hero``: means weighted by observations, best quality, and the member that names
    the cluster: the one of the best quality, then the smallest key."""
    j = tracks.join(heads, key)
    return j.groupBy("head").agg(
        F.count(F.lit(1)).alias("n_tracks"), F.sum("n").alias("n"), F.max("quality").alias("quality"),
        (F.sum(F.col("size") * F.greatest(F.lit(1), "n")) / F.sum(F.greatest(F.lit(1), "n"))).alias("size"),
        F.min(F.struct((-F.col("quality")).alias("q"), F.col(key).alias("k")))["k"].alias("hero"),
    )


def low_evidence(tracks: DataFrame, key: str, protected: DataFrame, rule: Column) -> DataFrame:
    """The tracks with ``low_evidence``: those under the rule keep their rights to match and lose those to ask, unless
    they are among the protected keys."""
    p = protected.select(F.col(key), F.lit(True).alias("_p")).distinct()
    return tracks.join(p, key, "left").withColumn("low_evidence", F.coalesce(rule, F.lit(False)) & F.col("_p").isNull()).drop("_p")


def entity_states(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``entity, n_members, state, confidence``: several members are MATCHED with the mean score of the links inside them,
    1 without any; a single one is SUSPECTED_DUPLICATE with its best link, or NEW_ENTITY with 1 less it.

    members: ``key, entity``; links: ``a, b, score, ambiguous``.
    """
    m = members.select(F.col(key).alias("id"), "entity")
    ends = links.select(F.explode(F.array("a", "b")).alias("id"), "score", "ambiguous").groupBy("id").agg(F.max("score").alias("best"), F.bool_or("ambiguous").alias("open"))
    inside = links.join(m.select(F.col("id").alias("a"), F.col("entity").alias("ea")), "a").join(m.select(F.col("id").alias("b"), F.col("entity").alias("eb")), "b")
    mean = inside.filter("ea = eb and not ambiguous").groupBy(F.col("ea").alias("entity")).agg(F.avg("score").alias("mean"))
    per = m.join(ends, "id", "left").groupBy("entity").agg(F.count(F.lit(1)).alias("n_members"), F.max("best").alias("best"), F.bool_or("open").alias("open")).join(mean, "entity", "left")
    several, best = F.col("n_members") > 1, F.coalesce("best", F.lit(0.0))
    state = F.when(several, "MATCHED").when(F.col("open"), "SUSPECTED_DUPLICATE").otherwise("NEW_ENTITY")
    confidence = F.when(several, F.coalesce("mean", F.lit(1.0))).when(F.col("open"), best).otherwise(1 - best)
    return per.select("entity", "n_members", state.alias("state"), confidence.alias("confidence"))


def best_views(views: DataFrame, track: str, order: list[Column], k: int) -> DataFrame:
    """The first k views of every track; the rank is cut before the shuffle."""
    return views.withColumn("_rn", F.row_number().over(Window.partitionBy(track).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def close_cycles(members: DataFrame, links: DataFrame, *, new: float, match: float) -> DataFrame:
    """Single members that complete a pair from two other sides: ``entity, single, bottleneck``, one round, no cascade.

    members: ``id, side, entity``; links: ``a, b, score, assigned, top``, one row a pair. Both links to the pair must score above
    ``new``; both are assigned, or one is and the other reaches ``match`` and is the best of both its ends (``top``).
    Accepted is what is the best on both sides by the weaker link, ties by the smaller id.
    """
    size = members.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.collect_set("side").alias("sides"))
    seeds = size.filter((F.col("n") == 2) & (F.size("sides") == 2)).select("entity", "sides")
    pair = members.join(seeds, "entity").select(F.col("id").alias("m"), "entity", "sides")
    alone = members.join(size.filter("n = 1").select("entity"), "entity").select(F.col("id").alias("single"), F.col("side").alias("single_side"))
    both = links.select(F.col("a").alias("single"), F.col("b").alias("m"), "score", "assigned", "top").unionAll(links.select("b", "a", "score", "assigned", "top"))
    spokes = both.join(pair, "m").join(alone, "single").filter(~F.array_contains("sides", F.col("single_side")) & (F.col("score") > new))
    sure = F.col("assigned") | ((F.col("score") >= match) & F.col("top"))
    per = spokes.groupBy("entity", "single").agg(F.count(F.lit(1)).alias("n"), F.count_if("assigned").alias("assigned"), F.count_if(sure).alias("sure"), F.min("score").alias("bottleneck"))
    fit = per.filter("n = 2 and sure = 2 and assigned >= 1")
    one = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("bottleneck"), "single"))
    other = F.row_number().over(Window.partitionBy("single").orderBy(F.desc("bottleneck"), "entity"))
    return fit.withColumn("i", one).withColumn("j", other).filter("i = 1 and j = 1").select("entity", "single", "bottleneck")
