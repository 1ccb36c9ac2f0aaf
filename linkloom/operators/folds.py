"""Order-dependent algorithms: pure functions over one independent partition, and their grouped wrappers.

Each fold runs inside an exact decomposition (connected component, frame, or video and label), so that no group grows
with the table; the wrappers take the grouping columns and leave the order to a documented sort.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import kernels
from linkloom.session import Scratch

# --- assignment -------------------------------------------------------------------------------------------------------


def assign_max(scores: np.ndarray, floor: float) -> list[int]:
    """One-to-one assignment of rows to columns with the largest sum, leaving a row out where that scores ``floor``.

    Shortest augmenting paths on the reduced costs; -inf is forbidden. Returns a column or -1 for every row.
    """
    n, m = scores.shape
    width = m + n
    cost = np.full((n, width), np.inf)
    cost[:, :m] = np.where(np.isfinite(scores), -scores, np.inf)
    cost[np.arange(n), m + np.arange(n)] = -floor  # a place of its own for every row that stays alone
    row_of = np.full(width, -1)
    u, v = np.zeros(n), np.zeros(width)
    for start in range(n):
        reach, prev, done = np.full(width, np.inf), np.full(width, -1), np.zeros(width, bool)
        row, base, last = start, 0.0, -1
        while True:
            step = cost[row] - u[row] - v + base
            better = ~done & (step < reach)
            reach[better], prev[better] = step[better], last
            last = int(np.where(done, np.inf, reach).argmin())
            base = reach[last]
            done[last] = True
            if row_of[last] < 0:
                break
            row = row_of[last]
        u[start] += base
        seen = np.flatnonzero(done)
        inner = seen[seen != last]
        u[row_of[inner]] += base - reach[inner]
        v[inner] -= base - reach[inner]
        while last >= 0:
            before = prev[last]
            row_of[last] = start if before < 0 else row_of[before]
            last = before
    out = [-1] * n
    for col in range(m):
        if row_of[col] >= 0:
            out[row_of[col]] = col
    return out


def assign_sparse(near: list[dict[int, float]], floor: float) -> list[int]:
    """The same for rows that score few columns each: near[i] has the scores of row i by column. Memory follows the number
    of scores; a column or -1 for every row."""
    n = len(near)
    width = 1 + max((c for x in near for c in x), default=-1)
    u, v, row_of = [0.0] * n, defaultdict(float), {}
    for start in range(n):
        reach: dict[int, float] = {}
        prev: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, base, last = start, 0.0, -1
        while True:
            for col, score in (*near[row].items(), (width + row, floor)):  # a place of its own for a row that stays alone
                step = base - score - u[row] - v[col]
                if col not in done and step < reach.get(col, np.inf):
                    reach[col], prev[col] = step, last
                    heapq.heappush(heap, (step, col))
            while heap[0][1] in done or heap[0][0] > reach[heap[0][1]]:
                heapq.heappop(heap)
            base, last = heapq.heappop(heap)
            done.add(last)
            if last not in row_of:
                break
            row = row_of[last]
        u[start] += base
        for col in done - {last}:
            u[row_of[col]] += base - reach[col]
            v[col] -= base - reach[col]
        while last >= 0:
            before = prev[last]
            row_of[last] = start if before < 0 else row_of[before]
            last = before
    out = [-1] * n
    for col, row in row_of.items():
        if col < width:
            out[row] = col
    return out


def assign_pairs(pairs: DataFrame, group: list[str], floor: float, *, most_first: bool = False) -> DataFrame:
    """One-to-one pairs of the largest total score per group: ``<group>, a, b, score``; pairs at or below the floor lose.

    Where the pairs have a true ``locked``, these stand and only what they leave is assigned; of several locked pairs of
    one end the best stands. With most_first the number of pairs comes before their sum. Pairs with a null end or score take no part; of repeated pairs the best score counts.
    """
    has_lock = "locked" in pairs.columns

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["locked", "score", "a", "b"], ascending=[False, False, True, True]).drop_duplicates(["a", "b"])
        used_a, used_b, keep = set(), set(), set()
        for a, b in pdf.loc[pdf["locked"], ["a", "b"]].itertuples(index=False):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                keep.add((a, b))
        rest = pdf[~pdf["a"].isin(used_a) & ~pdf["b"].isin(used_b) & (pdf["score"] > floor)]
        left, right = sorted(rest["a"].unique()), sorted(rest["b"].unique())
        at_l, at_r = {x: i for i, x in enumerate(left)}, {x: i for i, x in enumerate(right)}
        near: list[dict[int, float]] = [{} for _ in left]
        for a, b, s in zip(rest["a"], rest["b"], rest["score"], strict=True):
            near[at_l[a]][at_r[b]] = float(s)
        alone = floor if not most_first else -1.0 - 2 * sum(abs(s) for x in near for s in x.values())
        keep |= {(left[i], right[j]) for i, j in enumerate(assign_sparse(near, alone)) if j >= 0}
        return pdf.loc[[x in keep for x in zip(pdf["a"], pdf["b"], strict=True)], [*group, "a", "b", "score"]]

    kept = pairs.select(*group, "a", "b", "score", F.coalesce(F.col("locked"), F.lit(False)).alias("locked") if has_lock else F.lit(False).alias("locked")).filter("a is not null and b is not null and score is not null")
    return kept.groupBy(*group).applyInPandas(solve, kept.drop("locked").schema)


def lock_baseline(pairs: DataFrame, baseline: DataFrame, *, match: float, margin: float) -> DataFrame:
    """The pairs with ``locked``: those that the baseline assigned with at least this score and margin.

    pairs: ``a, b, ...``; baseline: ``a, b, score, margin`` of the assignment before a rerank."""
    sure = baseline.filter((F.col("score") >= match) & (F.col("margin") >= margin)).select("a", "b", F.lit(True).alias("locked")).distinct()
    return pairs.join(sure, ["a", "b"], "left").withColumn("locked", F.coalesce("locked", F.lit(False)))


def match_most(edges: list[tuple], order: Iterable[int] | None = None) -> dict:
    """Bipartite matching with the most edges by augmenting paths, edges tried in the given order: left -> right."""
    near: dict = defaultdict(list)
    for k in order if order is not None else range(len(edges)):
        near[edges[k][0]].append(edges[k][1])
    taken: dict = {}
    held: dict = {}
    for start in near:
        # Iterative search: a chain of alternatives may be as long as the graph.
        parent: dict = {}
        stack, seen, end = [start], set(), None
        while stack and end is None:
            x = stack.pop()
            for y in near[x]:
                if y in seen:
                    continue
                seen.add(y)
                parent[y] = x
                if y not in taken:
                    end = y
                    break
                stack.append(taken[y])
        while end is not None:
            x = parent[end]
            before = held.get(x)
            taken[end], held[x] = x, end
            end = before if x != start else None
    return held


def match_frames(truth: DataFrame, found: DataFrame, frame: list[str], label: str, threshold: float, *, by_total: bool = False) -> DataFrame:
    """Matchings of the most boxes, or with by_total of the largest sum of overlaps, per frame and label: ``<frame>,
    <label>, truth_id, found_id, iou``, both sides kept.

    Both: ``<frame>, <label>, id, x1..y2``, ids not null and unique in a frame and label, which aren't null either. Boxes
    overlapping by the threshold or more may match, tried from the largest overlap on, then by ids; a box without a match
    has a null partner. Overlaps are joined by frame; only frames in which some box has a choice are folded in Python.
    """
    keys = [*frame, label]
    side = lambda df, name: df.select(*keys, F.col("id").alias(f"{name}_id"), F.struct(*BOX).alias(f"{name}_box"))
    t, f = side(truth, "truth"), side(found, "found")
    edges = t.join(f, keys).select(*keys, "truth_id", "found_id", kernels.iou("truth_box", "found_box").alias("iou")).filter(F.col("iou") >= threshold)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_bucket").sort_values([*keys, "iou", "truth_id", "found_id"], ascending=[True] * len(keys) + [False, True, True]).reset_index(drop=True)
        a, b, overlap = pdf["truth_id"].tolist(), pdf["found_id"].tolist(), pdf["iou"].tolist()
        keep: list[int] = []
        for rows in pdf.groupby(keys, sort=False).indices.values():
            at = {(a[k], b[k]): k for k in rows}
            if len(rows) == 1:
                keep.append(int(rows[0]))
            elif by_total:
                left, right = sorted({x for x, _ in at}), sorted({y for _, y in at})
                place = {y: j for j, y in enumerate(right)}
                scores: list[dict[int, float]] = [{} for _ in left]
                for i, x in enumerate(left):
                    scores[i] = {place[y]: overlap[k] for (z, y), k in at.items() if z == x}
                keep += [at[left[i], right[j]] for i, j in enumerate(assign_sparse(scores, 0.0)) if j >= 0]
            else:
                keep += [at[x] for x in match_most(list(at)).items()]
        return pdf.iloc[sorted(keep)]

    matched = Scratch(truth.sparkSession, "matched").save(in_buckets(edges, keys).groupBy("_bucket").applyInPandas(run, edges.schema))
    alone = lambda df, name, other: df.join(matched, [*keys, f"{name}_id"], "left_anti").select(*keys, f"{name}_id", F.lit(None).cast(df.schema[f"{name}_id"].dataType).alias(other), F.lit(None).cast("double").alias("iou"))
    return matched.unionByName(alone(t, "truth", "found_id")).unionByName(alone(f, "found", "truth_id"))


def spaced_best(rows: DataFrame, group: list[str], order: str, score: str, *, share: float, gap: float, most: int) -> DataFrame:
    """Of every group the lowest-scored share, then greedily from the lowest score on, ties by order, those at least gap
    away from all kept ones, at most ``most``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for _, part in pdf.drop(columns="_bucket").groupby(group, dropna=False):
            part = part.sort_values([score, order]).head(int(np.ceil(len(part) * share)))
            at: list[float] = []
            for row, x in zip(part.index, part[order], strict=True):
                if len(at) < most and all(abs(x - y) >= gap for y in at):
                    at.append(x)
                    keep.append(row)
        return pdf.loc[sorted(keep)].drop(columns="_bucket")

    return in_buckets(rows, group).groupBy("_bucket").applyInPandas(run, rows.schema)


def quota_sample(rows: DataFrame, group: list[str], order: str, score: str, *, quota: int, gap: float) -> DataFrame:
    """Of every group at most ``quota`` rows at least gap apart: first half of them by the best score, the others by even
    steps through what is left in order, then whatever still fits, by order. Ties of the score go by order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep: list = []
        for _, part in pdf.drop(columns="_bucket").groupby(group, dropna=False):
            part = part.sort_values(order)
            place = dict(zip(part.index, part[order], strict=True))
            taken: list = []

            def fill(rows: Iterable, upto: int, place: dict = place, taken: list = taken) -> None:
                for row in rows:
                    if len(taken) >= upto:
                        return
                    if row not in taken and all(abs(place[row] - place[x]) >= gap for x in taken):
                        taken.append(row)

            fill(part.sort_values([score, order], ascending=[False, True]).index, (quota + 1) // 2)
            rest = [x for x in part.index if x not in taken]
            step = max(1, len(rest) // max(1, quota - len(taken)))
            fill(rest[::step], quota)
            fill(rest, quota)
            keep += taken
        return pdf.loc[sorted(keep)].drop(columns="_bucket")

    return in_buckets(rows, group).groupBy("_bucket").applyInPandas(run, rows.schema)


def greedy_cover(rows: DataFrame, group: list[str], key: str, members: str, most: int) -> DataFrame:
    """``<group>, key, place, n_new``: up to ``most`` rows of a group that cover the most members, each the one that adds
    the most, ties by the smaller key; rows that add none are left out. A group's sets are small: one frame, one card."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, part in pdf.groupby(group, dropna=False):
            left = sorted((k, set(m) if m is not None else set()) for k, m in zip(part[key], part[members], strict=True))
            seen: set = set()
            for place in range(1, most + 1):
                new, k = max(((len(m - seen), -n) for n, (_, m) in enumerate(left)), default=(0, 0))
                if not new:
                    break
                at = left.pop(-k)
                seen |= at[1]
                out.append((*name, at[0], place, new))
        return pd.DataFrame(out, columns=[*group, key, "place", "n_new"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*group, key])
    return in_buckets(rows.select(*group, key, members), group).groupBy("_bucket").applyInPandas(run, f"{kinds}, place int, n_new int")


def cluster_boxes(boxes: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Boxes with the ``cluster`` they join, in order of id: the one with the member they overlap most, by the threshold
    at least, else a new one; clusters are numbered within the group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_bucket").sort_values([*group, "id"]).reset_index(drop=True)
        cluster = np.zeros(len(pdf), np.int64)
        for rows in pdf.groupby(group, dropna=False).indices.values():
            over = iou_matrix(*[pdf.loc[rows, BOX].to_numpy(float)] * 2)
            fresh = 0
            for k in range(len(rows)):
                best = int(over[k, :k].argmax()) if k else -1
                if k and over[k, best] >= threshold:
                    cluster[rows[k]] = cluster[rows[best]]
                else:
                    cluster[rows[k]], fresh = fresh, fresh + 1
        return pdf.assign(cluster=cluster)

    from pyspark.sql import types as T

    return in_buckets(boxes, group).groupBy("_bucket").applyInPandas(run, T.StructType([*boxes.schema.fields, T.StructField("cluster", T.LongType())]))


def pack_first_fit(sizes: list[tuple[str, int]], capacity: int, apart: set[frozenset] = frozenset()) -> list[list[str]]:
    """Names in packs: each goes to the first pack with room that holds nothing it must stay apart from."""
    packs: list[tuple[list[str], int]] = []
    for name, size in sizes:
        for k, (held, used) in enumerate(packs):
            if used + size <= capacity and not any(frozenset((name, x)) in apart for x in held):
                packs[k] = ([*held, name], used + size)
                break
        else:
            packs.append(([name], size))
    return [held for held, _ in packs]


# --- constrained union ------------------------------------------------------------------------------------------------


def constrained_union(edges: list[tuple], side: dict, cannot: set[tuple] = frozenset(), must: list[tuple] = ()) -> tuple[dict, list[bool]]:
    """Unite the ends of (a, b) in the given order if no side occurs twice and no forbidden pair meets.

    A node's side is one value or a set of them. Pairs in ``must`` are united first; an error if that is not allowed.
    Returns the smallest member of every node's cluster and, for each edge, whether it holds inside one cluster.
    """
    head = {x: x for x in side}
    members = {x: [x] for x in side}
    sides = {x: set(side[x]) if isinstance(side[x], set | frozenset) else {side[x]} for x in side}
    foes: dict = defaultdict(set)
    for a, b in cannot:
        foes[a].add(b)
        foes[b].add(a)
    held = []
    for n, (a, b) in enumerate([*must, *edges]):
        p, q = head[a], head[b]
        if p == q:
            held.append(True)
            continue
        small, large = (p, q) if len(members[p]) <= len(members[q]) else (q, p)
        clash = sides[p] & sides[q] or any(y in foes[x] for x in members[small] if foes[x] for y in members[large])
        held.append(not clash)
        if clash and n < len(must):
            raise ValueError(f"{a} and {b} must be one, but what is united already forbids it")
        if clash:
            continue
        members[large] += members.pop(small)
        sides[large] |= sides.pop(small)
        for x in members[large]:
            head[x] = large
    return {x: min(members[h]) for x, h in head.items()}, held[len(must) :]


# --- boxes ------------------------------------------------------------------------------------------------------------


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes x1, y1, x2, y2; 0 where the union is empty."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.clip(w, 0, None) * np.clip(h, 0, None)
    area = lambda x: np.clip(x[:, 2] - x[:, 0], 0, None) * np.clip(x[:, 3] - x[:, 1], 0, None)
    union = area(a)[:, None] + area(b)[None, :] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


BOX = ["x1", "y1", "x2", "y2"]


def suppress(coords: np.ndarray, threshold: float) -> list[int]:
    """Greedy suppression in the given order: a box stays if it overlaps no kept one by the threshold or more."""
    over = iou_matrix(coords, coords) >= threshold
    kept: list[int] = []
    for k in range(len(coords)):
        if not over[k, kept].any():
            kept.append(k)
    return kept


def in_buckets(df: DataFrame, group: list[str]) -> DataFrame:
    """The rows with a ``_bucket`` that holds whole groups: one Python call serves many small groups, and the number of
    buckets follows the number of shuffle partitions."""
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return apart(df.withColumn("_bucket", F.pmod(F.xxhash64(*group), F.lit(n))), ["_bucket"])


def apart(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows by key over a set number of tasks: a fold costs more than its bytes tell, so they shouldn't be merged."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def suppress_boxes(boxes: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Kept boxes of every group, by score, then id, then coordinates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_bucket").sort_values([*group, "score", "id", *BOX], ascending=[*[True] * len(group), False, *[True] * 5]).reset_index(drop=True)
        coords = pdf[BOX].to_numpy(float)
        kept = [int(rows[0]) + k for rows in pdf.groupby(group, sort=False, dropna=False).indices.values() for k in suppress(coords[np.sort(rows)], threshold)]
        return pdf.iloc[sorted(kept)]

    return in_buckets(boxes, group).groupBy("_bucket").applyInPandas(run, boxes.schema)


class Tracker:
    """Greedy tracking of one label in one video: detections join the open track whose last box overlaps most."""

    def __init__(self, threshold: float, max_missed: int, state: dict | None = None):
        self.threshold, self.max_missed = threshold, max_missed
        self.tracks = {int(k): v for k, v in (state or {}).get("tracks", {}).items()}  # id -> [box, missed]
        self.next = (state or {}).get("next", 0)

    def step(self, boxes: list[list[float]]) -> list[int]:
        """Track ids of the boxes of the next frame."""
        ids = sorted(self.tracks)
        out = [-1] * len(boxes)
        if ids and boxes:
            over = iou_matrix(np.array([self.tracks[t][0] for t in ids], float), np.array(boxes, float))
            pairs = sorted(((-over[i, j], i, j) for i, j in zip(*np.nonzero(over >= self.threshold), strict=True)))
            used: set[int] = set()
            for _, i, j in pairs:
                if i not in used and out[j] < 0:
                    used.add(i)
                    out[j] = ids[i]
        for t in ids:
            self.tracks[t][1] += 1
        for j, box in enumerate(boxes):
            if out[j] < 0:
                out[j], self.next = self.next, self.next + 1
            self.tracks[out[j]] = [list(map(float, box)), 0]
        self.tracks = {t: x for t, x in self.tracks.items() if x[1] <= self.max_missed}
        return out

    def state(self) -> dict:
        return {"tracks": self.tracks, "next": self.next}


def track_boxes(boxes: DataFrame, group: list[str], *, threshold: float = 0.3, max_missed: int = 2, min_length: int = 2) -> DataFrame:
    """Boxes ``<group>, frame, id, x1..y2`` with a ``track`` number per group; tracks shorter than min_length are left out.

    Every frame number of the group counts for the missed frames, seen or not.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "id"])
        tracker, tracks, last = Tracker(threshold, max_missed), [], None
        frames, coords = pdf["frame"].to_numpy(), pdf[BOX].to_numpy(float).tolist()
        starts = np.flatnonzero(np.append(True, frames[1:] != frames[:-1])).tolist()
        for lo, hi in zip(starts, [*starts[1:], len(frames)], strict=True):
            for _ in range(min(int(frames[lo] - last - 1), max_missed + 1) if last is not None else 0):
                tracker.step([])
            tracks += tracker.step(coords[lo:hi])
            last = frames[lo]
        pdf = pdf.assign(track=np.array(tracks, np.int64))
        return pdf[pdf.groupby("track")["track"].transform("size") >= min_length]

    from pyspark.sql import types as T

    schema = T.StructType([*boxes.schema.fields, T.StructField("track", T.LongType())])
    return apart(boxes, group).groupBy(*group).applyInPandas(run, schema)
