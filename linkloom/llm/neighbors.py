"""Most similar vectors for every vector, by learned partitions.

1. Vectors are scaled to length one and kept as 16-bit floats; equal ones become one row with its smallest ids, so copies
   cost nothing and ties among them are exact.
2. On a bounded sample the k-nearest-neighbour graph is built and cut into balanced parts: capacity-bounded label
   propagation over the graph, started from balanced centroids.
3. A linear softmax classifier learns from each sample vector which parts its neighbours lie in.
4. Every vector goes to its ``probes`` most probable parts, as something to be found and as a query alike; inside a part
   all pairs are compared in blocks by matrix products. Two vectors meet if they share one of their parts.
5. The candidates of a vector's parts are merged and its best taken.

Parts hold about ``part_rows`` vectors each. Parts that turn out much larger get classifiers of their own, fitted side by
side on the cluster, each on a bounded sample of its part, level by level until every group that a task has to hold is
small. Below the first level a vector goes to two parts, so the groups it is in grow slowly with the depth.

At most ``sample_rows`` vectors of the first fit reach the driver, and the classifiers, as 16-bit floats: their size is
checked against MODEL_BYTES before they are broadcast. The same path is taken at every size that allows two parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from linkloom.session import Scratch

Model = tuple[np.ndarray, np.ndarray]

#: The classifiers of all levels together, at most; 600 x 600 parts of 96 dimensions take 70 MB.
MODEL_BYTES = 1 << 28
#: Parts a vector goes to below the first level.
DEEP_PROBES = 2


def balanced(scores: np.ndarray, capacity: int) -> np.ndarray:
    """A column for every row, at most ``capacity`` rows a column: rows go to their best column that has room, the
    highest scores first."""
    n, width = scores.shape
    scores, out, left, room = scores.copy(), np.full(n, -1), np.arange(n), np.full(width, capacity)
    while len(left):
        best = scores[left].argmax(1)
        order = np.lexsort((-scores[left, best], best))
        column = best[order]
        rank = np.arange(len(column)) - np.searchsorted(column, np.arange(width))[column]
        fits = rank < room[column]
        out[left[order[fits]]] = column[fits]
        room -= np.bincount(column[fits], minlength=width)
        scores[:, room <= 0] = -np.inf
        left = left[order[~fits]]
    return out


def sample_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest neighbours of every sample vector."""
    n = len(vectors)
    graph = np.empty((n, k), np.int32)
    for i in range(0, n, 1024):
        sims = vectors[i : i + 1024] @ vectors.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
        graph[i : i + 1024] = np.argpartition(-sims, k, axis=1)[:, :k]
    return graph


def partition_graph(vectors: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Balanced parts with few cut edges, and their centroids."""
    n, k = graph.shape
    capacity = int(np.ceil(n / parts * 1.1))
    centers = vectors[rng.choice(n, parts, replace=False)].copy()
    for _ in range(6):
        part = balanced(vectors @ centers.T, capacity)
        for p in range(parts):
            if (own := part == p).any():
                centers[p] = vectors[own].mean(0)
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
    near = 0.01 * (vectors @ centers.T)
    rows = np.repeat(np.arange(n), k)
    for _ in range(8):
        votes = near.copy()
        np.add.at(votes, (rows, part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, k)), 1)
        votes[np.arange(n), part] += 0.5
        part = balanced(votes, capacity)
    return part, centers


def fit_router(vectors: np.ndarray, parts: int, *, k: int = 10, epochs: int = 12, seed: int = 0) -> Model:
    """Weights and bias of a softmax classifier from a vector to the parts of its neighbours."""
    rng = np.random.default_rng(seed)
    n = len(vectors)
    k = min(k, n - 1)
    graph = sample_graph(vectors, k)
    part, centers = partition_graph(vectors, graph, parts, rng)
    goal = np.zeros((n, parts), np.float32)
    np.add.at(goal, (np.repeat(np.arange(n), k), part[graph].ravel()), 1)
    goal[np.arange(n), part] += k
    goal /= goal.sum(1, keepdims=True)
    theta = [centers.T.astype(np.float32) * 8, np.zeros(parts, np.float32)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 512):
            j = order[i : i + 512]
            z = vectors[j] @ theta[0] + theta[1]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - goal[j]) / len(j)
            step += 1
            for t, grad, a, b in zip(theta, (vectors[j].T @ g, g.sum(0)), first, second, strict=True):  # Adam
                a += 0.1 * (grad - a)
                b += 0.01 * (grad * grad - b)
                t -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return theta[0], theta[1]


def route(vectors: np.ndarray, models: dict[str, Model], probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and group names: every vector in its most probable groups, refined where a group has its own model."""
    if "" not in models:
        return np.arange(len(vectors)), np.full(len(vectors), "", dtype=object)
    rows, names = [], []

    def down(at: np.ndarray, name: str) -> None:
        w, b = models[name]
        z = vectors[at] @ w.astype(np.float32) + b.astype(np.float32)
        take = probes if not name else min(probes, DEEP_PROBES)
        top = np.argpartition(-z, take - 1, axis=1)[:, :take] if take < z.shape[1] else np.tile(np.arange(z.shape[1]), (len(at), 1))
        flat, who = top.ravel(), np.repeat(at, top.shape[1])
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        values, starts = np.unique(flat, return_index=True)
        for p, lo, hi in zip(values, starts, np.append(starts[1:], len(flat)), strict=True):
            child = f"{name}/{p}"
            if child in models:
                down(who[lo:hi], child)
            else:
                rows.append(who[lo:hi])
                names.append(np.full(hi - lo, child, dtype=object))

    if len(vectors):
        down(np.arange(len(vectors)), "")
    return (np.concatenate(rows), np.concatenate(names)) if rows else (np.arange(0), np.empty(0, object))


def top_in_group(vectors: np.ndarray, k: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The k best others of every row of one group and their cosines; -1 where there are fewer."""
    n = len(vectors)
    width = min(k, n - 1)
    best, sims = np.full((n, k), -1, np.int64), np.full((n, k), -2, np.float32)
    if width < 1:
        return best, sims
    for i in range(0, n, block):
        s = vectors[i : i + block] @ vectors.T
        m = len(s)
        s[np.arange(m), np.arange(i, i + m)] = -2
        top = np.argpartition(-s, width - 1, axis=1)[:, :width]
        best[i : i + m, :width] = top
        # The same sum whatever group two vectors meet in, so that a pair has one cosine.
        sims[i : i + m, :width] = np.einsum("ijk,ik->ij", vectors[top], vectors[i : i + m])
    return best, sims


def _matrix(codes: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.float16).reshape(-1, dims).astype(np.float32)


def unit_codes(table: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``id, code``: usable vectors scaled to length one, as 16-bit floats; others and null keys give no row."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)) & np.asarray(ids.is_valid())
            lists, ids = lists.filter(pa.array(fits)), ids.filter(pa.array(fits))
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
            big = np.abs(flat).max(1, initial=0.0)
            good = np.isfinite(flat).all(1) & (big > 0)
            flat = flat[good] / big[good, None]
            flat /= np.linalg.norm(flat, axis=1, keepdims=True)
            codes = flat.astype(np.float16) + np.float16(0)  # no negative zeros
            raw = pa.Array.from_buffers(pa.binary(2 * dims), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)).cast(pa.int64()), raw], ["id", "code"])

    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    return rows.mapInArrow(convert, "id long, code binary")


def nearest(vectors: DataFrame, key: str, vector: str, *, dims: int, k: int = 5, part_rows: int = 1000, probes: int = 3, sample_rows: int = 16_000, max_parts: int = 600) -> DataFrame:
    """The k most similar others of every usable vector: ``id, other, cosine``, ties by the smaller id.

    Usable is a vector of ``dims`` finite numbers, not all zero. Repeated rows count once. Fewer than k others give fewer
    rows; an empty table gives none.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "nearest")
    sc = spark.sparkContext
    coded = unit_codes(vectors, key, vector, dims).withColumn("h", F.xxhash64("code"))
    # Of equal vectors only the k + 1 smallest ids can be anybody's neighbour; the rank is cut before the shuffle, too.
    order = Window.partitionBy("h", "code").orderBy("id")
    watch = Observation()
    alike = coded.withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= k + 1).groupBy("h", "code").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    alike = alike.select("code", "ids").observe(watch, F.count(F.lit(1)).alias("n"), F.count_if(F.size("ids") > 1).alias("copied"), F.count_if(F.size("ids") > k).alias("full"))
    alike = scratch.save(alike)
    n, copied, full = (watch.get.get(x) or 0 for x in ("n", "copied", "full"))
    single = alike.select("code", F.col("ids")[0].alias("rep"))

    models: dict[str, Model] = {}
    if n > 2:
        parts = int(min(max_parts, max(2, n // part_rows)))
        share = max(1, n // min(sample_rows, max(20 * parts, 10_000)))
        got = single.filter(F.pmod(F.xxhash64("code", F.lit(3)), F.lit(share)) == 0).select("code").limit(2 * sample_rows).toPandas()["code"]
        got = _matrix([bytes(c) for c in got], dims)
        if len(got) >= 4:
            models[""] = _half(fit_router(got, min(parts, len(got) // 2)))
    large: dict[str, int] = {}
    while models:
        sizes = _routed(sc, single, models, probes, dims).groupBy("part").count().filter(F.col("count") > 25 * part_rows).collect()
        # A part that could not be fitted, as all its sample fell into one place, is not tried again.
        large = {r["part"]: r["count"] for r in sizes if r["part"] not in large}
        if not large:
            break
        models |= _fit_below(_routed(sc, single, models, probes, dims), large, dims, part_rows=part_rows, sample_rows=sample_rows, max_parts=max_parts)
        if (size := sum(w.nbytes + b.nbytes for w, b in models.values())) > MODEL_BYTES:
            raise ValueError(f"{size} bytes of classifiers are too many to broadcast; use larger parts")

    def compare(group: pa.Table) -> pa.Table:
        reps = group.column("rep").to_numpy()
        best, sims = top_in_group(_matrix(group.column("code").to_pylist(), dims), k)
        there = best >= 0
        pairs = pa.StructArray.from_arrays([pa.array(sims[there], pa.float32()), pa.array(reps[best[there]], pa.int64())], ["sim", "other"])
        ends = np.concatenate([[0], there.sum(1).cumsum()]).astype(np.int32)
        return pa.table({"rep": pa.array(reps, pa.int64()), "near": pa.ListArray.from_arrays(pa.array(ends), pairs)})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * sc.defaultParallelism)
    routed = _routed(sc, single, models, probes, dims).repartition(tasks, "part")
    near = routed.groupBy("part").applyInArrow(compare, "rep long, near array<struct<sim: float, other: long>>")
    # A vector has at most as many rows here as it has groups.
    merged = near.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ranked = F.slice(F.sort_array(F.transform("near", lambda x: F.struct((-x["sim"]).alias("d"), x["other"].alias("other")))), 1, k)
    best = merged.select("rep", ranked.alias("near"))
    if not copied:
        return best.select(F.col("rep").alias("id"), F.explode("near").alias("x")).select("id", F.col("x.other").alias("other"), (-F.col("x.d")).alias("cosine"))
    return _with_copies(coded, alike, scratch.save(best), k, full)


def _half(model: Model) -> Model:
    return model[0].astype(np.float16), model[1].astype(np.float16)


def _fit_below(routed: DataFrame, large: dict[str, int], dims: int, *, part_rows: int, sample_rows: int, max_parts: int) -> dict[str, Model]:
    """A classifier for each of the parts, fitted on a hash sample of it; all in one pass over the routed vectors."""
    spark = routed.sparkSession
    plan = []
    for name, size in large.items():
        parts = int(min(max_parts, max(2, size // part_rows)))
        plan.append((name, parts, max(1, size // min(sample_rows, max(20 * parts, 10_000)))))
    wanted = F.broadcast(spark.createDataFrame(plan, "part string, parts int, share long"))
    drawn = routed.join(wanted, "part").filter(F.pmod(F.xxhash64("code", F.lit(3)), F.col("share")) == 0)

    def fit(group: pa.Table) -> pa.Table:
        got = _matrix(group.column("code").to_pylist(), dims)
        parts = min(group.column("parts")[0].as_py(), len(got) // 2)
        if parts < 2:
            return pa.table({"part": pa.array([], pa.string()), "w": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        w, b = _half(fit_router(got, parts))
        return pa.table({"part": [group.column("part")[0].as_py()], "w": [w.tobytes()], "b": [b.tobytes()]})

    fitted = drawn.groupBy("part").applyInArrow(fit, "part string, w binary, b binary").collect()
    return {r["part"]: (np.frombuffer(bytes(r["w"]), np.float16).reshape(dims, -1), np.frombuffer(bytes(r["b"]), np.float16)) for r in fitted}


def _routed(sc, single: DataFrame, models: dict[str, Model], probes: int, dims: int) -> DataFrame:
    shared = sc.broadcast(models)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), dims)
            rows, names = route(x, shared.value, probes)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), taken.column(0), taken.column(1)], ["part", "code", "rep"])

    return single.mapInArrow(spread, "part string, code binary, rep long")


def _with_copies(coded: DataFrame, alike: DataFrame, best: DataFrame, k: int, full: int) -> DataFrame:
    """Neighbours of every id from those of the representatives: own copies first, then the copies of each neighbour."""
    several = alike.filter(F.size("ids") > 1).select(F.col("ids")[0].alias("rep"), "ids")
    near = best.select("rep", F.explode_outer("near").alias("x")).select("rep", F.col("x.d").alias("d"), F.col("x.other").alias("other"))
    copies = several.select(F.col("rep").alias("other"), F.col("ids").alias("other_ids"))
    wide = near.join(copies, "other", "left").filter("other is not null")
    wide = wide.select("rep", F.explode(F.transform(F.coalesce("other_ids", F.array("other")), lambda i: F.struct(F.col("d").alias("d"), i.alias("other")))).alias("x"))
    own = several.select("rep", F.explode("ids").alias("o")).select("rep", F.struct(F.lit(-2.0).cast("float").alias("d"), F.col("o").alias("other")).alias("x"))
    # k + 1 of them, as an id doesn't count itself; at most (k + 1) ** 2 were gathered.
    lists = wide.unionByName(own).groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k + 1).alias("x"))
    members = alike.select(F.col("ids")[0].alias("rep"), F.explode("ids").alias("id"))
    if full:
        # Ids beyond the smallest k + 1 of one vector: nobody's neighbours, but queries all the same.
        crowd = alike.filter(F.size("ids") > k).select(F.col("code"), F.xxhash64("code").alias("h"), F.col("ids").alias("first"))
        more = coded.join(crowd, ["h", "code"]).filter(~F.array_contains("first", F.col("id"))).select(F.col("first")[0].alias("rep"), "id").distinct()
        members = members.unionByName(more)
    out = members.join(lists, "rep").select("id", F.explode(F.slice(F.filter("x", lambda e: e["other"] != F.col("id")), 1, k)).alias("x"))
    return out.select("id", F.col("x.other").alias("other"), F.when(F.col("x.d") < -1.5, F.lit(1.0).cast("float")).otherwise(-F.col("x.d")).alias("cosine"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """Pairs of which one is among the nearest of the other, once each: ``a < b``."""
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
