import numpy as np

from linkloom.llm import neighbors


def frame(spark, ids, vecs):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in zip(ids, vecs, strict=True)], "vec_id long, vector array<float>, rep int")


def exact(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {i: [ids[j] for j in np.lexsort((ids, -row.round(6)))[:k]] for i, row in zip(ids, s, strict=True)}


def result(df, **kw):
    out = {}
    for r in neighbors.nearest(df, "vec_id", "vector", **kw).collect():
        out.setdefault(r["id"], []).append((-r["cosine"], r["other"]))
    return {i: [o for _, o in sorted(x)] for i, x in out.items()}


def test_everything_compared_with_copies_and_unusable(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype(np.float16).astype(float)
    x[50:] = x[0]  # a group of eleven copies
    x[40:43] = x[1]
    ids = list(range(100, 160))
    scaled = x * np.where(np.arange(60) % 3 == 0, 4.0, 1.0)[:, None]
    bad = [None, [1.0] * 7, [1.0] * 9, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, []]
    df = frame(spark, ids + list(range(1, 9)) + [None] + [100], [*scaled, *bad, x[3], x[0]])
    got = result(df, dims=8, k=5)
    want = exact(np.array(ids), x, 5)
    assert set(got) == set(ids)
    # Among equal cosines the smaller id comes first; copies are exact, other ties don't occur.
    assert got == {i: [int(o) for o in w] for i, w in want.items()}


def test_learned_partitions_reach_the_recall(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(300, 24))
    x = (centers[rng.integers(0, 300, 5000)] + 0.35 * rng.normal(size=(5000, 24))).astype(np.float32)
    ids = np.arange(5000)
    near = neighbors.nearest(frame(spark, ids.tolist(), x), "vec_id", "vector", dims=24, k=5, part_rows=250)
    got = {(r["a"], r["b"]) for r in neighbors.neighbour_pairs(near).collect()}
    want = {(min(i, int(o)), max(i, int(o))) for i, w in exact(ids, x.astype(float), 5).items() for o in w}
    assert len(got & want) / len(want) > 0.9


def test_oversized_part_is_split_again():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    models = {"": neighbors.fit_router(x, 4), "/1": neighbors.fit_router(x[:100], 3)}
    rows, names = neighbors.route(x, models, 2)
    assert set(np.unique(rows)) == set(range(400)) and "/1" not in set(names) and any(n.startswith("/1/") for n in names)
    part = neighbors.balanced(rng.normal(size=(100, 7)), 15)
    assert np.bincount(part, minlength=7).max() <= 15


def test_oversized_parts_are_fitted_in_one_pass_and_keep_the_recall(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(80, 16))
    x = (centers[rng.integers(0, 80, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    fitted = []
    below = neighbors._fit_below
    monkeypatch.setattr(neighbors, "_fit_below", lambda *a, **kw: fitted.append(below(*a, **kw)) or fitted[-1])
    near = neighbors.nearest(frame(spark, list(range(3000)), x), "vec_id", "vector", dims=16, k=5, part_rows=20, probes=3, max_parts=4)
    got = {(r["a"], r["b"]) for r in neighbors.neighbour_pairs(near).collect()}
    want = {(min(i, int(o)), max(i, int(o))) for i, w in exact(np.arange(3000), x.astype(float), 5).items() for o in w}
    assert fitted and len(fitted[0]) >= 2 and all(name.startswith("/") for name in fitted[0])
    assert len(got & want) / len(want) > 0.9


def test_small_tables_take_the_same_path(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, seen = rng.normal(size=(300, 8)), []
    fit = neighbors.fit_router
    monkeypatch.setattr(neighbors, "fit_router", lambda v, parts, **kw: seen.append(parts) or fit(v, parts, **kw))
    near = neighbors.nearest(frame(spark, list(range(300)), x), "vec_id", "vector", dims=8, k=5, part_rows=50)
    got = {(r["a"], r["b"]) for r in neighbors.neighbour_pairs(near).collect()}
    want = {(min(i, int(o)), max(i, int(o))) for i, w in exact(np.arange(300), x.astype(np.float16).astype(float), 5).items() for o in w}
    assert seen == [6] and len(got & want) / len(want) > 0.8


def test_few_and_none(spark):
    assert result(frame(spark, [], []), dims=4) == {}
    assert result(frame(spark, [7], [[1, 0, 0, 0]]), dims=4) == {}
    assert result(frame(spark, [7, 8], [[1, 0, 0, 0], [2, 0, 0, 0]]), dims=4) == {7: [8], 8: [7]}
