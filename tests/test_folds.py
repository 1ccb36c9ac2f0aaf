import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.operators import components, folds, pairs


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m, seed):
    rng = np.random.default_rng(seed)
    s = np.where(rng.random((n, m)) < 0.3, -np.inf, rng.random((n, m)).round(2))
    got = folds.assign_max(s, 0.4)
    assert len([j for j in got if j >= 0]) == len({j for j in got if j >= 0})
    value = sum(s[i, j] if j >= 0 else 0.4 for i, j in enumerate(got))
    best = max(
        sum(s[i, j] if j < m else 0.4 for i, j in enumerate(p))
        for p in itertools.permutations(range(m + n), n)
        if all(j >= m or np.isfinite(s[i, j]) for i, j in enumerate(p))
    )
    assert value == pytest.approx(best)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(10, 14)), unique=True, max_size=12))
def test_matching_has_most_edges(edges):
    got = folds.match_most(edges)
    assert all((a, b) in edges for a, b in got.items()) and len(set(got.values())) == len(got)
    best = max((len(c) for k in range(6) for c in itertools.combinations(edges, k) if len({a for a, _ in c}) == len({b for _, b in c}) == len(c)), default=0)
    assert len(got) == best


def test_union_respects_sides_and_foes():
    side = {"a": 1, "b": 2, "c": 1, "d": 3, "e": 2}
    head, held = folds.constrained_union([("a", "b"), ("b", "c"), ("a", "d"), ("e", "d"), ("c", "e")], side, {("c", "e")})
    assert head == {"a": "a", "b": "a", "c": "c", "d": "a", "e": "e"} and held == [True, False, True, False, False]


def test_suppression_and_partitioning(spark):
    rnd = random.Random(1)
    rows = [(f"g{k % 7}", k, rnd.random(), x := rnd.random() * 30, y := rnd.random() * 30, x + 10, y + 10) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, id int, score double, x1 double, y1 double, x2 double, y2 double")
    got = {r["id"] for r in folds.suppress_boxes(df.repartition(9), ["g"], 0.3).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if all(folds.iou_matrix(np.array([r[3:]]), np.array([k[3:]]))[0, 0] < 0.3 for k in kept):
                kept.append(r)
        want |= {r[1] for r in kept}
    assert got == want


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_blocked_topk_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    rows = [(k, k % 3, k % 2 if k % 11 else None, x[k].tolist()) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, clip int, cat int, v array<double>")
    out = pairs.blocked_topk(df, key="id", side="clip", category="cat", vector="v", k=2, block_rows=block_rows).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i, ci, ki, _ in rows:
        for side in {0, 1, 2} - {ci}:
            near = sorted((-round(float(np.clip(u[i] @ u[j], 0, 1)), 6), j) for j, cj, kj, _ in rows if ki is not None and kj == ki and cj == side)[:2]
            want |= {(i, j) for _, j in near}
    assert {(r["src"], r["dst"]) for r in out} == want


def test_components(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("q", "q"), (None, "z")], "a string, b string")
    assert {tuple(r) for r in components.connected_components(df, "a", "b").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_sparse_assignment_is_as_good_as_the_dense_one():
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(60):
        n, m = rng.integers(1, 8, 2)
        scores = np.where(rng.random((n, m)) < 0.5, rng.random((n, m)).round(2), -np.inf)
        near = [{int(j): float(scores[i, j]) for j in np.flatnonzero(np.isfinite(scores[i]))} for i in range(n)]
        value = lambda out: sum(scores[i, j] if j >= 0 else 0.3 for i, j in enumerate(out))
        sparse = folds.assign_sparse(near, 0.3)
        taken = [j for j in sparse if j >= 0]
        assert len(taken) == len(set(taken)) and abs(value(sparse) - value(folds.assign_max(scores, 0.3))) < 1e-9


def test_locked_pairs_stand(spark):
    rows = [("g", 1, 10, 0.9), ("g", 1, 11, 0.8), ("g", 2, 10, 0.85), ("g", 2, 11, 0.1), ("g", 3, None, 0.9)]
    df = spark.createDataFrame(rows, "g string, a long, b long, score double")
    free = {(r["a"], r["b"]) for r in folds.assign_pairs(df, ["g"], 0.2).collect()}
    base = spark.createDataFrame([(1, 10, 0.9, 0.3), (2, 10, 0.85, 0.0)], "a long, b long, score double, margin double")
    kept = {(r["a"], r["b"]) for r in folds.assign_pairs(folds.lock_baseline(df, base, match=0.5, margin=0.1), ["g"], 0.2).collect()}
    assert free == {(1, 11), (2, 10)} and kept == {(1, 10)}
