import math
import random

from pyspark.sql import functions as F

from linkloom.functions import kernels as K
from linkloom.operators import groups, pairs


def test_mcnemar_at_small_and_large_counts(spark):
    cases = [(0, 0), (0, 1), (3, 9), (5, 5), (600, 600), (600, 700), (40_000, 41_000), (10**9, 10**9 + 80_000)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, b long, c long")
    got = {r["k"]: r["p"] for r in df.select("k", K.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()}
    assert got[0] is None
    for k, (b, c) in enumerate(cases[1:7], 1):
        n, low = b + c, min(b, c)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(low + 1)]
        want = min(1.0, 2 * sum(map(math.exp, logs)))
        assert math.isclose(got[k], want, rel_tol=1e-7)
    z = (80_000 - 1) / math.sqrt(2 * 10**9 + 80_000)
    assert math.isclose(got[7], math.erfc(z / math.sqrt(2)), rel_tol=1e-3)


def test_required_trials_against_a_search(spark):
    df = spark.createDataFrame([(x / 20,) for x in range(21)], "p double")
    for width in (0.3, 0.05, 0.02):
        half = lambda p, n: 1.96 * math.sqrt(p * (1 - p) / n + 1.96**2 / (4 * n * n)) / (1 + 1.96**2 / n)
        for r in df.select("p", K.required_trials(F.col("p"), width).alias("n")).collect():
            assert r["n"] == next(n for n in range(1, 10_000) if half(r["p"], n) <= width + 1e-9)


def test_nearest_ranks_of_hot_and_odd_groups(spark):
    rnd = random.Random(2)
    rows = [("hot", rnd.gauss(0, 1) ** 3) for _ in range(4000)] + [("hot", 1e9)] + [("same", 5.0)] * 2500 + [("one", 1.0), ("two", 2.0), ("two", 1.0), (None, 7.0), (None, 8.0), ("void", None)]
    df = spark.createDataFrame([(g, x, 1) for g, x in rows], "g string, x double, c int").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    want = {}
    for g in {g for g, x in rows if x is not None}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        want[g] = [v[min(len(v) - 1, int(len(v) * p))] for p in shares.values()]
    for few in (10, 10_000):
        got = {r["g"]: [r[k] for k in shares] for r in groups.nearest_ranks(df, "g", "x", shares, buckets=16, few=few).collect()}
        assert got == want


def test_first_hit_rank_beyond_any_list(spark):
    rnd = random.Random(5)
    rows = [(k, k % 3, "rare" if k in (0, 299) else "common" if k % 2 else None, [rnd.random() for _ in range(4)]) for k in range(300)] + [(900, 0, "alone", [1.0, 0.0, 0.0, 0.0]), (901, 0, "common", None)]
    df = spark.createDataFrame(rows, "id long, clip int, label string, v array<double>")
    got = {r["src"]: (r["label"], r["rank"]) for r in pairs.first_hit_rank(df, key="id", query=F.col("clip") == 0, label="label", vector="v", block_rows=40).collect()}
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    known = [(k, c, lab, unit(v)) for k, c, lab, v in rows if lab and v]
    want = {}
    for k, c, lab, v in known:
        if c == 0:
            order = sorted((-round(min(1, max(0, sum(a * b for a, b in zip(v, w, strict=True)))), 6), i, m) for i, d, m, w in known if d != 0)
            want[k] = (lab, next((n for n, (_, _, m) in enumerate(order, 1) if m == lab), None))
    assert got == want and got[0][1] > 20 and got[900] == ("alone", None)
