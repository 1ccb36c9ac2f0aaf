import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as X
from linkloom.operators import folds, joins, pairs, tracks


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["o"] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


# --- texts ------------------------------------------------------------------------------------------------------------


def test_label_forms(spark):
    odd = ["Ｆｕｌｌ　Ｗｉｄｔｈ", "Straße 7", "a--b__c", " 收纳箱（大） ", "", None, "é", "①"]
    assert column(spark, odd, X.unicode_form) == ["ｆｕｌｌ ｗｉｄｔｈ", "straße 7", "a b c", "收纳箱 大", "", None, "é", "①"]
    want = [None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in odd]
    assert column(spark, odd, X.nfkc) == want
    assert column(spark, ["Ｔｏｙ Crane!", "__x__", "收纳箱（大）", None], X.anchor_form) == ["toy_crane", "x", "收纳箱_大", None]
    slugs = column(spark, ["Toy Crane (2)", "收纳箱", "x" * 90, None], X.slug)
    assert slugs[0] == "toy_crane_2" and slugs[1].startswith("anchor_") and len(slugs[1]) == 17 and slugs[2] == "x" * 40 and slugs[3] is None


def test_longest_keyword_wins_and_is_consumed(spark):
    got = column(spark, ["a toolbox, a tool and a box", "toolboxbox", "", None, "c++ (x)"], lambda c: X.keywords(c, ["tool", "box", "toolbox", "c++"]), "string")
    assert got == [["toolbox", "tool", "box"], ["toolbox", "box"], [], None, ["c++"]]


def test_slots(spark):
    got = column(spark, ["Red Box!", "紅色的", "box", None, "的"], lambda c: X.slot_form(c, ["的"], {"紅色": "red", "redbox": "crate"}))
    assert got == ["crate", "red", "box", None, "的"]
    assert column(spark, ["A b"], lambda c: X.slot_form(c, [], {})) == ["ab"]


def test_arrays_in_answers(spark):
    answers = ['[{"id": "a"}]', '```json\n[{"id": "a"}, {"id": "b"}]\n```', 'Here: [{"id": "a"}] done', "none", "[{broken]", None, "[]"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(answers)], "k int, t string")
    rows, wrong = X.json_array(F.col("t"), "struct<id string>")
    got = df.select("k", F.transform(rows, lambda x: x["id"]).alias("ids"), wrong.alias("w")).orderBy("k").collect()
    assert [(r["ids"], r["w"]) for r in got] == [(["a"], None), (["a", "b"], None), (["a"], "surrounding text"), (None, "no array"), (got[4]["ids"], "damaged" if got[4]["ids"] is None else None), (None, "no array"), ([], None)]
    assert column(spark, [" Open ", "shut", None], lambda c: X.enum_or_unknown(c, ["open"])) == ["open", "unknown", "unknown"]


# --- joins ------------------------------------------------------------------------------------------------------------


def test_required_join(spark):
    left = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert joins.required_join(left, spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "k int, v double"), ["k"]).count() == 3
    for right in ([(1, 1.0)], [(1, 1.0), (2, 1.0), (2, 2.0)]):
        with pytest.raises(joins.JoinError):
            joins.required_join(left, spark.createDataFrame(right, "k int, v double"), ["k"])


def test_constraints_in_either_order(spark):
    p = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5)], "a int, b int")
    c = spark.createDataFrame([(2, 1, "same"), (1, 2, "same"), (1, 3, "different"), (3, 2, "same"), (2, 3, "different"), (8, 9, "same")], "a int, b int, kind string")
    assert {(r["a"], r["b"]): r["constraint"] for r in joins.constrained_pairs(p, c).collect()} == {(1, 2): "same", (1, 3): "different", (2, 3): "conflict", (4, 5): None}


def test_reconcile(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k int, n string")
    t1, t2 = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, target string"), spark.createDataFrame([("a", "x"), ("b", "z")], "k string, target string")
    got = {r["k"]: tuple(r)[1:] for r in pairs.reconcile(rows, "k", [(t1, F.col("n"), 1.0), (t2, F.col("n"), 0.8)]).collect()}
    assert got == {1: ("mapped", "x", 1.0), 2: ("conflict", None, 0.0), 3: ("unmapped", None, 0.0), 4: ("unmapped", None, 0.0)}


# --- folds ------------------------------------------------------------------------------------------------------------


def stitch_brute(edges, times, forbidden):
    clusters = {k: {k} for k in times}
    for _, a, b in sorted((-s, a, b) for a, b, s in edges):
        x, y = clusters[a], clusters[b]
        if x is y or any(times[i] & times[j] for i in x for j in y) or any((i, j) in forbidden or (j, i) in forbidden for i in x for j in y):
            continue
        x |= y
        for k in y:
            clusters[k] = x
    return {k: min(c) for k, c in clusters.items()}


def test_stitch_against_brute_force(spark):
    rnd = random.Random(7)
    times = {k: frozenset(rnd.sample(range(12), rnd.randrange(1, 4))) for k in range(40)}
    edges = [(a, b, round(rnd.random(), 2)) for a, b in itertools.combinations(range(40), 2) if rnd.random() < 0.12 and not times[a] & times[b]]
    forbidden = {(a, b) for a, b, _ in edges[::6]}
    t = spark.createDataFrame([(k, sorted(v), "x") for k, v in times.items()], "track long, times array<long>, head string")
    c = spark.createDataFrame(edges, "a long, b long, score double")
    f = spark.createDataFrame(list(forbidden), "a long, b long")
    for foes, frame in ((set(), None), (forbidden, f)):
        got = {r["track"]: r["head"] for r in tracks.stitch(c, t, key="track", forbidden=frame).collect()}
        assert got == stitch_brute(edges, times, foes)
    assert tracks.stitch(c.limit(0), t.limit(0), key="track").count() == 0


def test_must_links_come_first():
    side = {1: 0, 2: 1, 3: 1, 4: 2}
    assert folds.constrained_union([(1, 2)], side)[0] == {1: 1, 2: 1, 3: 3, 4: 4}
    head, held = folds.constrained_union([(1, 2), (2, 4)], side, must=[(1, 3)])
    assert head == {1: 1, 2: 2, 3: 1, 4: 2} and held == [False, True]
    with pytest.raises(ValueError, match="must be one"):
        folds.constrained_union([], side, must=[(2, 3)])
    with pytest.raises(ValueError, match="must be one"):
        folds.constrained_union([], side, cannot={(1, 4)}, must=[(1, 2), (2, 4)])


def test_frames_match_as_many_boxes_as_possible(spark):
    rnd = random.Random(3)
    box = lambda: (x := rnd.randrange(20), y := rnd.randrange(6), x + 9, y + 5)
    rows = {real: [(f, "l", 10 * f + k, *map(float, box()), "z") for f in range(12) for k in range(rnd.randrange(5))] for real in (True, False)}
    schema = "frame int, label string, id long, x1 double, y1 double, x2 double, y2 double, iou string"
    t, f = (spark.createDataFrame(rows[real], schema) for real in (True, False))
    got = folds.match_frames(t, f, ["frame"], "label", 0.3).collect()
    assert sorted(r["truth_id"] for r in got if r["truth_id"] is not None) == sorted(r[2] for r in rows[True])
    assert sorted(r["found_id"] for r in got if r["found_id"] is not None) == sorted(r[2] for r in rows[False])
    import numpy as np

    for frame in range(12):
        a, b = ([r for r in rows[real] if r[0] == frame] for real in (True, False))
        over = folds.iou_matrix(np.array([r[3:7] for r in a]).reshape(-1, 4), np.array([r[3:7] for r in b]).reshape(-1, 4)) >= 0.3
        small, large = (over, over.T) if len(a) <= len(b) else (over.T, over)
        most = max((sum(bool(small[i, j]) for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0])), default=0) if small.size else 0
        assert sum(r["iou"] is not None for r in got if r["frame"] == frame) == most


def test_spaced_and_clustered_and_packed(spark):
    rows = [("u", 1.0, 5.0), ("u", 2.0, 1.0), ("u", 3.0, 2.0), ("u", 9.0, 3.0), ("u", 9.5, 9.0), ("v", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, at double, s double")
    assert {(r["g"], r["at"]) for r in folds.spaced_best(df, ["g"], "at", "s", share=0.8, gap=2.0, most=2).collect()} == {("u", 2.0), ("u", 9.0), ("v", 1.0)}
    boxes = [("f", 1, 0.0, 0.0, 10.0, 10.0), ("f", 2, 2.0, 0.0, 12.0, 10.0), ("f", 3, 50.0, 0.0, 60.0, 10.0), ("f", 4, 4.0, 0.0, 14.0, 10.0), ("g", 1, 0.0, 0.0, 1.0, 1.0)]
    b = spark.createDataFrame(boxes, "f string, id int, x1 double, y1 double, x2 double, y2 double")
    assert {(r["f"], r["id"]): r["cluster"] for r in folds.cluster_boxes(b, ["f"], 0.6).collect()} == {("f", 1): 0, ("f", 2): 0, ("f", 3): 1, ("f", 4): 0, ("g", 1): 0}
    assert folds.pack_first_fit([("a", 3), ("b", 3), ("c", 2), ("d", 1)], 5, {frozenset(("a", "c"))}) == [["a", "d"], ["b", "c"]]


def test_word_runs_and_choices(spark):
    assert [sorted(x) if x else x for x in column(spark, ["a b c", "a", "", None, "a b a b"], lambda c: X.word_runs(c, 2))] == [["a", "a b", "b", "b c", "c"], ["a"], None, None, ["a", "a b", "b", "b a"]]
    answers = ['{"small": 70, "big": 20}', '{"small": 170, "big": 100}', '{"small": null, "big": -3}', "no", None, "{}"]
    assert column(spark, answers, lambda c: X.scored_choice(c)[1]) == ["small", None, "big", None, None, None]


def test_containment_both_ways(spark):
    rows = spark.createDataFrame([(1, "red toy crane"), (2, "crane"), (3, "toy"), (4, "craner"), (5, None), (6, "box")], "alias int, name string")
    al = spark.createDataFrame([("toy crane", "T"), ("red", "R"), ("box", "B"), ("big box", "B")], "alias string, target string")
    got = {r["alias"]: (r["target"], r["n_targets"]) for r in pairs.resolve_by_containment(rows, "alias", "name", al).collect()}
    assert got == {1: (None, 2), 2: ("T", 1), 3: ("T", 1), 4: (None, 0), 5: (None, 0), 6: ("B", 1)}


def test_most_pairs_before_the_best_sum(spark):
    rows = [("g", 1, 10, 0.9), ("g", 1, 11, 0.1), ("g", 2, 10, 0.2), ("h", 1, 1, -5.0)]
    df = spark.createDataFrame(rows, "g string, a long, b long, score double")
    run = lambda **kw: {tuple(r)[:3] for r in folds.assign_pairs(df, ["g"], -9.0 if kw else 0.0, **kw).collect()}
    assert run() == {("g", 1, 10)} and run(most_first=True) == {("g", 1, 11), ("g", 2, 10), ("h", 1, 1)}


def test_quota_and_cover(spark):
    rows = [("u", float(k), float((k * 7) % 10)) for k in range(10)] + [("v", 1.0, 5.0)]
    got = {}
    for r in folds.quota_sample(spark.createDataFrame(rows, "g string, at double, s double"), ["g"], "at", "s", quota=4, gap=2.0).collect():
        got.setdefault(r["g"], []).append(r["at"])
    # By score 7 (9) and 4 (8); of the rest 0, 1, 2, 3, 5, 6, 8, 9 every fourth: 0, then 5 is too near, then what fits.
    assert sorted(got["u"]) == [0.0, 2.0, 4.0, 7.0] and got["v"] == [1.0]
    sets = [("g", 1, ["a", "b"]), ("g", 2, ["b", "c", "d"]), ("g", 3, ["a"]), ("g", 4, None), ("h", 9, [])]
    out = folds.greedy_cover(spark.createDataFrame(sets, "g string, k int, m array<string>"), ["g"], "k", "m", 3).collect()
    assert [tuple(r) for r in sorted(out, key=lambda r: r["place"])] == [("g", 2, 1, 3), ("g", 1, 2, 1)]
