import random

from linkloom.llm import components, splits


def brute(edges):
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            head[max(a, b)] = min(a, b)
    return {x: find(x) for x in head}


def test_giant_chain_and_small_groups(spark):
    rnd = random.Random(5)
    edges = [("hub", f"s{k:03d}") for k in range(90)]  # the giant: a star with a long tail
    edges += [(f"t{k:03d}", f"t{k + 1:03d}") for k in range(60)] + [("t000", "s000")]
    edges += [(f"p{k}", f"p{k + rnd.randrange(1, 3)}") for k in range(0, 60, 4)]
    edges += [(f"z{k:02d}", f"a{k % 3}z") for k in range(20)]
    edges += [(b, a) for a, b in edges[:40]] + edges[:10] + [("self", "self"), (None, "x"), ("y", None), (None, None)]
    df = spark.createDataFrame([(a, b, "c", "c") for a, b in edges], "a string, b string, u string, v string")
    got = {r["item"]: r["group"] for r in components.group_pairs(df, "a", "b").collect()}
    assert got == brute(edges)


def test_search_that_stops_below_the_smallest_name(spark):
    # The tail leads from the star to a smaller id that only the propagation reaches.
    edges = [("m", f"n{k:03d}") for k in range(300)] + [("n000", "l1"), ("l1", "l2"), ("l2", "l3"), ("l3", "a")]
    df = spark.createDataFrame(edges, "a string, b string")
    out = components.group_pairs(df, "a", "b").collect()
    assert len(out) == 305 and {r["group"] for r in out} == {"a"}


def test_no_pairs(spark):
    df = spark.createDataFrame([("x", "x"), (None, "y")], "a string, b string")
    out = components.group_pairs(df, "a", "b")
    assert out.columns == ["item", "group"] and out.count() == 0


SCHEMA = "vec_id long, identity_id string, video_id string, tracklet_id string, block_id int, r int"


def test_blocks_ignore_stand_ins_and_spellings(spark):
    rows = [
        (5, "A ", "v1", None, 0, 0), (3, "a", "n/a", " ", 0, 0), (9, "b", "V1\t", "-", 0, 0), (7, "unknown", "N/A", "-", 0, 0), (8, "UNKNOWN", "未知", "", 0, 0),
        (1, "v1", None, "x", 0, 0), (2, "?", None, None, 0, 0), (4, "?", None, "--", 0, 0), (5, "A ", "v1", None, 0, 0), (None, "a", "v1", None, 0, 0),
    ]
    got = {(r["vec_id"], r["block_id"]) for r in splits.related_blocks(spark.createDataFrame(rows, SCHEMA), "vec_id", ["identity_id", "video_id", "tracklet_id"]).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7), (8, 8), (1, 1), (2, 2), (4, 4)}


def test_blocks_long_chain_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(k, f"i{k // 2}", f"v{(k + 1) // 2}", None, 0, 0) for k in range(80)] + [(100 + k, f"j{rnd.randrange(30)}", f"w{rnd.randrange(30)}", f"j{rnd.randrange(9)}", 0, 0) for k in range(60)]
    rows += [(1000 + k, None, "busy", None, 0, 0) for k in range(70)]
    edges = [((0, r[0]), (c, v)) for r in rows for c, v in enumerate(r[1:4], 1) if v]
    want = brute(edges)
    least = {}
    for r in rows:
        h = want[(0, r[0])]
        least[h] = min(least.get(h, 1 << 60), r[0])
    got = {r["vec_id"]: r["block_id"] for r in splits.related_blocks(spark.createDataFrame(rows, SCHEMA), "vec_id", ["identity_id", "video_id", "tracklet_id"]).collect()}
    assert got == {r[0]: least[want[(0, r[0])]] for r in rows}


def test_blocks_of_nothing(spark):
    out = splits.related_blocks(spark.createDataFrame([], SCHEMA), "vec_id", ["identity_id", "video_id"])
    assert out.count() == 0 and out.columns == ["vec_id", "block_id"]


def test_parts_keep_blocks_whole_and_proportions(spark):
    rnd = random.Random(4)
    rows = [(k, k // 300 if k < 1500 else 10_000 + k // rnd.choice([2, 3]), rnd.choice(["old", "new", None]), "x") for k in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, block_id long, kind string, part string")
    want = {"train": 0.7, "validation": 0.2, "test": 0.1}
    out = splits.assign_parts(df, "vec_id", "kind", want).collect()
    assert len(out) == 6000
    parts = {}
    for r in out:
        assert parts.setdefault(r["block_id"], r["part"]) == r["part"]
    kinds = {r[0]: r[2] for r in rows}
    for p, share in want.items():
        assert abs(sum(r["part"] == p for r in out) / 6000 - share) < 0.03
        for kind in ("old", "new", None):
            n = sum(k == kind for k in kinds.values())
            assert abs(sum(r["part"] == p and kinds[r["vec_id"]] == kind for r in out) / n - share) < 0.06


def test_stand_ins_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, " Mu "), (4, "mu"), (5, "--"), (6, "--")], "k long, e string")
    blocks = lambda **kw: {r["k"]: r["block_id"] for r in splits.related_blocks(df, "k", ["e"], **kw).collect()}
    assert blocks() == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
    assert blocks(stand_ins=("mu",)) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_labels_and_not_their_hashes_are_balanced(spark):
    rows = [(k, k // 2, f"label{k % 40}" if k % 41 else None) for k in range(16_000)]
    parts = splits.assign_parts(spark.createDataFrame(rows, "k long, block_id long, label string"), "k", "label", {"a": 0.75, "b": 0.25}).collect()
    of = {r["k"]: r["part"] for r in parts}
    assert len(of) == len(parts) == len(rows) and all(of[2 * k] == of[2 * k + 1] for k in range(8_000))
    for x in {r[2] for r in rows}:
        mine = [of[k] for k, _, label in rows if label == x]
        assert abs(mine.count("a") / len(mine) - 0.75) < 0.06
