import random

from linkloom.operators import hierarchy


def brute(parents: dict) -> dict:
    out = {}
    for n in parents:
        path, x = [n], n
        while (p := parents[x]) in parents and p is not None and p not in path:
            path.append(p)
            x = p
        p = parents[x]
        if p is None or p not in parents:
            out[n] = (x, len(path) - 1, "/".join(reversed(path)))
        else:
            out[n] = (min(path[path.index(p) :]), -1, None)
    return out


def run(spark, parents):
    df = spark.createDataFrame([(a, b, "x") for a, b in parents.items()], "id string, parent string, root string")
    return hierarchy.expand_hierarchy(df, with_path=True)


def check(spark, parents):
    got = {r["id"]: (r["root"], r["depth"], "/".join(r["path"]) if r["path"] else None) for r in run(spark, parents).collect()}
    assert got == brute(parents)


def test_random_forest_with_loops_and_long_chains(spark):
    rnd = random.Random(3)
    ids = [f"m{k:03d}" for k in range(220)]
    parents = {x: rnd.choice([None, "gone", rnd.choice(ids), rnd.choice(ids)]) for x in ids[:120]}
    parents |= {x: ids[k - 1 + 120] if k else None for k, x in enumerate(ids[120:])}  # a chain of a hundred
    parents |= {"l1": "l2", "l2": "l3", "l3": "l1", "below": "l2", "self": "self", "under": "self"}
    check(spark, parents)


def test_star_and_single_nodes(spark):
    check(spark, {"hub": None} | {f"s{k}": "hub" for k in range(60)} | {"alone": "nobody"})


def test_empty(spark):
    out = hierarchy.expand_hierarchy(spark.createDataFrame([], "id string, parent string"))
    assert out.columns == ["id", "root", "depth"] and out.count() == 0


def test_first_rows_ties_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", 2, "late", 9), ("a", 1, None, 8), ("b", 1, "y", 7), ("b", 1, "x", 7), (None, 0, "z", 1)], "id string, ordinal int, parent string, _v int")
    got = {r["id"]: (r["ordinal"], r["parent"]) for r in hierarchy.first_rows(df, "id", "ordinal", ["parent"]).collect()}
    assert got == {"a": (1, None), "b": (1, "x")}


def test_descendants(spark):
    pairs = hierarchy.descendants(run(spark, {"a": None, "b": "a", "c": "b", "d": "a", "x": "y", "y": "x"}))
    assert {tuple(r) for r in pairs.collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
