import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import orphans

T = dt.datetime
REF = "field string, record_id string, ref_id string, seq bigint, at timestamp_ntz, period string, bits int"
PAR = "field string, k string, seq bigint, since timestamp_ntz, until timestamp_ntz"


def test_order_and_validity(spark):
    refs = [
        ("c", "m2", "m1", 2, None, "p", 1), ("c", "m1", "m2", 1, None, "p", 1), ("c", "m3", "m3", 3, None, "p", 1), ("c", "m4", "none", 4, None, "p", 1), ("c", "m5", None, 5, None, "p", 1),
        ("e", "g1", "x", None, T(2025, 1, 2), "p", 1), ("e", "g2", "x", None, T(2025, 1, 5), "p", 1), ("e", "g3", "x", None, T(2025, 1, 1), "p", 1), ("e", "g4", "x", None, None, "p", 1), ("e", "g5", "m1", None, T(2025, 1, 2), "p", 1),
    ]
    parents = [("c", f"m{k}", k, None, None) for k in range(1, 6)] + [("e", "x", None, T(2025, 1, 1), T(2025, 1, 5)), ("e", None, None, T(2025, 1, 1), T(2025, 1, 5))]
    got = orphans.find_orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR), n_parents=7)
    assert {r["record_id"] for r in got.collect()} == {"m1", "m3", "m4", "g2", "g4", "g5"}
    assert "bits" not in got.columns


@pytest.mark.parametrize("bits", [0.001, 12])
@pytest.mark.parametrize("limit", [0, 1 << 27])
def test_size_and_place_of_the_filter_change_nothing(spark, bits, limit):
    rnd = random.Random(1)
    parents = [("c", f"k{k}", k, None, None) for k in range(3000)]
    refs = [("c", f"r{k}", f"k{rnd.randrange(4000)}", 10_000, None, "p", 0) for k in range(800)] + [("c", f"h{k}", "k7", 10_000, None, "p", 0) for k in range(400)]
    r, p = spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR)
    want = sorted(x[1] for x in refs if int(x[2][1:]) >= 3000)
    assert sorted(x["record_id"] for x in orphans.find_orphans(r, p, n_parents=3000, bits_per_key=bits, broadcast_bytes=limit).collect()) == want


def test_filter_of_many_keys_is_packed_and_seldom_wrong(spark):
    n = 2_000_000
    keys = spark.range(n).select(F.lit("f").alias("field"), F.col("id").cast("string").alias("k"))
    words = orphans.words_for(n)
    slices = orphans.bloom_slices(keys, ["field", "k"], words).cache()
    sizes = [r["n"] for r in slices.select(F.size("bits").alias("n")).collect()]
    assert sum(sizes) == words and max(sizes) <= orphans.SLICE_WORDS and 8 * words <= 1.01 * n * orphans.BITS_PER_KEY / 8
    asked = spark.range(2 * n).select(F.lit("f").alias("field"), F.col("id").cast("string").alias("k"), "id")
    out = orphans.probe(asked, slices, ["field", "k"], words, broadcast=True)
    known, unknown = out.agg(F.count_if((F.col("id") < n) & F.col("maybe")), F.count_if((F.col("id") >= n) & F.col("maybe"))).head()
    assert known == n and unknown < 0.02 * n
    slices.unpersist()


def test_validity_periods_are_merged(spark):
    rows = [("a", T(2025, 1, 1), T(2025, 1, 5)), ("a", T(2025, 1, 3), T(2025, 1, 9)), ("a", T(2025, 2, 1), None), ("a", T(2025, 1, 1), T(2025, 1, 5)), ("b", None, None), (None, T(2025, 1, 1), None), ("c", T(2025, 1, 2), T(2025, 1, 1))]
    df = spark.createDataFrame(rows, "key string, s timestamp_ntz, e timestamp_ntz")
    got = {tuple(r) for r in orphans.merged_validity(df, "key", "s", "e").collect()}
    assert got == {("a", T(2025, 1, 1), T(2025, 1, 9)), ("a", T(2025, 2, 1), T(9999, 12, 31))}


def test_empty_tables_and_report(spark):
    r, p = spark.createDataFrame([], REF), spark.createDataFrame([], PAR)
    assert orphans.find_orphans(r, p, n_parents=0).count() == 0
    one = spark.createDataFrame([("c", "m", "x", 1, None, "2025-01", 0)], REF)
    lost = orphans.find_orphans(one, p, n_parents=0)
    assert [tuple(x) for x in orphans.orphan_report(one, lost).collect()] == [("c", "2025-01", 1, 1)]
