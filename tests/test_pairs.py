import itertools
import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import pairs
from linkloom.plans import evidence, linkage
from tests.oracle import rows

NAN, INF = float("nan"), float("inf")


def odd_parts(spark, folder, prices):
    """A few blocks with repeated keys, nulls and odd prices."""
    rnd = random.Random(3)
    made = [(rnd.choice([None, *range(300)]), rnd.choice(["hot bolt", "old ring", "", None]), rnd.choice(["B1", "B2", None]), rnd.choice(["LARGE", "SMALL", None]), rnd.choice([1, 2, None]), rnd.choice(prices)) for _ in range(400)]
    spark.createDataFrame(made, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def joined(spark, d):
    p = linkage._parts(spark, d)
    return p.alias("a").join(p.alias("b"), (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_size") == F.col("b.p_size")) & (F.col("a.p_partkey") < F.col("b.p_partkey")))


ODD = [None, 0.0, -3.0, 1.0, 5.0, 5.0, 7.0, 10.0, 12.8, 12.7, 0.01]


def former_score(spark, d):
    agree = pairs.attribute_agreement([(F.col("a.kind"), F.col("b.kind")), (F.col("a.word"), F.col("b.word"))])
    aspect = pairs.aspect_similarity(F.col("a.p_retailprice"), F.col("b.p_retailprice"))
    score = pairs.ceding_score([(0.6, agree), (0.4, aspect)])
    return joined(spark, d).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.round(agree, 6).alias("agreement"), F.round(aspect, 6).alias("aspect"), F.round(score, 6).alias("score"))


def former_blend(spark, d):
    told = [F.when((F.col(f"a.{c}") != "unknown") & (F.col(f"b.{c}") != "unknown"), (F.col(f"a.{c}") == F.col(f"b.{c}")).cast("double")) for c in ("kind", "word")]
    visual = pairs.aspect_similarity(F.col("a.p_retailprice"), F.col("b.p_retailprice"))
    return joined(spark, d).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.round(F.coalesce(0.75 * visual + 0.25 * pairs.ceding_score([(0.4, told[0]), (0.6, told[1])]), visual), 6).alias("score"))


def same(x, y):
    assert x.columns == y.columns and x.dtypes == y.dtypes
    got, want = (rows(df.columns, [tuple(r) for r in df.collect()]) for df in (x, y))
    assert got == want and got


def tasks_with_pairs(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().count()


@pytest.mark.parametrize(("query", "former"), [(linkage.attribute_score, former_score), (evidence.semantic_blend, former_blend)])
def test_scored_pairs(spark, data, tmp_path, query, former):
    d = odd_parts(spark, tmp_path, [*ODD, NAN, INF, 1e300, 1e-300])
    same(query(spark, d), former(spark, d))
    # A small table is one file; its pairs must not be one task's work.
    assert tasks_with_pairs(former(spark, data)) < 4 <= tasks_with_pairs(query(spark, data))


def test_block_in_chunks(spark, tmp_path):
    d = odd_parts(spark, tmp_path, ODD)
    got = pairs.block_pairs(linkage._parts(spark, d), block=["p_brand", "p_size"], key="p_partkey", chunk_rows=7)
    same(got.select("a.p_partkey", F.col("b.p_partkey").alias("o")), joined(spark, d).select("a.p_partkey", F.col("b.p_partkey").alias("o")))


def test_rounded(spark):
    values = [0.0, 0.5, 0.0000005, 0.0000015, 0.9921875, 0.5078125, 127 / 128 - 1e-16, 0.1234565, 0.12345649999999999, -0.1234565, 2000.1234565, 1e300, NAN, INF, None, *[random.Random(5).random() for _ in range(200)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.filter(~pairs.rounded(F.col("v")).eqNullSafe(F.round("v", 6))).count() == 0


@pytest.mark.parametrize("label", [None, "kind"])
def test_swept_pairs(spark, tmp_path, label):
    d = odd_parts(spark, tmp_path, [*ODD, NAN])
    grid = list(itertools.product((0.0, 0.25, 0.5, 1.0), (0.0, 0.5, 0.7, 0.9, 1.0, 1.1)))
    got = pairs.swept_pairs(linkage._parts(spark, d), block=["p_brand", "p_size"], key="p_partkey", value="p_retailprice", same="word", settings=grid, digits=6, label=label)
    agree = F.lit(0.5) if label is None else F.coalesce(pairs.attribute_agreement([(F.col("a.kind"), F.col("b.kind"))]), F.lit(0.5))
    s = joined(spark, d).select(agree.alias("g"), pairs.aspect_similarity(F.col("a.p_retailprice"), F.col("b.p_retailprice")).alias("s"), (F.col("a.word") == F.col("b.word")).alias("y"))
    s = s.crossJoin(spark.createDataFrame(grid, "weight double, threshold double"))
    hit = F.round(F.col("weight") * F.col("g") + (1 - F.col("weight")) * F.col("s"), 6) >= F.col("threshold")
    same(got, s.groupBy("weight", "threshold").agg(F.count_if(hit).alias("n_pairs"), F.count_if(hit & F.col("y")).alias("n_hits"), F.count_if("y").alias("n_true"), F.count(F.lit(1)).alias("n_all")))


@pytest.mark.parametrize("query", [linkage.threshold_sweep, evidence.configuration_sweep])
def test_sweeps_form_no_pairs(spark, data, tmp_path, query):
    assert "Join" not in query(spark, data)._jdf.queryExecution().executedPlan().toString()
    d = odd_parts(spark, tmp_path, [10.0, 1.0])
    assert query(spark, d).count() > 0
    spark.read.parquet(f"{d}/part.parquet").limit(1).write.parquet(f"{tmp_path}/one/part.parquet")
    assert query(spark, f"{tmp_path}/one").count() == 0


def test_no_hit_at_a_threshold(spark, tmp_path):
    made = [(k, "hot bolt", "B", "LARGE", 1, p) for k, p in ((1, 1.0), (2, 100.0))]
    spark.createDataFrame(made, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert {tuple(r) for r in linkage.threshold_sweep(spark, str(tmp_path)).collect()} == {(x / 10, 0, 0, None) for x in range(5, 10)}
