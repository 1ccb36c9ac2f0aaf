"""Queries of the training-data problems over the domain tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.ids import id_form
from linkloom.llm import bpe, components, leakage, neighbors, residue, splits
from linkloom.llm.queries_sql import SQL  # noqa: F401
from linkloom.session import Scratch
from linkloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    merge = table(spark, d, "merge_pairs").select(id_form("tracklet_a").alias("a"), id_form("tracklet_b").alias("b"))
    stitch = table(spark, d, "stitch_map").select(id_form("a").alias("a"), id_form("b").alias("b"))
    groups = components.group_pairs(merge.unionAll(stitch), "a", "b")
    return groups.select(F.col("item").alias("tracklet_id"), F.col("group").alias("group_id"))


def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p1_found(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "sf1_sample").select("vec_id", "identity_id", "video_id", "tracklet_id")
    return splits.related_blocks(samples, "vec_id", ["identity_id", "video_id", "tracklet_id"])


PARTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    """The part of every sample at 80/10/10; strata are the kinds of video (the name's part after the home)."""
    kind = F.regexp_extract(F.coalesce(splits.known("video_id"), F.lit("")), r"^[^_]*_(.*)$", 1)
    kinds = table(spark, d, "sf1_sample").select("vec_id", kind.alias("kind"))
    return splits.assign_parts(p4_found(spark, d).join(kinds, "vec_id"), "vec_id", "kind", PARTS)


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows and blocks of every part."""
    return p4_split(spark, d).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("block_id").alias("n_blocks"))


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the split: every row once, no block and no known value in two parts, shares within a hundredth or
    the largest block of what is wanted."""
    scratch = Scratch(spark, "splits")
    parts = scratch.save(p4_split(spark, d))
    named = table(spark, d, "sf1_sample").select("vec_id", *[splits.known(c).alias(c) for c in ("identity_id", "video_id", "tracklet_id")])
    told = F.explode(F.array(*[F.concat_ws("|", F.lit(c), F.col(c)) for c in ("identity_id", "video_id", "tracklet_id")]))
    values = parts.join(named, "vec_id").select("part", "identity_id", "video_id", "tracklet_id", told.alias("value")).filter("contains(value, '|')")
    parted = lambda df, key: df.groupBy(key).agg(F.countDistinct("part").alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"{key}s_parted"))
    largest = parts.groupBy("block_id").count().agg(F.max("count").alias("largest"))
    whole = parts.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_different"))
    off = F.max(F.abs(F.col("count") - F.element_at(F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv]), F.col("part")) * F.col("n")))
    far = parts.groupBy("part").count().join(whole).join(largest).agg((off > F.max(F.greatest(F.col("n") / 100, "largest"))).cast("int").alias("far_off"))
    return whole.join(parted(parts, "block_id")).join(parted(values, "value")).join(far)


DIMS = 96


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sf1_sample").select("vec_id", "vector").unionAll(table(spark, d, "track_embedding").select("vec_id", "vector"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbors.nearest(_vectors(spark, d), "vec_id", "vector", dims=DIMS)
    return neighbors.neighbour_pairs(near).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def tokenizer(name: str) -> str:
    """The path of a public vocabulary file; LINKLOOM_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("LINKLOOM_TOKENIZERS", "/opt/tokenizers"), name)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", tokenizer("byte_bpe_50k.tiktoken"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text")
    return leakage.find_leaks(docs, "doc_id", items, "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold each leaked item."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the corpus by kind of document, with the cases excluded; empty texts stay."""
    docs = table(spark, d, "documents").select("doc_id", "doc_kind", "n_chars")
    kept = docs.join(p9_found(spark, d), "doc_id", "left_anti")
    return kept.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_sizes, p4_found, p4_split, p4_balance, p4_checks, p6_found, p7_ids, p8_found, p8_report, p9_found, p9_clean)}
