"""Queries of the general data-preparation problems over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.ids import id_form
from linkloom.operators import hierarchy, orphans, shredding
from linkloom.session import Scratch
from linkloom.sources.tables import table


def _id_list(column: str):
    """Distinct ids of an array in comparison form, without those that name nothing."""
    return F.array_distinct(F.array_compact(F.transform(F.col(column), id_form)))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    scratch = Scratch(spark, "orphans")
    log = table(spark, d, "message_log").select(
        id_form("message_id").alias("mid"), "ordinal", id_form("causation_id").alias("cause"), _id_list("artifact_refs").alias("refs"), F.col("created_at").alias("at")
    )
    first = scratch.save(hierarchy.first_rows(log, "mid", "ordinal", ["cause", "refs", "at"]))
    month = F.date_format("at", "yyyy-MM").alias("period")
    none = F.lit(None)
    caused = first.select(F.lit("message_log.causation_id").alias("field"), F.col("mid").alias("record_id"), F.col("cause").alias("ref_id"), F.col("ordinal").alias("seq"), "at", month)
    files = first.select(F.lit("message_log.artifact_refs").alias("field"), F.col("mid").alias("record_id"), F.explode("refs").alias("ref_id"), none.cast("long").alias("seq"), "at", month)
    members = table(spark, d, "hero_groups").select(
        F.lit("hero_groups.entity_ids").alias("field"), F.col("record_id").cast("string").alias("record_id"),
        F.explode(_id_list("entity_ids")).alias("ref_id"), none.cast("long").alias("seq"), F.col("recorded_at").alias("at"), F.date_format("recorded_at", "yyyy-MM").alias("period"),
    ).distinct()
    ntz = F.col("at").cast("timestamp_ntz")
    refs = caused.unionByName(files).unionByName(members).withColumn("at", ntz)

    def dated(name: str, key: str, start: str, end: str, field: str) -> DataFrame:
        rows = table(spark, d, name).select(id_form(key).alias("k"), F.col(start).alias("since"), F.col(end).alias("until"))
        return orphans.merged_validity(rows, "k", "since", "until").select(F.lit(field).alias("field"), "k", none.cast("long").alias("seq"), "since", "until")

    stamp = none.cast("timestamp_ntz")
    causes = first.select(F.lit("message_log.causation_id").alias("field"), F.col("mid").alias("k"), F.col("ordinal").alias("seq"), stamp.alias("since"), stamp.alias("until"))
    dated_parents = scratch.save(
        dated("stage_artifact", "artifact_ref", "registered_at", "deleted_at", "message_log.artifact_refs").unionByName(
            dated("object_entity", "entity_id", "recorded_at", "retired_at", "hero_groups.entity_ids")
        )
    )
    return refs, causes.unionByName(dated_parents), first.count() + dated_parents.count()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    refs, parents, n = _references(spark, d)
    found = orphans.find_orphans(refs, parents, n_parents=n)
    return found.select(F.col("field").alias("ref_field"), "record_id", "ref_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans by field and month."""
    refs, parents, n = _references(spark, d)
    return orphans.orphan_report(refs, orphans.find_orphans(refs, parents, n_parents=n)).withColumnRenamed("field", "ref_field")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "message_log").select(id_form("message_id").alias("id"), "ordinal", id_form("causation_id").alias("parent"))
    return hierarchy.first_rows(log, "id", "ordinal", ["parent"]).drop("ordinal")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.expand_hierarchy(_messages(spark, d))
    return out.select(F.col("id").alias("message_id"), F.col("root").alias("root_id"), "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every message with its path from the root; null for messages in or below a loop."""
    out = hierarchy.expand_hierarchy(_messages(spark, d), with_path=True)
    return out.select(F.col("id").alias("message_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", ">").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants, direct ones and height of every message that has any."""
    pairs = hierarchy.descendants(hierarchy.expand_hierarchy(_messages(spark, d), with_path=True))
    return pairs.groupBy(F.col("ancestor").alias("message_id")).agg(
        F.count(F.lit(1)).alias("n_descendants"), F.count_if(F.col("distance") == 1).alias("n_children"), F.max("distance").alias("height")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shredding.evidence_rows(_shredded(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per group node with its parent group, if it sits in one."""
    return shredding.group_rows(_shredded(spark, d))


def p5_typed(spark: SparkSession, d: str) -> DataFrame:
    """The references of hero_groups alone, by the same shredding."""
    typed = shredding.shred_evidence(table(spark, d, "hero_groups").select("record_id", "group_id", "member_evidence"), "record_id")
    return shredding.evidence_rows(Scratch(spark, "typed").save(typed))


def _shredded(spark: SparkSession, d: str) -> DataFrame:
    landed = shredding.shred_json(table(spark, d, "raw_groups").select("record_id", "raw"), "record_id", "raw", embedded={"member_evidence"})
    typed = shredding.shred_evidence(table(spark, d, "hero_groups").select("record_id", "group_id", "member_evidence"), "record_id")
    return Scratch(spark, "shredding").save(landed.unionByName(typed))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_paths, p3_descendants, p5_found, p5_typed, p5_groups)}
