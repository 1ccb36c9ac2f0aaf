"""Adjacency-table shredding of semi-structured texts.

``shred_json`` turns every text into rows ``node, parent, label, ordinal, kind, value``; whatever shape a text has, the
relation is the same. Entity tables are then plain joins: an object node with its scalar children, pivoted by label.
Array elements carry the label of their array, so the element of ``refs`` is labelled ``refs`` wherever it sits.

Texts that are null, empty or no valid JSON give no rows, as do texts nested deeper than the parser allows. Of equal
keys in one object the last counts. Numbers keep their written form. Rows with equal key and text count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.session import Scratch

SCALARS = ("string", "number", "boolean")


class _Number(str):
    """A number as written."""


def _reject(constant: str):
    raise ValueError(constant)


def parse(text: str):
    return json.loads(text, parse_constant=_reject, parse_int=_Number, parse_float=_Number)


def adjacency(text: str | None, embedded: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """Rows ``node, parent, label, ordinal, kind, value`` of one text, in written order; the root's parent is -1."""
    if not text:
        return
    try:
        top = parse(text)
    except (ValueError, RecursionError):
        return
    n = 0
    stack = [(top, -1, "", 0)]
    while stack:
        value, parent, label, ordinal = stack.pop()
        while label in embedded and type(value) is str:
            try:
                inner = parse(value)
            except (ValueError, RecursionError):
                break
            if not isinstance(inner, dict | list | str) or isinstance(inner, _Number):
                break
            value = inner
        node, n = n, n + 1
        if isinstance(value, dict):
            yield node, parent, label, ordinal, "object", None
            stack.extend((v, node, k, i) for i, (k, v) in reversed(list(enumerate(value.items()))))
        elif isinstance(value, list):
            yield node, parent, label, ordinal, "array", None
            stack.extend((v, node, label, i) for i, v in reversed(list(enumerate(value))))
        elif value is None:
            yield node, parent, label, ordinal, "null", None
        elif isinstance(value, bool):
            yield node, parent, label, ordinal, "boolean", "true" if value else "false"
        else:
            yield node, parent, label, ordinal, "number" if isinstance(value, _Number) else "string", str(value)


def shred_json(texts: DataFrame, key: str, text: str, *, embedded: set[str] = frozenset()) -> DataFrame:
    """The adjacency table of all texts: ``record_id, text_id, node, parent, label, ordinal, kind, value``.

    embedded: labels under which a string may hold JSON text, which then counts as if written in place.
    """
    labels = frozenset(embedded)
    rows = texts.select(F.col(key).alias("record_id"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text")).filter("text is not null and text != ''")

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for record, text_id, body in zip(batch["record_id"], batch["text_id"], batch["text"], strict=True):
                out += [(record, text_id, *row) for row in adjacency(body, labels)]
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    schema = T.StructType(
        [
            rows.schema["record_id"],
            T.StructField("text_id", T.LongType()),
            T.StructField("node", T.LongType()),
            T.StructField("parent", T.LongType()),
            T.StructField("label", T.StringType()),
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("kind", T.StringType()),
            T.StructField("value", T.StringType()),
        ]
    )
    names = schema.names
    return rows.dropDuplicates(["record_id", "text_id"]).mapInPandas(shred, schema)


#: Children of one list element are numbered within a range of so many, which no array can fill.
_SPAN = 1 << 32


def shred_evidence(groups: DataFrame, key: str) -> DataFrame:
    """The adjacency table of typed group rows ``key, group_id, member_evidence``, as :func:`shred_json` has it for texts.

    Nothing is parsed: every row becomes an array of its nodes by expressions of the engine. A null list, element or
    field is a null node. Rows with equal content count once.
    """
    rows = groups.select(F.col(key).alias("record_id"), F.xxhash64("group_id", "member_evidence").alias("text_id"), "group_id", F.col("member_evidence").alias("evidence"))

    def node(number: Column, parent: Column, label: str, ordinal: Column, kind: Column, value: Column | None = None) -> Column:
        cells = {"node": number, "parent": parent, "label": F.lit(label), "ordinal": ordinal, "kind": kind, "value": F.lit(None) if value is None else value}
        types = {"node": "long", "parent": "long", "label": "string", "ordinal": "int", "kind": "string", "value": "string"}
        return F.struct(*[c.cast(types[name]).alias(name) for name, c in cells.items()])

    def scalar(number: Column, parent: Column, label: str, ordinal: Column, value: Column) -> Column:
        return node(number, parent, label, ordinal, F.when(value.isNull(), "null").otherwise("string"), value)

    def element(e: Column, i: Column) -> Column:
        base = (i.cast("long") + 1) * _SPAN
        fields = ["schema_version", "entity_id", "source", "detail"]
        own = [node(base, F.lit(2), "member_evidence", i, F.when(e.isNull(), "null").otherwise("object"))]
        inner = [scalar(base + 1 + k, base, name, F.lit(k), e[name]) for k, name in enumerate(fields)]
        inner.append(node(base + 5, base, "refs", F.lit(4), F.when(e["refs"].isNull(), "null").otherwise("array")))
        refs = F.transform(F.coalesce(e["refs"], F.array()), lambda r, j: scalar(base + 6 + j, base + 5, "refs", j, r))
        return F.concat(F.array(*own), F.when(e.isNotNull(), F.concat(F.array(*inner), refs)).otherwise(F.array()))

    top = F.array(
        node(F.lit(0), F.lit(-1), "", F.lit(0), F.lit("object")),
        scalar(F.lit(1), F.lit(0), "group_id", F.lit(0), F.col("group_id")),
        node(F.lit(2), F.lit(0), "member_evidence", F.lit(1), F.when(F.col("evidence").isNull(), "null").otherwise("array")),
    )
    nodes = F.concat(top, F.flatten(F.transform(F.coalesce("evidence", F.array()), element)))
    return rows.dropDuplicates(["record_id", "text_id"]).select("record_id", "text_id", F.inline(nodes))


KEY = ["record_id", "text_id"]


def pivot_scalars(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Object nodes with their scalar children as columns: ``record_id, text_id, node, <labels>``."""
    scalars = nodes.filter(F.col("kind").isin(*SCALARS) & F.col("label").isin(*labels))
    return scalars.groupBy(*KEY, F.col("parent").alias("node")).agg(*[F.max(F.when(F.col("label") == x, F.col("value"))).alias(x) for x in labels])


#: Fields that make an object an evidence element itself and not a map from entities to elements.
ELEMENT_FIELDS = ["entity_id", "source", "detail", "refs", "schema_version"]


def _child(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(*KEY, F.col("parent"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("node", "label", "ordinal", "kind", "value")])


def group_rows(nodes: DataFrame) -> DataFrame:
    """Groups: ``record_id, group_id, parent_group_id, depth_in_text`` with the nearest group above, if any.

    A group is an object with a group_id. The nearest group above is found by walking up one level a round; nesting is
    bounded by the parser, and only nodes that have not met a group yet stay in play.
    """
    groups = pivot_scalars(nodes, ["group_id"]).filter("group_id is not null")
    up = nodes.filter("kind in ('object', 'array')").select(*KEY, F.col("node"), F.col("parent").alias("above"))
    scratch = Scratch(nodes.sparkSession, "groups")
    climbing = scratch.save(groups.join(up, [*KEY, "node"]).select(*KEY, "node", "group_id", F.col("above").alias("at"), F.lit(1).alias("steps")))
    known = scratch.save(groups.select(*KEY, F.col("node").alias("at"), F.col("group_id").alias("parent_group_id")))
    out = None
    while True:
        met = climbing.join(known, [*KEY, "at"], "left")
        ended = met.filter("at = -1 or parent_group_id is not null").select("record_id", "group_id", "parent_group_id", F.when(F.col("parent_group_id").isNotNull(), F.col("steps")).alias("levels_below_parent"))
        out = ended if out is None else out.unionByName(ended)
        on = met.filter("at != -1 and parent_group_id is null").drop("parent_group_id")
        climbing = scratch.save(on.join(up.select(*KEY, F.col("node").alias("at"), "above"), [*KEY, "at"]).select(*KEY, "node", "group_id", F.col("above").alias("at"), (F.col("steps") + 1).alias("steps")))
        if climbing.isEmpty():
            return out.distinct()


def evidence_rows(nodes: DataFrame) -> DataFrame:
    """Flat references: ``record_id, group_id, evidence_pos, entity_id, source, ref_pos, ref``.

    The shapes told apart: a list of elements, one bare element, a map from entity to element or list of elements;
    references as a list, one bare value or objects with ``ref``. Null elements and references hold a position only; an
    element in which no reference stands, be its list missing, empty or all nulls, has one row with ref_pos -1 and ref ''.
    """
    # Every stage that more than one later one reads is written, so that no join is planned twice.
    scratch = Scratch(nodes.sparkSession, "evidence")
    groups = pivot_scalars(nodes, ["group_id"]).filter("group_id is not null").withColumnRenamed("node", "parent")
    boxes = groups.join(_child(nodes.filter("label = 'member_evidence' and kind in ('object', 'array')"), "box"), [*KEY, "parent"])
    boxes = boxes.select(*KEY, "group_id", F.col("box_node").alias("parent"), "box_kind")
    inside = boxes.join(_child(nodes.filter("parent >= 0"), "e"), [*KEY, "parent"]).withColumnRenamed("parent", "box")
    is_map = F.col("box_kind") == "object"
    bare = Window.partitionBy(*KEY, "box")
    inside = scratch.save(inside.withColumn("bare", F.max(is_map & F.col("e_label").isin(*ELEMENT_FIELDS)).over(bare)))

    listed = inside.filter(~is_map).select(*KEY, "group_id", "box", F.lit(None).cast("string").alias("filed"), F.col("e_node").alias("node"), F.col("e_kind").alias("kind"), F.col("e_ordinal").alias("o1"), F.lit(0).alias("o2"))
    alone = inside.filter(is_map & F.col("bare")).select(*KEY, "group_id", "box", F.lit(None).cast("string").alias("filed"), F.col("box").alias("node"), F.lit("object").alias("kind"), F.lit(0).alias("o1"), F.lit(0).alias("o2")).distinct()
    mapped = inside.filter(is_map & ~F.col("bare"))
    filed = mapped.filter("e_kind != 'array'").select(*KEY, "group_id", "box", F.col("e_label").alias("filed"), F.col("e_node").alias("node"), F.col("e_kind").alias("kind"), F.col("e_ordinal").alias("o1"), F.lit(0).alias("o2"))
    several = mapped.filter("e_kind = 'array'").select(*KEY, "group_id", "box", F.col("e_label").alias("filed"), F.col("e_node").alias("parent"), F.col("e_ordinal").alias("o1"))
    several = several.join(_child(nodes, "x").filter("parent >= 0"), [*KEY, "parent"]).select(*KEY, "group_id", "box", "filed", F.col("x_node").alias("node"), F.col("x_kind").alias("kind"), "o1", F.col("x_ordinal").alias("o2"))
    elements = listed.unionByName(alone).unionByName(filed).unionByName(several)
    place = Window.partitionBy(*KEY, "box").orderBy("o1", "o2")
    elements = elements.withColumn("evidence_pos", F.row_number().over(place) - 1).filter("kind = 'object'")

    named = elements.join(pivot_scalars(nodes, ["entity_id", "source"]), [*KEY, "node"], "left")
    named = named.select(*KEY, "group_id", "evidence_pos", F.coalesce("entity_id", "filed", F.lit("")).alias("entity_id"), F.coalesce("source", F.lit("")).alias("source"), F.col("node").alias("parent"))
    named = scratch.save(named)

    refs = _child(nodes.filter("label = 'refs'"), "r")
    top = scratch.save(named.join(refs, [*KEY, "parent"]).withColumnRenamed("parent", "node"))
    lists = top.filter("r_kind = 'array'").withColumn("parent", F.col("r_node"))
    cells = lists.drop("r_node", "r_label", "r_ordinal", "r_kind", "r_value").join(refs, [*KEY, "parent"]).withColumn("ref_pos", F.col("r_ordinal"))
    ones = top.filter("r_kind in ('string', 'number', 'boolean', 'object')").withColumn("ref_pos", F.lit(0))
    base = [*KEY, "group_id", "evidence_pos", "entity_id", "source"]
    held = cells.select(*base, "node", "ref_pos", "r_node", "r_kind", "r_value").unionByName(ones.select(*base, "node", "ref_pos", "r_node", "r_kind", "r_value"))
    inner = pivot_scalars(nodes, ["ref"]).withColumnRenamed("node", "r_node")
    held = held.join(inner, [*KEY, "r_node"], "left").withColumn("ref", F.when(F.col("r_kind") == "object", F.col("ref")).otherwise(F.col("r_value")))
    rows = scratch.save(held.filter("ref is not null").select(*base, "ref_pos", "ref", F.col("node").alias("held_by")))
    # Whatever the list holds, an element in which no reference stands has the row that says so.
    some = rows.select(*KEY, F.col("held_by").alias("parent")).distinct()
    none = named.join(some, [*KEY, "parent"], "left_anti").select(*base, F.lit(-1).alias("ref_pos"), F.lit("").alias("ref"))
    rows = rows.drop("held_by").unionByName(none)
    return rows.select("record_id", "group_id", F.col("evidence_pos").cast("int"), "entity_id", "source", F.col("ref_pos").cast("int"), "ref").distinct()
