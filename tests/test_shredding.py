import json

from linkloom.operators import shredding as S


def brute(record, text):
    """The evidence rows by walking the parsed text."""
    out = set()
    try:
        top = json.loads(text) if text else None
    except ValueError:
        return out

    def element(gid, pos, filed, e):
        ent = e.get("entity_id") if e.get("entity_id") is not None else filed
        refs = e.get("refs")
        refs = [] if refs is None else refs if isinstance(refs, list) else [refs]
        head = (record, gid, pos, ent or "", e.get("source") or "")
        refs = [r.get("ref") if isinstance(r, dict) else r for r in refs]
        if all(r is None for r in refs):
            out.add((*head, -1, ""))
        for j, r in enumerate(refs):
            if r is not None:
                out.add((*head, j, str(r)))

    def walk(x):
        if isinstance(x, list):
            for y in x:
                walk(y)
        if not isinstance(x, dict):
            return
        if isinstance(x.get("group_id"), str):
            box = x.get("member_evidence")
            if isinstance(box, str):
                try:
                    box = json.loads(box)
                except ValueError:
                    box = None
            flat = []
            if isinstance(box, list):
                flat = [(None, e) for e in box]
            elif isinstance(box, dict) and any(f in box for f in S.ELEMENT_FIELDS):
                flat = [(None, box)]
            elif isinstance(box, dict):
                flat = [(k, e) for k, v in box.items() for e in (v if isinstance(v, list) else [v])]
            for pos, (filed, e) in enumerate(flat):
                if isinstance(e, dict):
                    element(x["group_id"], pos, filed, e)
        for y in x.values():
            walk(y)

    walk(top)
    return out


TEXTS = [
    '{"group_id": "g1", "member_evidence": [{"entity_id": "e1", "source": "s", "refs": ["a", null, {"ref": "b", "frame": 3}, 7]}, null, {"source": "s"}, {"entity_id": "e", "refs": []}]}',
    '{"group_id": "g2", "member_evidence": {"e1": {"source": "s", "refs": "x"}, "e2": [{"refs": null}, {"refs": ["y"]}], "e3": null, "e4": {"refs": {"ref": "z"}}}}',
    '{"group_id": "g3", "member_evidence": {"entity_id": "e", "refs": ["q"]}}',
    '{"run": {"id": 1}, "group": {"group_id": "g4", "member_evidence": "[{\\"entity_id\\": \\"e\\", \\"refs\\": [\\"k\\"]}]", "sub_groups": [{"group_id": "g4.0", "member_evidence": [{"refs": ["m"]}]}]}}',
    '[{"group_id": "g5", "member_evidence": []}, {"group_id": "g6", "member_evidence": "no json"}, {"group_id": "g7"}]',
    '{"group_id": "g8", "member_evidence": [{"entity_id": "e", "refs": [null]}, {"refs": [{"frame": 1}, null]}, {"refs": [null, "r"]}, {"refs": {"frame": 2}}]}',
    "{broken", "", None, "null", "17", '"text"', "NaN", '{"group_id": "bad", "member_evidence": [{"refs": [NaN]}]}', "[" * 60_000,
]


def test_shapes_against_brute_force(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again")]
    df = spark.createDataFrame(rows, "rid long, body string, node string")
    nodes = S.shred_json(df, "rid", "body", embedded={"member_evidence"}).cache()
    got = [tuple(r) for r in S.evidence_rows(nodes).collect()]
    want = set().union(*(brute(k, t) for k, t in enumerate(TEXTS[:12])))
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r["group_id"]: r["parent_group_id"] for r in S.group_rows(nodes).collect()}
    assert groups["g4.0"] == "g4" and groups["g1"] is None and groups["g7"] is None


def test_domain_tables_against_brute_force(spark, data):
    from linkloom.plans import problems

    raw = spark.read.parquet(f"{data}/raw_groups.parquet").collect()
    groups = spark.read.parquet(f"{data}/hero_groups.parquet").collect()
    want = set().union(*(brute(r["record_id"], r["raw"]) for r in raw))
    want |= set().union(*(brute(r["record_id"], json.dumps({"group_id": r["group_id"], "member_evidence": r.asDict(True)["member_evidence"]})) for r in groups))
    rows = [tuple(r) for r in problems.p5_found(spark, data).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_typed_rows_have_the_nodes_of_their_json(spark):
    e = "array<struct<schema_version string, entity_id string, source string, detail string, refs array<string>>>"
    rows = [(1, "g", [("1", "e", None, "", ["a", None]), None, (None, None, None, None, None), ("2", "f", "s", "d", [])]), (2, "h", None), (3, None, []), (4, "g", [("1", "e", "s", "d", ["x"] * 3000)])]
    df = spark.createDataFrame([(*r, 7) for r in rows + rows[:1]], f"rid long, group_id string, member_evidence {e}, node int")
    typed = S.shred_evidence(df, "rid")
    names = ["schema_version", "entity_id", "source", "detail", "refs"]
    texts = [(k, json.dumps({"group_id": g, "member_evidence": None if m is None else [None if x is None else dict(zip(names, x, strict=True)) for x in m]})) for k, g, m in rows]
    parsed = S.shred_json(spark.createDataFrame(texts, "rid long, t string"), "rid", "t")

    def tree(nodes):
        by = {(r["record_id"], r["node"]): r for r in nodes.collect()}
        up = lambda k, n: () if n < 0 else (*up(k, by[k, n]["parent"]), (by[k, n]["label"], by[k, n]["ordinal"]))
        return sorted((k, up(k, n), r["kind"], r["value"] or "") for (k, n), r in by.items())

    assert tree(typed) == tree(parsed)


def test_adjacency_keeps_links_and_long_texts():
    rows = list(S.adjacency(json.dumps({"a": [1, {"b": "x" * 100_000}], "c": True})))
    assert [(r[1], r[2], r[3], r[4]) for r in rows] == [(-1, "", 0, "object"), (0, "a", 0, "array"), (1, "a", 0, "number"), (1, "a", 1, "object"), (3, "b", 0, "string"), (0, "c", 1, "boolean")]
    assert len(rows[4][5]) == 100_000


def test_empty_table(spark):
    nodes = S.shred_json(spark.createDataFrame([], "r long, t string"), "r", "t")
    assert S.evidence_rows(nodes).count() == 0
