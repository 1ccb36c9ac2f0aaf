"""SQL for the queries of ``problems``, over whole tables."""

_FIRST = """
first AS (
  SELECT * FROM (
    SELECT lower(trim(message_id, ' ' || chr(9))) AS mid, ordinal, nullif(lower(trim(causation_id, ' ' || chr(9))), '') AS cause, artifact_refs, created_at,
           row_number() OVER (PARTITION BY lower(trim(message_id, ' ' || chr(9))) ORDER BY ordinal) AS rn
    FROM message_log
  ) WHERE rn = 1 AND mid <> ''
)"""

_REFS = f"""
WITH {_FIRST},
refs AS (
  SELECT 'message_log.causation_id' AS ref_field, mid AS record_id, cause AS ref_id, ordinal AS seq, created_at AS stamp FROM first WHERE cause IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'message_log.artifact_refs', mid, lower(trim(r, ' ' || chr(9))), NULL, created_at
  FROM (SELECT mid, created_at, unnest(artifact_refs) AS r FROM first) WHERE lower(trim(r, ' ' || chr(9))) <> ''
  UNION ALL
  SELECT DISTINCT 'hero_groups.entity_ids', CAST(record_id AS VARCHAR), lower(trim(r, ' ' || chr(9))), NULL, recorded_at
  FROM (SELECT record_id, recorded_at, unnest(entity_ids) AS r FROM hero_groups) WHERE lower(trim(r, ' ' || chr(9))) <> ''
),
orphans AS (
  SELECT * FROM refs r WHERE ref_field = 'message_log.causation_id'
    AND NOT EXISTS (SELECT 1 FROM first p WHERE p.mid = r.ref_id AND p.ordinal < r.seq)
  UNION ALL
  SELECT * FROM refs r WHERE ref_field = 'message_log.artifact_refs'
    AND NOT EXISTS (SELECT 1 FROM stage_artifact p WHERE lower(trim(p.artifact_ref, ' ' || chr(9))) = r.ref_id AND p.registered_at <= r.stamp AND (p.deleted_at IS NULL OR p.deleted_at > r.stamp))
  UNION ALL
  SELECT * FROM refs r WHERE ref_field = 'hero_groups.entity_ids'
    AND NOT EXISTS (SELECT 1 FROM object_entity p WHERE lower(trim(p.entity_id, ' ' || chr(9))) = r.ref_id AND p.recorded_at <= r.stamp AND (p.retired_at IS NULL OR p.retired_at > r.stamp))
)"""

_TREE = f"""
WITH RECURSIVE {_FIRST},
node AS (SELECT f.mid AS id, p.mid AS parent FROM first f LEFT JOIN first p ON f.cause = p.mid),
down AS (
  SELECT id, id AS root_id, 0 AS depth, id AS path FROM node WHERE parent IS NULL
  UNION ALL
  SELECT n.id, d.root_id, d.depth + 1, d.path || '>' || n.id FROM node n JOIN down d ON n.parent = d.id
),
rest AS (SELECT id, parent FROM node WHERE id NOT IN (SELECT id FROM down)),
reach AS (
  SELECT id, parent AS anc FROM rest
  UNION
  SELECT r.id, x.parent FROM reach r JOIN rest x ON r.anc = x.id
),
looped AS (SELECT id FROM reach WHERE id = anc),
tree AS (
  SELECT id AS message_id, root_id, depth, path FROM down
  UNION ALL
  SELECT r.id, min(r.anc), -1, NULL FROM reach r JOIN looped l ON r.anc = l.id GROUP BY r.id
)"""

SQL = {
    "p2_found": f"{_REFS} SELECT ref_field, record_id, ref_id FROM orphans",
    "p2_report": f"""{_REFS}
SELECT ref_field, strftime(stamp, '%Y-%m') AS period, count(*) FILTER (WHERE o = 0) AS n_refs, count(*) FILTER (WHERE o = 1) AS n_orphans
FROM (SELECT ref_field, stamp, 0 AS o FROM refs UNION ALL SELECT ref_field, stamp, 1 FROM orphans) GROUP BY 1, 2""",
    "p3_found": f"{_TREE} SELECT message_id, root_id, depth FROM tree",
    "p3_paths": f"{_TREE} SELECT message_id, root_id, depth, path FROM tree",
    "p3_descendants": f"""{_TREE}, pairs AS (
  SELECT unnest(string_split(path, '>')) AS message_id, depth, generate_subscripts(string_split(path, '>'), 1) - 1 AS place FROM tree WHERE path IS NOT NULL
)
SELECT message_id, count(*) AS n_descendants, count(*) FILTER (WHERE depth - place = 1) AS n_children, CAST(max(depth - place) AS INTEGER) AS height FROM pairs WHERE place < depth GROUP BY 1""",
    "p5_typed": """
WITH e AS (SELECT record_id, group_id, unnest(member_evidence) AS e, generate_subscripts(member_evidence, 1) - 1 AS evidence_pos FROM hero_groups WHERE group_id IS NOT NULL),
n AS (SELECT record_id, group_id, evidence_pos, coalesce(e.entity_id, '') AS entity_id, coalesce(e.source, '') AS source, e.refs AS refs FROM e WHERE e IS NOT NULL),
r AS (SELECT * EXCLUDE (refs), unnest(refs) AS ref, generate_subscripts(refs, 1) - 1 AS ref_pos FROM n)
SELECT DISTINCT record_id, group_id, CAST(evidence_pos AS INTEGER) AS evidence_pos, entity_id, source, CAST(ref_pos AS INTEGER) AS ref_pos, ref FROM r WHERE ref IS NOT NULL
UNION SELECT record_id, group_id, CAST(evidence_pos AS INTEGER), entity_id, source, -1, '' FROM n WHERE refs IS NULL OR len(list_filter(refs, lambda x: x IS NOT NULL)) = 0""",
}
