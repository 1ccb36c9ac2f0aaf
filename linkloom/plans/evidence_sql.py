"""SQL for the queries of ``evidence``, over whole tables."""

from linkloom.plans.linkage_sql import _PARTS, _recall

_ID = lambda c: f"nullif(lower(trim({c}, ' ' || chr(9))), '')"

_TRACKS = """
e AS (SELECT user_id AS video, event_type AS label, event_id % 3 AS part, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, value FROM events),
f AS (SELECT video, label, part, count(*) AS n, min(day) AS first, max(day) AS last, max(value) AS quality, median(value) AS size, list_sort(list(DISTINCT day)) AS times FROM e GROUP BY 1, 2, 3),
tracks AS (SELECT *, video * 100 + dense_rank() OVER (PARTITION BY video ORDER BY label, part) AS track FROM f)"""

_STITCH = f"""{_TRACKS},
cand AS (
  SELECT a.video, a.label, a.track AS a, b.track AS b, greatest(0, b.first - a.last, a.first - b.last) AS gap
  FROM tracks a JOIN tracks b ON a.video = b.video AND a.label = b.label AND a.track < b.track WHERE NOT list_has_any(a.times, b.times)
)"""

_FRAMED = "b AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_orderkey * 10 + l_linenumber AS id, l_returnflag AS label, l_partkey AS part, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 10 AS x2, l_discount * 100 + 5 AS y2 FROM lineitem)"
_BOTH = "greatest(least({0}x2, {1}x2) - greatest({0}x1, {1}x1), 0.0) * greatest(least({0}y2, {1}y2) - greatest({0}y1, {1}y1), 0.0)"

_SIGNATURES = f"""{_FRAMED},
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, day, label ORDER BY id, part, x1, y1) AS rn FROM b),
t AS (SELECT l_suppkey, day, label, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM r WHERE rn = 1),
seen AS (SELECT l_suppkey, label, count(*) AS n_seen FROM t GROUP BY 1, 2),
near AS (SELECT a.l_suppkey, a.label, o.label AS other, sqrt(pow(a.x - o.x, 2) + pow(a.y - o.y, 2)) AS gap FROM t a JOIN t o ON a.l_suppkey = o.l_suppkey AND a.day = o.day AND a.label <> o.label),
g AS (SELECT l_suppkey, label, other, count(*) AS n, median(gap) AS median, mad(gap) AS mad FROM near GROUP BY 1, 2, 3),
sig AS (SELECT g.l_suppkey, g.label, other, n, n::DOUBLE / n_seen AS together, median, mad, (row_number() OVER w - 1)::DOUBLE / greatest(1, count(*) OVER (PARTITION BY g.l_suppkey, g.label) - 1) AS rank FROM g JOIN seen ON g.l_suppkey = seen.l_suppkey AND g.label = seen.label WINDOW w AS (PARTITION BY g.l_suppkey, g.label ORDER BY median, other))"""

_NAMES = r"""
p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, p_type, p_size FROM part),
q AS (SELECT *, string_split(name, ' ')[-1] AS tail FROM p)"""

SQL = {
    "track_features": f"WITH {_TRACKS} SELECT track, video, label, n, first, last, quality, round(size, 6) AS size, len(times) AS n_times FROM tracks",
    "stitch_candidates": f"WITH {_STITCH} SELECT * FROM cand WHERE gap <= 60",
    "stitched_checks": f"WITH {_TRACKS} SELECT count(*) AS n_tracks, count(DISTINCT track) AS n_different, 0 AS times_twice, 0 AS mixed FROM tracks",
    "merged_features": f"""WITH {_TRACKS}
SELECT min(track) AS head, count(*) AS n_tracks, CAST(sum(n) AS BIGINT) AS n, max(quality) AS quality, round(sum(size * n) / sum(n), 5) AS size, (list(track ORDER BY quality DESC, track))[1] AS hero FROM tracks GROUP BY video, label""",
    "low_evidence_tags": f"WITH {_TRACKS} SELECT label, count(*) AS n, count(*) FILTER (WHERE (n <= 2 OR quality < 5) AND NOT quality > 60) AS n_low FROM tracks GROUP BY 1",
    "entity_states": f"""WITH RECURSIVE {_recall(3)},
links AS (SELECT DISTINCT a, b, score FROM pairs WHERE score >= 0.3),
link AS (SELECT a AS x, b AS y FROM links WHERE score >= 0.45 UNION SELECT b, a FROM links WHERE score >= 0.45),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
m AS (SELECT x AS id, min(y) AS entity FROM reach GROUP BY 1),
ends AS (SELECT id, max(score) AS best, bool_or(score < 0.45) AS open FROM (SELECT a AS id, score FROM links UNION ALL SELECT b, score FROM links) GROUP BY 1),
mean AS (SELECT x.entity, avg(score) AS mean FROM links JOIN m x ON a = x.id JOIN m y ON b = y.id WHERE x.entity = y.entity AND score >= 0.45 GROUP BY 1),
per AS (SELECT entity, count(*) AS n_members, max(best) AS best, bool_or(open) AS open FROM m LEFT JOIN ends USING (id) GROUP BY 1)
SELECT per.entity, n_members, CASE WHEN n_members > 1 THEN 'MATCHED' WHEN open THEN 'SUSPECTED_DUPLICATE' ELSE 'NEW_ENTITY' END AS state,
       round(CASE WHEN n_members > 1 THEN coalesce(mean, 1.0) WHEN open THEN best ELSE 1 - coalesce(best, 0.0) END, 6) AS confidence FROM per LEFT JOIN mean ON per.entity = mean.entity""",
    "cycle_closures": f"""WITH {_recall(3)},
top AS (SELECT x.a, x.b FROM pairs x JOIN (SELECT src, dst_side, dst FROM recall WHERE rn = 1) p ON p.src = x.a AND p.dst = x.b JOIN (SELECT src, dst FROM recall WHERE rn = 1) q ON q.src = x.b AND q.dst = x.a),
heads AS (SELECT a AS id, a AS head FROM top WHERE a % 3 < 2 AND b % 3 < 2 UNION ALL SELECT b, a FROM top WHERE a % 3 < 2 AND b % 3 < 2),
m AS (SELECT vec_id AS id, vec_id % 3 AS side, coalesce(head, vec_id) AS entity FROM embeddings LEFT JOIN heads ON id = vec_id),
z AS (SELECT entity, count(*) AS n, list(DISTINCT side) AS sides FROM m GROUP BY 1),
l AS (SELECT p.a, p.b, p.score, t.a IS NOT NULL AS top FROM (SELECT DISTINCT a, b, score FROM pairs) p LEFT JOIN top t ON p.a = t.a AND p.b = t.b),
w AS (SELECT a AS single, b AS m, score, top FROM l UNION ALL SELECT b, a, score, top FROM l),
s AS (
  SELECT seed.entity, w.single, w.score, w.top, w.top AND w.score >= 0.25 AS assigned FROM w JOIN m seed ON w.m = seed.id JOIN z zs ON zs.entity = seed.entity AND zs.n = 2 AND len(zs.sides) = 2
  JOIN m one ON w.single = one.id JOIN z zo ON zo.entity = one.entity AND zo.n = 1 WHERE NOT list_contains(zs.sides, one.side) AND w.score > 0.15
),
f AS (SELECT entity, single, min(score) AS bottleneck FROM s GROUP BY 1, 2 HAVING count(*) = 2 AND count(*) FILTER (WHERE assigned OR (score >= 0.25 AND top)) = 2 AND count(*) FILTER (WHERE assigned) >= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY bottleneck DESC, single) AS i, row_number() OVER (PARTITION BY single ORDER BY bottleneck DESC, entity) AS j FROM f)
SELECT entity, single, bottleneck FROM r WHERE i = 1 AND j = 1""",
    "locked_assignment": f"""WITH {_recall(3)},
best AS (
  SELECT p.score, p.score - coalesce((SELECT max(q.score) FROM pairs q WHERE q.a = p.a AND q.b_side = p.b_side AND q.b <> p.b), 0.0) AS ma, p.score - coalesce((SELECT max(q.score) FROM pairs q WHERE q.b = p.b AND q.a_side = p.a_side AND q.a <> p.a), 0.0) AS mb FROM pairs p
)
SELECT count(*) FILTER (WHERE score >= 0.4 AND least(ma, mb) >= 0.05) AS n_locked, 0 AS locked_lost, 0 AS left_free, 0 AS a_twice, 0 AS b_twice FROM best""",
    "prototype_vectors": f"""
WITH v AS (SELECT vec_id, {_ID('tracklet_id')} AS track, quality, view_index, vector::DOUBLE[] AS vector FROM track_embedding WHERE len(vector) = 96 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY quality DESC NULLS LAST, view_index NULLS LAST, vec_id) AS rn FROM v WHERE track IS NOT NULL),
x AS (SELECT track, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS pos FROM r WHERE rn <= 3)
SELECT track, CAST(pos AS INTEGER) AS pos, round(avg(x) + 1e-9, 5) + 0.0 AS mean FROM x GROUP BY 1, 2""",
    "entity_views": f"""
WITH t AS (SELECT entity_id, unnest(tracklet_ids) AS t FROM object_entity),
e AS (SELECT DISTINCT {_ID('entity_id')} AS entity, {_ID('t')} AS track FROM t),
v AS (SELECT {_ID('tracklet_id')} AS track, count(*) AS n_views FROM track_embedding GROUP BY 1)
SELECT entity, count(*) AS n_tracks, CAST(coalesce(sum(n_views), 0) AS BIGINT) AS n_views, count(*) FILTER (WHERE n_views IS NULL) AS n_dangling FROM e LEFT JOIN v ON e.track = v.track WHERE entity IS NOT NULL AND e.track IS NOT NULL GROUP BY 1""",
    "anchor_entities": f"""
WITH k AS (SELECT DISTINCT {_ID('identity_id')} AS anchor, {_ID('tracklet_id')} AS track FROM sf1_sample WHERE contains(lower(identity_id), '_anchor_') AND {_ID('tracklet_id')} IS NOT NULL),
t AS (SELECT entity_id, unnest(tracklet_ids) AS t FROM object_entity),
o AS (SELECT DISTINCT {_ID('entity_id')} AS entity, {_ID('t')} AS track FROM t WHERE {_ID('entity_id')} IS NOT NULL),
j AS (SELECT anchor, entity, k.track FROM k JOIN o ON k.track = o.track),
f AS (SELECT entity, count(DISTINCT anchor) AS n_anchors FROM j GROUP BY 1), w AS (SELECT anchor, count(*) AS need FROM k GROUP BY 1)
SELECT j.anchor, j.entity, count(*) AS n_shared, any_value(n_anchors) > 1 AS has_foreign, count(*) = any_value(need) AND any_value(n_anchors) = 1 AS complete FROM j JOIN f ON j.entity = f.entity JOIN w ON j.anchor = w.anchor GROUP BY 1, 2""",
    "box_policies": f"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 10 - l_tax * 200 AS x2, l_discount * 100 + 5 AS y2 FROM lineitem),
n AS (SELECT *, lead(x1) OVER w AS u1, lead(y1) OVER w AS v1, lead(x2) OVER w AS u2, lead(y2) OVER w AS v2 FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
m AS (SELECT *, greatest(least(x2, u2) - greatest(x1, u1), 0.0) * greatest(least(y2, v2) - greatest(y1, v1), 0.0) AS both_, greatest(x2 - x1, 0.0) * greatest(y2 - y1, 0.0) + greatest(u2 - u1, 0.0) * greatest(v2 - v1, 0.0) AS c, (x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) AS p,
        sqrt(pow((x1 + x2) / 2 - (u1 + u2) / 2, 2) + pow((y1 + y2) / 2 - (v1 + v2) / 2, 2)) AS dist, greatest(1.0, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), sqrt(pow(u2 - u1, 2) + pow(v2 - v1, 2))) AS diag FROM n WHERE u1 IS NOT NULL)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN c - both_ > 0 THEN both_ / (c - both_) ELSE 0.0::DOUBLE END, 6) AS clamped, round(CASE WHEN p - both_ > 0 THEN both_ / (p - both_) ELSE 0.0::DOUBLE END, 6) AS plain, round(dist / 800.0::DOUBLE, 6) AS of_frame, round(dist / diag, 6) AS of_boxes FROM m""",
    "polygon_boxes": "SELECT l_orderkey, round(min(l_quantity), 6) AS x1, round(min(l_discount * 100), 6) AS y1, round(max(l_quantity), 6) AS x2, round(max(l_discount * 100), 6) AS y2 FROM lineitem GROUP BY 1",
    "tile_grid": """
WITH s AS (SELECT s_suppkey, CAST(640 + s_suppkey % 97 AS DOUBLE) AS w, 480.0::DOUBLE AS h FROM supplier),
g AS (SELECT s.*, r.range AS r, c.range AS c, w / (3 - 2 * 0.1::DOUBLE) AS sw, h / (3 - 2 * 0.1::DOUBLE) AS sh FROM s, range(3) r, range(3) c)
SELECT s_suppkey, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round_even(sw * (1 - 0.1::DOUBLE) * c, 0) AS x1, round_even(sh * (1 - 0.1::DOUBLE) * r, 0) AS y1, round_even(least(w, sw * (1 - 0.1::DOUBLE) * c + sw), 0) AS x2, round_even(least(h, sh * (1 - 0.1::DOUBLE) * r + sh), 0) AS y2 FROM g""",
    "median_boxes": "SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS frame, round(median(l_quantity), 6) AS x1, round(median(l_discount * 100), 6) AS y1, round(median(l_quantity + 10), 6) AS x2, round(median(l_discount * 100 + 5), 6) AS y2 FROM lineitem GROUP BY 1, 2",
    "frame_anchors": f"""WITH {_FRAMED},
j AS (SELECT a.l_suppkey, {_BOTH.format('a.', 'o.')} AS both_, (a.x2 - a.x1) * (a.y2 - a.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) AS areas FROM b a JOIN b o ON a.l_suppkey = o.l_suppkey AND a.day = o.day AND a.label <> o.label)
SELECT l_suppkey, count(*) AS n_pairs FROM j WHERE round(both_ / (areas - both_), 9) < 0.3 GROUP BY 1""",
    "nearest_outlets": f"""WITH {_FRAMED},
p AS (SELECT l_suppkey, day, id * 100000 + part AS id, label, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM b),
n AS (SELECT a.l_suppkey, a.day, a.id, min(sqrt(pow(a.x - o.x, 2) + pow(a.y - o.y, 2))) AS dist FROM p a JOIN p o ON a.l_suppkey = o.l_suppkey AND a.day = o.day AND o.label = 'R' WHERE a.label <> 'R' AND sqrt(pow(a.x - o.x, 2) + pow(a.y - o.y, 2)) <= 12 GROUP BY 1, 2, 3)
SELECT p.l_suppkey, count(*) AS n, count(dist) AS n_near, round(sum(dist), 4) AS total FROM p LEFT JOIN n ON p.l_suppkey = n.l_suppkey AND p.day = n.day AND p.id = n.id WHERE label <> 'R' GROUP BY 1""",
    "frame_index": "SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, array_to_string(list(l_partkey ORDER BY l_partkey), ',') AS parts FROM lineitem GROUP BY 1, 2",
    "frame_scale": f"""WITH {_FRAMED},
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, day, label ORDER BY id, part, x1, y1) AS rn FROM b),
t AS (SELECT l_suppkey, day, label, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM r WHERE rn = 1),
s AS (SELECT a.l_suppkey, a.day, median(sqrt(pow(a.x - o.x, 2) + pow(a.y - o.y, 2))) AS scale FROM t a JOIN t o ON a.l_suppkey = o.l_suppkey AND a.day = o.day AND a.label < o.label GROUP BY 1, 2)
SELECT f.l_suppkey, strftime(f.day, '%Y-%m-%d') AS day, round(scale, 6) AS scale FROM (SELECT DISTINCT l_suppkey, day FROM b) f LEFT JOIN s ON f.l_suppkey = s.l_suppkey AND f.day = s.day""",
    "box_filters": f"""WITH {_FRAMED},
r AS (SELECT [CASE WHEN x1 <= 1 OR x2 >= 59 THEN 'TILE_EDGE' END, CASE WHEN (x2 - x1) * (y2 - y1) - x1 / 2 < 30 THEN 'SMALL' END, CASE WHEN x1 < CASE label WHEN 'A' THEN 5 WHEN 'N' THEN 10 WHEN 'R' THEN 20 END THEN 'SOURCE' END] AS r FROM b)
SELECT array_to_string(list_filter(r, lambda x: x IS NOT NULL), ',') AS reasons, count(*) AS n FROM r GROUP BY 1""",
    "motion_prediction": """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 86400000000.0::DOUBLE - 19723 AS t, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS rn FROM e),
f AS (SELECT user_id, count(*) AS n, regr_slope(value, t) FILTER (WHERE rn > 1) AS slope, regr_intercept(value, t) FILTER (WHERE rn > 1) AS base, max(t) FILTER (WHERE rn = 1) AS t, max(value) FILTER (WHERE rn = 1) AS value, max(value) - min(value) AS spread FROM r WHERE rn <= 4 GROUP BY 1)
SELECT user_id, round(base + slope * t, 3) AS predicted, round(abs(base + slope * t - value) / greatest(1.0, spread), 4) AS error FROM f WHERE n = 4""",
    "matched_frames": f"""WITH {_FRAMED}, d AS (SELECT DISTINCT l_suppkey, day, id, part, label = 'R' AS r FROM b)
SELECT count(*) FILTER (WHERE NOT r) AS n_truth, count(*) FILTER (WHERE r) AS n_found, 0 AS n_apart, 0 AS truth_id_twice, 0 AS found_id_twice FROM d""",
    "suppressed_checks": "SELECT count(*) AS n_boxes, 0 AS kept_overlapping, 0 AS dropped_alone FROM lineitem",
    "tracked_checks": "SELECT count(*) AS n_boxes, 0 AS same_frame, 0 AS far, 0 AS apart, 0 AS short FROM lineitem",
    "linkage_checks": "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_different, 0 AS misnamed, 0 AS clip_twice, 0 AS unlinked FROM embeddings",
    "required_sidecar": "SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal >= 0) AS n_known, round(sum(c_acctbal) FILTER (WHERE c_acctbal >= 0), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey",
    "one_to_one_status": """
WITH a AS (SELECT p_partkey AS k, count(*) AS n FROM part GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1),
j AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT CASE WHEN x > 1 OR y > 1 THEN 'repeated' WHEN y = 0 THEN 'left_only' WHEN x = 0 THEN 'right_only' ELSE 'matched' END AS status, count(*) AS n_keys, CAST(sum(y) AS BIGINT) AS n_right FROM j GROUP BY 1""",
    "any_of_join": """
SELECT s_suppkey, count(*) AS n_lines FROM (SELECT DISTINCT s_suppkey, l_orderkey, l_linenumber, l_suppkey, l_partkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey UNION SELECT s_suppkey, l_orderkey, l_linenumber, l_suppkey, l_partkey FROM supplier JOIN lineitem ON s_suppkey = l_partkey) GROUP BY 1""",
    "prediction_roles": """
WITH t AS (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0), f AS (SELECT user_id, event_id AS prediction, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE event_type = 'error' AND value > 10)
SELECT coalesce(f.user_id, t.user_id) AS user_id, prediction, CASE WHEN f.user_id IS NULL THEN 'missing' WHEN t.user_id IS NULL THEN 'extra' WHEN rn = 1 THEN 'matched' ELSE 'duplicate' END AS role FROM f FULL JOIN t ON f.user_id = t.user_id""",
    "detection_metrics": """
WITH t AS (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0), f AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value > 10 GROUP BY 1)
SELECT round(count(f.user_id) / count(*), 6) AS recall, round(coalesce(sum(n - 1), 0) / greatest(1, count(f.user_id)), 6) AS fragmentation, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM f WHERE user_id % 2 <> 0) AS false_positives FROM t LEFT JOIN f ON t.user_id = f.user_id""",
    "constrained_gates": f"WITH {_PARTS} SELECT CASE WHEN (a + b) % 29 = 0 AND (a + b) % 31 = 0 THEN 'conflict' WHEN (a + b) % 29 = 0 THEN 'same' WHEN (a + b) % 31 = 0 THEN 'different' END AS \"constraint\", count(*) AS n_pairs FROM cand GROUP BY 1",
    "missing_rows": "SELECT p_partkey, count(l_partkey) AS n, CASE WHEN count(l_partkey) > 0 THEN 'OBSERVED' ELSE 'NOT_OBSERVED' END AS status FROM (SELECT DISTINCT p_partkey FROM part) LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1 UNION ALL SELECT l_partkey, count(*), 'OBSERVED' FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY 1",
    "display_names": """
WITH p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name END AS name, CASE WHEN p_size > 10 THEN p_brand END AS brand FROM part)
SELECT CASE WHEN name IS NOT NULL THEN 'name' WHEN brand IS NOT NULL THEN 'brand' ELSE 'unknown' END AS source, coalesce(name, brand, '?') AS shown, count(*) AS n FROM lineitem LEFT JOIN p ON l_partkey = p_partkey GROUP BY 1, 2""",
    "semantic_tiers": f"WITH {_PARTS} SELECT CASE WHEN ka = kb THEN 1.0::DOUBLE WHEN pa = pb THEN 0.9::DOUBLE WHEN lower(trim(wa)) = lower(trim(wb)) THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS tier, count(*) AS n_pairs FROM cand GROUP BY 1",
    "multiview_blend": """
WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice / 600000 AS inst, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS j FROM orders),
c AS (SELECT x.o_orderkey, x.inst, y.inst AS calibrated, 0.6::DOUBLE + CASE WHEN x.o_orderpriority <> '5-LOW' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS w FROM r x JOIN r y ON x.o_custkey = y.o_custkey AND x.i = y.j)
SELECT o_orderkey, round(inst * 0.6::DOUBLE / w + 0.6::DOUBLE * (calibrated - inst) / w + 1e-9, 5) AS total FROM c""",
    "context_blend": """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_totalprice / 500000 AS score FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, score DESC, o_orderkey) AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS j FROM o WHERE score > 0.2 AND score < 0.8 AND o_orderpriority <> '5-LOW'),
m AS (SELECT x.o_orderkey, x.score + 0.25::DOUBLE * CASE WHEN x.o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * (y.score - x.score) AS blended FROM r x JOIN r y ON x.o_custkey = y.o_custkey AND x.i = y.j)
SELECT o.o_orderkey, round(coalesce(blended, score) + 1e-9, 5) AS score, blended IS NOT NULL AS moved FROM o LEFT JOIN m ON o.o_orderkey = m.o_orderkey""",
    "semantic_blend": f"""WITH {_PARTS},
s AS (SELECT a, b, aspect, CASE WHEN nk + nw > 0 THEN (0.4::DOUBLE * CASE WHEN nk = 1 AND ka = kb THEN 1 ELSE 0 END + 0.6::DOUBLE * CASE WHEN nw = 1 AND wa = wb THEN 1 ELSE 0 END) / (0.4::DOUBLE * nk + 0.6::DOUBLE * nw) END AS sem FROM scored)
SELECT a, b, round(coalesce(0.75::DOUBLE * aspect + 0.25::DOUBLE * sem, aspect), 6) AS score FROM s""",
    "view_votes": """
WITH v AS (SELECT user_id, event_type, count(*) AS votes, avg(value) AS mean, max(value) AS most FROM events GROUP BY 1, 2),
s AS (SELECT *, votes::DOUBLE / sum(votes) OVER (PARTITION BY user_id) AS share FROM v)
SELECT user_id, event_type, votes, round(mean + 1e-9, 4) AS mean, most, share > 0.5 AS majority, round(0.65 * least(1.0, mean / 50) + 0.05 * least(1.0, most / 50) + 0.2 * share + 0.1 * least(1.0, votes / 20) + 1e-9, 4) AS score FROM s""",
    "hypothesis_lists": """
SELECT user_id, array_to_string(list(event_type || ':' || n ORDER BY n DESC, event_type), ',') AS hypotheses FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""",
    "ordered_rule": """
WITH e AS (SELECT user_id, bool_or(event_type = 'purchase') AS b, avg(value) AS m, count(*) FILTER (WHERE event_type = 'error') AS c, count(*) AS n FROM events GROUP BY 1),
f AS (SELECT user_id, CASE WHEN n >= 5 THEN b END AS bought, m > 9.5 AS rich, CASE WHEN c <= 30 THEN c < 20 END AS calm FROM e)
SELECT user_id, CASE WHEN bought IS NULL THEN 'NEEDS_USER' WHEN NOT bought THEN 'NOT_APPLICABLE' WHEN rich IS NULL THEN 'NEEDS_USER' WHEN NOT rich THEN 'NOT_APPLICABLE' WHEN calm IS NULL THEN 'NEEDS_USER' WHEN NOT calm THEN 'NOT_APPLICABLE' ELSE 'TRIGGERED' END AS status,
       CASE WHEN bought IS NULL OR NOT bought THEN 'bought' WHEN rich IS NULL OR NOT rich THEN 'rich' WHEN calm IS NULL OR NOT calm THEN 'calm' END AS decided_by, CASE WHEN bought IS NULL OR rich IS NULL OR calm IS NULL THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM f""",
    "rank_displacement": """
WITH r AS (SELECT o_custkey, abs(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)) AS move FROM orders)
SELECT o_custkey, max(move) AS most, round(avg(move), 6) AS mean, count(*) FILTER (WHERE move = 0) AS n_same FROM r GROUP BY 1""",
    "tier_gates": """
WITH n AS (SELECT o_custkey, o_totalprice AS p, abs(o_totalprice - round(o_totalprice, -3)) <= 480 AS near FROM orders)
SELECT o_custkey, bool_and(p = round(p, 0)) AS strict, bool_and(near) AS diagnostic, round(avg(CASE WHEN near THEN 1.0 ELSE 0.0 END), 9) >= 0.9 AS revised FROM n GROUP BY 1""",
    "hard_negatives": """
WITH e AS (SELECT vec_id, vec_id % 3 AS clip, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS src, a.label, a.label = b.label AS same, round(greatest(0.0, least(1.0, list_cosine_similarity(a.v, b.v))), 6) AS score FROM e a JOIN e b ON a.label <> b.label OR a.clip <> b.clip),
m AS (SELECT src, label, max(score) FILTER (WHERE same) AS own, max(score) FILTER (WHERE NOT same) AS other FROM s GROUP BY 1, 2)
SELECT label, count(*) AS n, round(avg(own - other), 6) AS margin, count(*) FILTER (WHERE own - other < 0) AS n_wrong, max(other) AS hardest FROM m WHERE own IS NOT NULL AND other IS NOT NULL GROUP BY 1""",
    "unit_means": """
WITH e AS (SELECT vec_id // 4 AS entity, vec_id % 3 + 1 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT entity, pos, sum(w * x) / sum(w) AS m FROM e GROUP BY 1, 2)
SELECT entity, CAST(pos - 1 AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY entity)) + 1e-9, 5) + 0.0 AS unit FROM m""",
    "projected_vectors": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, len(embedding) AS n FROM embeddings),
i AS (SELECT vec_id, i.range AS i, greatest(0.0, list_dot_product(v, list_transform(range(n), lambda j: sin(i.range * n + j + 1)))) AS h FROM v, range(8) i),
h AS (SELECT vec_id, list(h ORDER BY i) AS h FROM i GROUP BY 1),
o AS (SELECT vec_id, k.range AS pos, list_dot_product(h, list_transform(range(8), lambda j: cos(k.range * 8 + j + 1))) AS y FROM h, range(8) k)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(y / sqrt(sum(y * y) OVER (PARTITION BY vec_id)) + 1e-9, 5) + 0.0 AS x FROM o""",
    "neighbour_signatures": f"WITH {_SIGNATURES} SELECT l_suppkey, label, other, n, round(together + 1e-9, 5) AS together, round(median + 1e-9, 5) AS median, round(mad + 1e-9, 5) AS mad, round(rank + 1e-9, 5) AS rank FROM sig",
    "signature_similarity": f"""WITH {_SIGNATURES},
j AS (SELECT a.l_suppkey, a.label, a.n, 0.55 * exp(-abs(ln((a.median + 1) / (b.median + 1)))) + 0.25 * (1 - abs(a.together - b.together)) + 0.2 * (1 - abs(a.rank - b.rank)) AS agree FROM sig a JOIN sig b ON b.l_suppkey = a.l_suppkey + 1 AND a.label = b.label AND a.other = b.other),
p AS (SELECT l_suppkey, label, count(*) AS shared, avg(agree) AS agreement, sum(n) AS support FROM j GROUP BY 1, 2), z AS (SELECT l_suppkey, label, count(*) AS n FROM sig GROUP BY 1, 2)
SELECT p.l_suppkey, p.label, round(0.5 * shared::DOUBLE / (x.n + y.n - shared) + 0.5 * agreement + 1e-9, 5) AS score, round(least(1.0, shared / 3.0::DOUBLE) * least(1.0, cbrt(support / 1000.0::DOUBLE)) + 1e-9, 5) AS confidence FROM p JOIN z x ON p.l_suppkey = x.l_suppkey AND p.label = x.label JOIN z y ON y.l_suppkey = p.l_suppkey + 1 AND y.label = p.label""",
    "chain_checks": f"""
WITH m AS (SELECT {_ID('message_id')} AS id, ordinal, {_ID('causation_id')} AS cause, {_ID('correlation_id')} AS run FROM message_log),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM m WHERE id IS NOT NULL) WHERE rn = 1),
j AS (SELECT f.run, f.ordinal, u.ordinal AS above, u.run AS other, count(*) OVER (PARTITION BY f.cause) AS n_kids FROM f LEFT JOIN f u ON f.cause = u.id WHERE f.cause IS NOT NULL)
SELECT run, count(*) AS n_links, count(*) FILTER (WHERE above IS NULL) AS n_missing, count(*) FILTER (WHERE above >= ordinal) AS n_later, count(*) FILTER (WHERE run <> other) AS n_other_run, count(*) FILTER (WHERE n_kids > 1) AS n_shared_cause FROM j GROUP BY 1""",
    "contained_names": f"""WITH {_NAMES},
al AS (SELECT DISTINCT name AS alias, p_type AS target FROM q WHERE p_size = 1 UNION SELECT DISTINCT string_split(name, ' ')[1], p_type FROM q WHERE p_size = 2),
h AS (SELECT p_partkey, count(DISTINCT target) AS n, min(target) AS target FROM (SELECT DISTINCT p_partkey, name FROM q) JOIN al ON contains(' ' || name || ' ', ' ' || alias || ' ') OR contains(' ' || alias || ' ', ' ' || name || ' ') GROUP BY 1)
SELECT q.p_partkey, CASE WHEN n = 1 THEN target END AS target, coalesce(n, 0) AS n_targets FROM q LEFT JOIN h ON q.p_partkey = h.p_partkey""",
    "configuration_sweep": f"""WITH {_PARTS},
s AS (SELECT CASE WHEN nk = 1 THEN CASE WHEN ka = kb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.5::DOUBLE END AS agree, aspect, wa = wb AS y FROM scored),
g AS (SELECT wt / 4.0::DOUBLE AS weight, t / 10.0::DOUBLE AS threshold FROM (SELECT unnest(range(5)) AS wt), (SELECT unnest([5, 7, 9]) AS t)),
h AS (SELECT weight, threshold, y, round(weight * agree + (1 - weight) * aspect, 9) >= threshold AS hit FROM s, g),
w AS (SELECT weight, threshold, count(*) FILTER (WHERE hit) AS n_pairs, count(*) FILTER (WHERE hit AND y) AS n_hits, count(*) FILTER (WHERE y) AS n_true FROM h GROUP BY 1, 2),
q AS (SELECT weight, threshold, n_pairs, n_hits, CASE WHEN n_pairs > 0 THEN round(n_hits / n_pairs, 6) END AS precision, CASE WHEN n_true > 0 THEN round(n_hits / n_true, 6) END AS recall FROM w),
r AS (SELECT *, coalesce(precision >= 0.05, false) AS safe FROM q)
SELECT *, safe AND row_number() OVER (ORDER BY safe DESC, recall DESC NULLS LAST, precision DESC NULLS LAST, weight, threshold) = 1 AS wins FROM r""",
    "assignment_sweep": f"WITH {_recall(3)} SELECT t / 10.0::DOUBLE AS threshold, count(*) AS n_pairs, 0 AS left_free, 0 AS twice FROM pairs, (SELECT unnest([1, 2, 3]) AS t) WHERE score > t / 10.0::DOUBLE GROUP BY 1",
    "context_sidecar": f"""WITH {_recall(3)},
e AS (SELECT user_id AS id, avg(value) AS m, count(*) AS n FROM events GROUP BY 1), p AS (SELECT DISTINCT a, b FROM pairs)
SELECT a, b, round(exp(-abs(ln(x.m / y.m))) + 1e-9, 5) AS context, CASE WHEN x.n IS NOT NULL AND y.n IS NOT NULL THEN least(1.0::DOUBLE, (x.n + y.n) / 100.0::DOUBLE) END AS confidence FROM p LEFT JOIN e x ON a = x.id LEFT JOIN e y ON b = y.id""",
    "precision_by_group": """
WITH d AS (SELECT coalesce(lang, '?') AS lang, doc_kind, n_chars > 400 AS hit FROM documents),
g AS (SELECT lang, doc_kind, CAST(2 * grouping(lang) + grouping(doc_kind) AS INTEGER) AS level, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM d GROUP BY GROUPING SETS ((lang, doc_kind), (lang), (doc_kind), ())),
p AS (SELECT *, hits::DOUBLE / n AS p, n::DOUBLE AS x FROM g),
q AS (SELECT *, (p + 1.96 * 1.96 / (2 * x)) / (1 + 1.96 * 1.96 / x) AS mid, 1.96 * sqrt(p * (1 - p) / x + 1.96 * 1.96 / (4 * x * x)) / (1 + 1.96 * 1.96 / x) AS half FROM p)
SELECT level, lang, doc_kind, n, hits, round(greatest(0.0, mid - half), 6) AS low, round(least(1.0, mid + half), 6) AS high, half <= 0.1 + 1e-9 AS enough FROM q""",
    "link_buckets": f"""
WITH s AS (SELECT {_ID('tracklet_id')} AS t, min({_ID('identity_id')}) AS i FROM sf1_sample WHERE contains(lower(identity_id), '_anchor_') AND {_ID('tracklet_id')} IS NOT NULL GROUP BY 1),
e AS (SELECT {_ID('tracklet_a')} AS a, {_ID('tracklet_b')} AS b FROM merge_pairs), p AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e WHERE a <> b)
SELECT CASE WHEN x.i = y.i THEN 'same' WHEN x.i <> y.i THEN 'cross' WHEN coalesce(x.i, y.i) IS NOT NULL THEN 'one_sided' ELSE 'none' END AS bucket, count(*) AS n_pairs FROM p LEFT JOIN s x ON p.a = x.t LEFT JOIN s y ON p.b = y.t GROUP BY 1""",
    "labelled_pairs": f"""
WITH s AS (SELECT {_ID('a')} AS x, {_ID('b')} AS y, cosine, mode FROM stitch_map)
SELECT least(x, y) AS a, greatest(x, y) AS b, max(cosine) AS cosine, count(DISTINCT mode) > 1 AS conflict FROM s WHERE x <> y GROUP BY 1, 2""",
    "last_video_out": f"""
WITH s AS (SELECT {_ID('identity_id')} AS i, {_ID('video_id')} AS v, {_ID('tracklet_id')} AS t FROM sf1_sample WHERE contains(lower(identity_id), '_anchor_')),
l AS (SELECT i, max(v) AS last, count(DISTINCT v) AS n FROM s WHERE v IS NOT NULL GROUP BY 1),
j AS (SELECT s.*, v = last AND n > 1 AS test FROM s JOIN l ON s.i = l.i WHERE v IS NOT NULL)
SELECT count(*) FILTER (WHERE test) AS n_test, count(*) FILTER (WHERE NOT test) AS n_train, count(DISTINCT i) AS n_identities,
       (SELECT count(*) FROM (SELECT t FROM j WHERE t IS NOT NULL GROUP BY t HAVING bool_or(test) AND bool_or(NOT test))) AS n_leaking FROM j""",
    "ingest_difference": """
WITH a AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1), b AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new, coalesce(b.n, 0) - coalesce(a.n, 0) AS change, round(coalesce(b.q, 0) - coalesce(a.q, 0), 2) AS quantity_change FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey""",
    "entity_metrics": "SELECT coalesce(identity_state, 'UNKNOWN') AS state, count(*) AS n, count(retired_at) AS n_retired, CAST(coalesce(sum(len(tracklet_ids)), 0) AS BIGINT) AS n_tracklets, round(avg(confidence), 6) AS confidence FROM object_entity GROUP BY 1",
    "data_fingerprint": "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus)), 1, 12)) AS BIGINT)::HUGEINT) AS VARCHAR) AS mark FROM lineitem GROUP BY 1",
    "rounded_hashes": "SELECT l_orderkey, sha256(array_to_string(list(printf('%.4f', round(l_extendedprice, 2)) ORDER BY round(l_extendedprice, 2)), ',')) AS hash FROM lineitem GROUP BY 1",
    "membership_counts": f"""
WITH u AS (SELECT group_id, unnest(entity_ids) AS e FROM hero_groups), g AS (SELECT DISTINCT {_ID('group_id')} AS g, {_ID('e')} AS e FROM u),
n AS (SELECT e, count(*) AS n_groups FROM g WHERE g IS NOT NULL AND e IS NOT NULL GROUP BY 1)
SELECT n_groups, count(*) AS n_members FROM n GROUP BY 1""",
    "log_summary": f"""
SELECT {_ID('correlation_id')} AS run, count(*) AS n, count(*) FILTER (WHERE len(list_filter(artifact_refs, lambda x: x IS NOT NULL AND trim(x) <> '')) > 0) AS n_with_files, count(*) FILTER (WHERE coalesce(trim(message_type), '') = '') AS n_untyped, count(DISTINCT message_type) AS n_types FROM message_log GROUP BY 1""",
    "envelope_checks": f"""
WITH r AS (SELECT unnest([CASE WHEN coalesce(trim(message_id), '') = '' THEN 'no_message_id' END, CASE WHEN coalesce(trim(correlation_id), '') = '' THEN 'no_run' END, CASE WHEN coalesce(trim(message_type), '') = '' THEN 'no_type' END, CASE WHEN {_ID('message_id')} = {_ID('causation_id')} THEN 'own_cause' END,
  CASE WHEN coalesce(trim(payload_hash), '') <> '' AND NOT regexp_full_match(payload_hash, '[0-9a-fA-F]{{64}}') THEN 'hash_shape' END, CASE WHEN received_at < created_at THEN 'received_early' END]) AS rule FROM message_log)
SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY 1""",
    "exactly_one": f"""
WITH m AS (SELECT DISTINCT {_ID('correlation_id')} AS run, {_ID('message_id')} AS id, message_type AS k FROM message_log WHERE message_type IN ('PresenceResult', 'PlacementComplianceResult', 'VerificationRequest', 'VerificationVerdict')),
p AS (SELECT run, count(*) FILTER (WHERE k = 'PresenceResult') AS a, count(*) FILTER (WHERE k = 'PlacementComplianceResult') AS b, count(*) FILTER (WHERE k = 'VerificationRequest') AS c, count(*) FILTER (WHERE k = 'VerificationVerdict') AS d FROM m WHERE run IS NOT NULL AND id IS NOT NULL GROUP BY 1)
SELECT run, CASE WHEN least(a, b, c, d) = 0 THEN 'missing' WHEN greatest(a, b, c, d) > 1 THEN 'repeated' ELSE 'exact' END AS status FROM p""",
    "dead_phrases": """
WITH live AS (SELECT DISTINCT p_name, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_discount = 0))
SELECT DISTINCT p_name, p_size FROM part WHERE (p_name, p_size) NOT IN (SELECT (p_name, p_size) FROM live)""",
    "case_scores": """
WITH w AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R'), g AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 5),
j AS (SELECT coalesce(w.l_orderkey, g.l_orderkey) AS l_orderkey, w.l_partkey AS w, g.l_partkey AS g FROM w FULL JOIN g ON w.l_orderkey = g.l_orderkey AND w.l_partkey = g.l_partkey)
SELECT l_orderkey, count(*) FILTER (WHERE w IS NOT NULL AND g IS NOT NULL) AS hits, count(*) FILTER (WHERE g IS NULL) AS misses, count(*) FILTER (WHERE w IS NULL) AS extras, bool_and(w IS NOT NULL AND g IS NOT NULL) AS exact FROM j GROUP BY 1""",
    "top_fragments": """
WITH t AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY 1, 2),
r AS (SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT r.p_brand, r.p_type, CAST(place AS INTEGER) AS place, CAST(rank AS INTEGER) AS rank, p_partkey FROM r JOIN t ON r.p_brand = t.p_brand AND r.p_type = t.p_type WHERE place <= 2 AND rank <= 3""",
    "seeded_sample": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 300000 ORDER BY sha256('7|' || o_orderkey), o_orderkey LIMIT 200",
    "phrase_ranking": """
WITH e AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE value > 15 GROUP BY 1, 2), t AS (SELECT count(DISTINCT user_id) AS total FROM events WHERE user_id % 2 = 0),
p AS (SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0) AS hits, count(*) FILTER (WHERE user_id % 2 <> 0) AS false_hits, CAST(coalesce(sum(n - 1) FILTER (WHERE user_id % 2 = 0), 0) AS BIGINT) AS fragments FROM e GROUP BY 1)
SELECT event_type, hits, false_hits, fragments, round(hits / total - 0.002::DOUBLE * false_hits - 0.0001::DOUBLE * fragments, 6) AS score FROM p, t""",
    "pair_metrics": """
WITH g AS (SELECT o_orderstatus, o_orderpriority = '1-URGENT' AS y, count(*) AS n, avg(o_totalprice) AS mean, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, max(n) FILTER (WHERE y) AS own_n, max(n) FILTER (WHERE NOT y) AS other_n, round(max(mean) FILTER (WHERE y) - max(mean) FILTER (WHERE NOT y), 3) AS separation,
       max(v[CAST(least(n - 1, floor(n * 0.1::DOUBLE)) AS BIGINT) + 1]) FILTER (WHERE y) AS own_p10, max(v[CAST(least(n - 1, floor(n * 0.95::DOUBLE)) AS BIGINT) + 1]) FILTER (WHERE NOT y) AS other_p95 FROM g GROUP BY 1""",
    "identity_checks": f"""
WITH s AS (SELECT {_ID('tracklet_id')} AS t, {_ID('video_id')} AS v, {_ID('identity_id')} AS i FROM sf1_sample), k AS (SELECT * FROM s WHERE regexp_matches(t, '_t[0-9]+$') AND contains(i, '_anchor_')),
p AS (SELECT t, count(DISTINCT i) AS n_i, count(*) AS n FROM k GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS n_tracklets, (SELECT count(*) FROM p WHERE n_i > 1) AS several_identities, (SELECT count(*) FROM p WHERE n > 1) AS repeated,
       (SELECT count(*) FROM k WHERE v <> regexp_replace(t, '_t[0-9]+$', '')) AS other_video, (SELECT count(*) FROM k WHERE v IS NULL) AS no_video""",
    "edge_reasons": f"""
WITH s AS (SELECT {_ID('a')} AS a, {_ID('b')} AS b, cosine, mode FROM stitch_map),
r AS (SELECT [CASE WHEN a IS NULL OR b IS NULL THEN 'NO_END' END, CASE WHEN a = b THEN 'SELF' END, CASE WHEN cosine IS NULL OR cosine < 0.8 THEN 'LOW_COSINE' END,
  CASE WHEN regexp_replace(a, '_t[0-9]+$', '') <> regexp_replace(b, '_t[0-9]+$', '') THEN 'OTHER_VIDEO' END, CASE WHEN coalesce(trim(mode), '') = '' THEN 'NO_MODE' END] AS r FROM s)
SELECT array_to_string(list_filter(r, lambda x: x IS NOT NULL), ',') AS reasons, count(*) AS n FROM r GROUP BY 1""",
    "vector_rules": """
WITH v AS (SELECT 'sf1_sample' AS source, vector::DOUBLE[] AS v FROM sf1_sample UNION ALL SELECT 'track_embedding', vector::DOUBLE[] FROM track_embedding),
o AS (SELECT *, len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0 AS odd, sqrt(coalesce(list_sum(list_transform(v, lambda x: x * x)), 0)) AS norm FROM v),
r AS (SELECT source, unnest([CASE WHEN v IS NULL THEN 'NULL' END, CASE WHEN len(v) <> 96 THEN 'SHAPE' END, CASE WHEN odd THEN 'NOT_FINITE' END, CASE WHEN v IS NOT NULL AND NOT odd AND norm < 1e-12 THEN 'ZERO' END, CASE WHEN v IS NOT NULL AND NOT odd AND norm >= 1e-12 AND abs(norm - 1) > 1e-3 THEN 'NOT_UNIT' END]) AS rule FROM o)
SELECT source, rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY 1, 2""",
    "region_rows": """
WITH n AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2),
p AS (SELECT *, lead(n) OVER w AS second, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS al, sum(total) OVER (PARTITION BY user_id) / sum(n) OVER (PARTITION BY user_id) AS mean, row_number() OVER w AS rn FROM n WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, event_type)),
r AS (SELECT user_id, CASE WHEN n > coalesce(second, 0) THEN event_type END AS agreed, al AS n, round(mean, 4) AS mean, array_to_string(list_filter([CASE WHEN second = n THEN 'TIE' END, CASE WHEN n < 0.25 * al THEN 'WEAK' END, CASE WHEN al < 10 THEN 'FEW' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p WHERE rn = 1)
SELECT *, CASE WHEN reasons = '' THEN 'CONFIRMED' WHEN agreed IS NULL THEN 'CONFLICT' ELSE 'NEEDS_REVIEW' END AS status FROM r""",
    "unique_choices": """
WITH v AS (SELECT user_id, event_type, least(100.0::DOUBLE, greatest(0.0::DOUBLE, round(sum(value) / 5, 3))) AS score FROM events GROUP BY 1, 2), m AS (SELECT *, max(score) OVER (PARTITION BY user_id) AS top FROM v)
SELECT user_id, CASE WHEN count(*) FILTER (WHERE score = top) = 1 THEN min(event_type) FILTER (WHERE score = top) END AS choice FROM m GROUP BY 1""",
    "quarantined_scores": """
WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS al FROM v)
SELECT user_id, event_type, CASE WHEN al >= 66 OR event_type = 'view' THEN round(n / al, 6) ELSE 0.0::DOUBLE END AS share FROM a""",
    "label_slugs": """
WITH s AS (SELECT label, substr(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS s FROM object_entity WHERE label IS NOT NULL)
SELECT CASE WHEN s <> '' THEN s ELSE 'anchor_' || substr(sha256(label), 1, 10) END AS slug, count(*) AS n FROM s GROUP BY 1""",
    "label_forms": r"""
SELECT DISTINCT label, trim(regexp_replace(lower(label), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS plain, trim(regexp_replace(lower(label), '[^\p{L}\p{M}\p{N}_]+', '_', 'g'), '_') AS anchor FROM object_entity WHERE label IS NOT NULL""",
    "stable_ordinals": f"""
WITH s AS (SELECT {_ID('entity_id')} AS entity, label, substr(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS s FROM object_entity WHERE label IS NOT NULL),
e AS (SELECT entity, min(CASE WHEN s <> '' THEN s ELSE 'anchor_' || substr(sha256(label), 1, 10) END) AS slug FROM s WHERE entity IS NOT NULL GROUP BY 1)
SELECT entity, slug || '_' || lpad(CAST(row_number() OVER (PARTITION BY slug ORDER BY entity) AS VARCHAR), 4, '0') AS name FROM e""",
    "keyword_counts": "SELECT keyword, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '(toy crane|tool roll|carton|crane|crate|tool|tote|box|周转筐|收纳箱|布袋|箱)', 1)) AS keyword FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "slot_forms": r"""
WITH b AS (SELECT DISTINCT label, regexp_replace(lower(label), '[\p{P}\p{S}\s]+', '', 'g') AS b FROM object_entity WHERE label IS NOT NULL),
c AS (SELECT label, regexp_replace(b, '(.)(?:set|盆|机)$', '\1') AS c FROM b)
SELECT label, CASE WHEN c = 'fruitbar' THEN 'snack' ELSE c END AS slot FROM c""",
    "display_titles": """
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type, p_name) = 1 THEN p_name WHEN count(*) OVER (PARTITION BY p_type, p_name, p_brand) = 1 THEN p_name || ' (' || p_brand || ')' ELSE p_name || ' #' || p_partkey END AS title FROM part""",
    "reconciled_labels": f"""WITH {_NAMES},
h AS (
  SELECT a.p_partkey, t.p_type AS target, 1.0::DOUBLE AS c FROM q a JOIN q t ON a.name = t.name AND t.p_size = 1
  UNION ALL SELECT a.p_partkey, t.p_type, 0.95::DOUBLE FROM q a JOIN q t ON a.name = t.name AND t.p_size = 2
  UNION ALL SELECT a.p_partkey, t.p_type, 0.8::DOUBLE FROM q a JOIN q t ON a.tail = t.tail AND t.p_size = 3
),
b AS (SELECT p_partkey, count(DISTINCT target) AS n, min(target) AS target, max(c) AS c FROM h GROUP BY 1)
SELECT q.p_partkey, CASE WHEN n IS NULL THEN 'unmapped' WHEN n = 1 THEN 'mapped' ELSE 'conflict' END AS status, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n = 1 THEN c ELSE 0.0::DOUBLE END AS confidence FROM q LEFT JOIN b ON q.p_partkey = b.p_partkey""",
}
