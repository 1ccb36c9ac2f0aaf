"""SQL for the queries of ``linkage``, over whole tables."""


def _recall(k: int) -> str:
    return f"""
feat AS (SELECT vec_id, CAST(vec_id % 3 AS INTEGER) AS clip, label, embedding::DOUBLE[] AS v FROM embeddings),
sims AS (
  SELECT x.vec_id AS src, y.vec_id AS dst, x.clip AS src_side, y.clip AS dst_side, round(greatest(0.0, least(1.0, list_cosine_similarity(x.v, y.v))), 6) AS score
  FROM feat x JOIN feat y ON x.label = y.label AND x.clip <> y.clip
),
recall AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst_side ORDER BY score DESC, dst) AS rn FROM sims) WHERE rn <= {k}),
pairs AS (
  SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN src > dst THEN dst_side ELSE src_side END AS a_side, CASE WHEN src > dst THEN src_side ELSE dst_side END AS b_side, score FROM recall
)"""


_PARTS = """
p AS (
  SELECT p_partkey, p_brand, p_size, p_retailprice, CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE p_type END AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE string_split(p_name, ' ')[1] END AS word FROM part
),
cand AS (
  SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_retailprice AS pa, b.p_retailprice AS pb, a.kind AS ka, b.kind AS kb, a.word AS wa, b.word AS wb
  FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
),
scored AS (
  SELECT *, CASE WHEN nk + nw > 0 THEN ((CASE WHEN nk = 1 AND ka = kb THEN 1.0 ELSE 0.0 END) + (CASE WHEN nw = 1 AND wa = wb THEN 1.0 ELSE 0.0 END)) / (nk + nw) END AS agree,
         CASE WHEN pa > 0 AND pb > 0 THEN exp(-abs(ln(pa / pb))) ELSE 0.5 END AS aspect
  FROM (SELECT *, CASE WHEN ka <> 'unknown' AND kb <> 'unknown' THEN 1 ELSE 0 END AS nk, CASE WHEN wa <> 'unknown' AND wb <> 'unknown' THEN 1 ELSE 0 END AS nw FROM cand)
)"""

_BOX = "l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 10 + l_tax * 100 AS x2, l_discount * 100 + 5 AS y2"

SQL = {
    "pair_recall": f"WITH {_recall(3)} SELECT a, b, score FROM pairs",
    "pair_margin_decisions": f"""WITH {_recall(3)},
best AS (
  SELECT p.a, p.b, p.score, p.score - coalesce((SELECT max(q.score) FROM pairs q WHERE q.a = p.a AND q.b_side = p.b_side AND q.b <> p.b), 0.0) AS ma,
         p.score - coalesce((SELECT max(q.score) FROM pairs q WHERE q.b = p.b AND q.a_side = p.a_side AND q.a <> p.a), 0.0) AS mb
  FROM pairs p
)
SELECT a, b, score, round(least(ma, mb), 6) AS margin, CASE WHEN score >= 0.45 AND least(ma, mb) >= 0.02 THEN 'MATCHED' WHEN score >= 0.3 THEN 'SUSPECTED_DUPLICATE' ELSE 'NEW_ENTITY' END AS decision FROM best""",
    "bidirectional_top1": f"WITH {_recall(1)} SELECT x.src AS a, x.dst AS b, x.score FROM recall x JOIN recall y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst",
    "mutual_cap": f"""WITH {_recall(5)}
SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a, b_side ORDER BY score DESC, b) AS ra, row_number() OVER (PARTITION BY b, a_side ORDER BY score DESC, a) AS rb FROM pairs) WHERE ra <= 2 AND rb <= 2""",
    "similarity_components": f"""WITH RECURSIVE {_recall(3)},
link AS (SELECT a AS x, b AS y FROM pairs WHERE score >= 0.4 UNION SELECT b, a FROM pairs WHERE score >= 0.4),
reach AS (SELECT x, x AS y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT x AS vec_id, min(y) AS component FROM reach GROUP BY x""",
    "attribute_score": f"""WITH {_PARTS}
SELECT a, b, round(agree, 6) AS agreement, round(aspect, 6) AS aspect, round(CASE WHEN agree IS NULL THEN aspect ELSE 0.6 * agree + 0.4 * aspect END, 6) AS score FROM scored""",
    "pair_gates": f"""WITH {_PARTS}
SELECT reasons, count(*) AS n_pairs FROM (
  SELECT array_to_string(list_filter([CASE WHEN a % 3 = b % 3 THEN 'SAME_SIDE' END, CASE WHEN least(pa, pb) < 950 THEN 'LOW_QUALITY' END, CASE WHEN nk = 1 AND ka <> kb THEN 'CATEGORY_CONFLICT' END], lambda x: x IS NOT NULL), ',') AS reasons FROM scored
) GROUP BY reasons""",
    "quantile_calibration": """
WITH r AS (
  SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS j FROM orders
)
SELECT x.o_orderkey, round(y.o_totalprice, 2) AS calibrated FROM r x JOIN r y ON x.o_custkey = y.o_custkey AND x.i = y.j""",
    "multiview_similarity": """
WITH v AS (SELECT vec_id // 4 AS g, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.g, a.vec_id AS i, b.vec_id AS j, round(greatest(0.0, least(1.0, list_cosine_similarity(a.v, b.v))), 6) AS s FROM v a JOIN v b ON b.g = a.g + 1),
r AS (SELECT g, avg(m) AS r FROM (SELECT g, i, max(s) AS m FROM s GROUP BY g, i) GROUP BY g),
c AS (SELECT g, avg(m) AS c FROM (SELECT g, j, max(s) AS m FROM s GROUP BY g, j) GROUP BY g),
best AS (SELECT g, i, j, s FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, i, j) AS rn FROM s) WHERE rn = 1),
second AS (SELECT s.g, max(s.s) AS s2 FROM s JOIN best b ON s.g = b.g AND s.i <> b.i AND s.j <> b.j GROUP BY s.g)
SELECT b.g AS entity, b.s AS max_pair, round((r.r + c.c) / 2 + 1e-9, 5) AS chamfer, round(((r.r + c.c) / 2 + CASE WHEN s2 IS NULL THEN b.s ELSE (b.s + s2) / 2 END) / 2 + 1e-9, 5) AS symmetric_top2
FROM best b JOIN r ON b.g = r.g JOIN c ON b.g = c.g LEFT JOIN second t ON b.g = t.g""",
    "weighted_mean_vector": """
SELECT entity, CAST(pos - 1 AS INTEGER) AS pos, round(sum(w * x) / sum(w), 5) + 0.0 AS mean FROM (
  SELECT vec_id // 4 AS entity, vec_id % 3 + 1 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
) GROUP BY entity, pos""",
    "box_geometry": f"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_BOX} FROM lineitem),
n AS (SELECT *, lead(x1) OVER w AS u1, lead(y1) OVER w AS v1, lead(x2) OVER w AS u2, lead(y2) OVER w AS v2 FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
m AS (SELECT *, greatest(least(x2, u2) - greatest(x1, u1), 0.0) * greatest(least(y2, v2) - greatest(y1, v1), 0.0) AS both_, (x2 - x1) * (y2 - y1) AS a1, (u2 - u1) * (v2 - v1) AS a2 FROM n WHERE u1 IS NOT NULL)
SELECT l_orderkey, l_linenumber, l_partkey, round(both_ / (a1 + a2 - both_), 6) AS iou, round(both_ / least(a1, a2), 6) AS iom, round(sqrt(pow((x1 + x2) / 2 - (u1 + u2) / 2, 2) + pow((y1 + y2) / 2 - (v1 + v2) / 2, 2)), 6) AS distance FROM m""",
    "retrieval_metrics": """
WITH f AS (SELECT vec_id, vec_id % 3 = 0 AS q, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS src, a.label AS ls, b.vec_id AS dst, b.label AS ld, round(greatest(0.0, least(1.0, list_cosine_similarity(a.v, b.v))), 6) AS score FROM f a JOIN f b ON a.q AND NOT b.q),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s),
m AS (SELECT src, ls, min(CASE WHEN ls = ld THEN rank END) AS r FROM r GROUP BY src, ls)
SELECT ls AS label, count(*) AS n_queries, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / r, 0.0)), 6) AS mrr FROM m GROUP BY ls""",
    "rank_auc": """
WITH o AS (SELECT o_orderstatus, floor(o_totalprice / 1000) AS s, o_orderpriority = '1-URGENT' AS y FROM orders),
c AS (SELECT o_orderstatus, s, count(*) AS n, count(*) FILTER (WHERE y) AS p FROM o GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o_orderstatus ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS rank FROM c),
t AS (SELECT o_orderstatus, sum(rank * p) AS rs, CAST(sum(p) AS BIGINT) AS np, CAST(sum(n - p) AS BIGINT) AS nn FROM r GROUP BY 1)
SELECT o_orderstatus, np AS n_pos, nn AS n_neg, round((rs - np * (np + 1) / 2.0::DOUBLE) / (np * nn), 6) AS auc FROM t WHERE np > 0 AND nn > 0""",
    "wilson_by_group": """
WITH g AS (SELECT lang, doc_kind, CAST(grouping(doc_kind) AS INTEGER) AS whole_lang, count(*) AS total, count(*) FILTER (WHERE n_chars > 500) AS hits FROM documents GROUP BY GROUPING SETS ((lang, doc_kind), (lang))),
p AS (SELECT *, hits::DOUBLE / total AS p, total::DOUBLE AS n FROM g),
q AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS half FROM p)
SELECT lang, doc_kind, whole_lang, total, hits, round(greatest(0.0, mid - half), 6) AS low, round(least(1.0, mid + half), 6) AS high FROM q""",
    "mcnemar_paired": """
WITH c AS (
  SELECT doc_kind, count(*) FILTER (WHERE n_chars > 600 AND doc_id % 3 <> 0) AS only_x, count(*) FILTER (WHERE n_chars <= 600 AND doc_id % 3 = 0) AS only_y FROM documents GROUP BY 1
),
t AS (SELECT *, unnest(range(0, least(only_x, only_y) + 1)) AS i FROM c WHERE only_x + only_y > 0),
s AS (SELECT doc_kind, least(1.0, 2 * sum(exp(lgamma(only_x + only_y + 1.0) - lgamma(i + 1.0) - lgamma(only_x + only_y - i + 1.0) - (only_x + only_y) * ln(2.0)))) AS p FROM t GROUP BY 1)
SELECT c.doc_kind, only_x, only_y, round(p + 1e-9, 6) AS p FROM c LEFT JOIN s ON c.doc_kind IS NOT DISTINCT FROM s.doc_kind""",
    "nearest_rank_quantiles": """
WITH l AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1)
SELECT o_orderpriority, v[least(len(v) - 1, CAST(floor(len(v) * 0.5) AS BIGINT)) + 1] AS p50, v[least(len(v) - 1, CAST(floor(len(v) * 0.9) AS BIGINT)) + 1] AS p90, v[least(len(v) - 1, CAST(floor(len(v) * 0.99) AS BIGINT)) + 1] AS p99 FROM l""",
    "seed_statistics": "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most, count(value) AS n FROM events GROUP BY 1",
    "array_differences": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
j AS (SELECT a.vec_id, a.v, b.v AS w, list_transform(a.v, lambda x: isfinite(x)) = list_transform(b.v, lambda x: isfinite(x)) AS same_pattern FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1),
u AS (SELECT vec_id, same_pattern, unnest(v) AS p, unnest(w) AS q FROM j), x AS (SELECT vec_id, same_pattern, abs(p - q) AS x FROM u WHERE isfinite(p) AND isfinite(q))
SELECT vec_id, same_pattern, round(max(x), 6) AS max_abs, round(avg(x), 6) AS mean_abs, round(quantile_cont(x, 0.5) + 1e-9, 5) AS p50, round(quantile_cont(x, 0.95) + 1e-9, 5) AS p95, round(quantile_cont(x, 0.99) + 1e-9, 5) AS p99, round(sqrt(avg(x * x)), 6) AS rmse FROM x GROUP BY 1, 2""",
    "ranked_overlap": """
WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT c_mktsegment, o_orderkey AS k, r AS ra FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS r FROM o) WHERE r <= 100),
b AS (SELECT c_mktsegment, o_orderkey AS k, r AS rb FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate DESC, o_orderkey) AS r FROM o) WHERE r <= 100)
SELECT c_mktsegment, count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) AS shared, count(*) FILTER (WHERE ra = rb) AS same_rank, round(count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL)::DOUBLE / count(*), 6) AS jaccard
FROM a FULL JOIN b USING (c_mktsegment, k) GROUP BY 1""",
    "consensus_vote": """
WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
v AS (SELECT user_id, event_type, count(*) AS v FROM events WHERE value >= 2 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER w AS rn, lead(v) OVER w AS second FROM v WINDOW w AS (PARTITION BY user_id ORDER BY v DESC, event_type))
SELECT n.user_id, CASE WHEN v > coalesce(second, 0) AND v >= 0.2 * n THEN event_type END AS consensus, coalesce(v, 0) AS votes, n FROM n LEFT JOIN t ON n.user_id = t.user_id AND t.rn = 1""",
    "majority_label": "SELECT o_custkey, o_orderpriority AS priority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE rn = 1",
    "tri_state_fact": """
WITH e AS (SELECT user_id, coalesce(bool_or(value > 20), false) AS near, coalesce(bool_or(value < 0.5 AND event_type = 'error'), false) AS far FROM events GROUP BY 1)
SELECT user_id, CASE WHEN near AND far THEN 'CONFLICT' WHEN near THEN 'NEAR' WHEN far THEN 'NOT_NEAR' ELSE 'UNKNOWN' END AS fact FROM e""",
    "gap_islands": """
WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us FROM events),
f AS (SELECT *, coalesce(CAST(us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 AS INTEGER), 1) AS fresh FROM e),
g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM f)
SELECT user_id, island, count(*) AS n, CAST(floor((max(us) - min(us)) / 1000000.0) AS BIGINT) AS seconds FROM g GROUP BY 1, 2""",
    "mad_signature": """
WITH m AS (SELECT user_id, event_type, median(value) AS m FROM events GROUP BY 1, 2)
SELECT e.user_id, e.event_type, round(any_value(m), 6) AS median, round(median(abs(value - m)), 6) AS mad, count(*) AS n FROM events e JOIN m ON e.user_id = m.user_id AND e.event_type = m.event_type GROUP BY 1, 2""",
    "linear_trend": """
WITH e AS (SELECT user_id, epoch_us(ts)::DOUBLE / 86400000000 - 19723 AS day, value FROM events)
SELECT user_id, round(regr_slope(value, day), 5) AS slope, round(regr_intercept(value, day), 4) AS start FROM e GROUP BY 1""",
    "representative_row": """
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY value DESC, event_id) AS rn FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)
) WHERE rn = 1""",
    "interleaved_views": """
WITH t AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS turn FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY turn, l_orderkey, l_partkey) AS INTEGER) AS place FROM t""",
    "complete_cover": "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)",
    "stable_category": """
WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, min(n) AS least FROM y WHERE n >= 2 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT y) FROM y)""",
    "constraint_violations": """
SELECT 'lineitem.key_unique' AS rule, count(*) AS n_violations FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'lineitem.order_exists', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'orders.customer_exists', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'documents.lang_known', count(*) FROM documents WHERE coalesce(lang, '') NOT IN ('en', 'zh')
UNION ALL SELECT 'documents.text_present', count(*) FROM documents WHERE text IS NULL OR trim(text, ' ') = ''""",
    "trace_replay": """
WITH l AS (SELECT lower(trim(message_id, ' ' || chr(9))) AS mid, ordinal, lower(trim(causation_id, ' ' || chr(9))) AS cause, lower(trim(correlation_id, ' ' || chr(9))) AS run FROM message_log),
f AS (SELECT mid, min(ordinal) AS first_ FROM l GROUP BY 1)
SELECT nullif(l.run, '') AS run, count(*) AS n_rows, count(*) FILTER (WHERE l.ordinal > o.first_) AS n_again, count(*) FILTER (WHERE l.cause <> '' AND p.first_ IS NULL) AS n_missing, count(*) FILTER (WHERE p.first_ >= o.first_) AS n_later
FROM l JOIN f o ON l.mid = o.mid LEFT JOIN f p ON l.cause = p.mid GROUP BY 1""",
    "vocab_resolution": """
WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM part),
w AS (SELECT DISTINCT p_partkey, unnest(string_split(name, ' ')) AS w FROM p),
a AS (SELECT DISTINCT string_split(name, ' ')[-1] AS w FROM p),
h AS (SELECT p_partkey, count(DISTINCT w.w) AS n, min(w.w) AS alias FROM w JOIN a ON w.w = a.w GROUP BY 1)
SELECT p.p_partkey, CASE WHEN n = 1 THEN alias END AS canonical, coalesce(n, 0) AS n_targets FROM p LEFT JOIN h ON p.p_partkey = h.p_partkey""",
    "tolerant_json": """
WITH x AS (SELECT 'message_log' AS source, payload AS t FROM message_log UNION ALL SELECT 'events', props FROM events),
y AS (SELECT source, t, CASE WHEN json_valid(t) THEN t ->> '$.k' END AS k, CASE WHEN json_valid(t) THEN t ->> '$.action' END AS action FROM x)
SELECT source, count(t) AS n_texts, count(k) AS n_k, CAST(sum(TRY_CAST(k AS BIGINT)) AS BIGINT) AS sum_k, count(*) FILTER (WHERE action IN ('PLACEMENT_READY', 'TASKS_READY', 'ENTITIES_READY')) AS n_known_action FROM y GROUP BY 1""",
    "hash_bucket_split": "SELECT CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT % 8 AS INTEGER) AS bucket, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "entity_id_hash": "SELECT l_orderkey, 'entity_' || substr(sha256(array_to_string(list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))), chr(10))), 1, 12) AS entity_id FROM lineitem GROUP BY 1",
    "leave_last_out": """
WITH l AS (SELECT l_suppkey, l_partkey, l_shipdate = max(l_shipdate) OVER (PARTITION BY l_suppkey) AS last_ FROM lineitem),
p AS (SELECT l_suppkey, l_partkey, count(*) FILTER (WHERE last_) AS t, count(*) FILTER (WHERE NOT last_) AS r FROM l GROUP BY 1, 2)
SELECT l_suppkey, CAST(sum(t) AS BIGINT) AS n_test, CAST(sum(r) AS BIGINT) AS n_train, count(*) FILTER (WHERE t > 0 AND r > 0) AS n_shared_parts FROM p GROUP BY 1""",
    "threshold_sweep": f"""WITH {_PARTS},
g AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (WHERE round(aspect, 6) >= threshold) AS n_pairs, count(*) FILTER (WHERE round(aspect, 6) >= threshold AND wa = wb) AS n_hits,
       round(count(*) FILTER (WHERE round(aspect, 6) >= threshold AND wa = wb)::DOUBLE / count(*) FILTER (WHERE round(aspect, 6) >= threshold), 6) AS precision
FROM scored, g GROUP BY 1""",
    "required_sample_size": """
WITH g AS (SELECT lang, count(*) AS total, count(*) FILTER (WHERE n_chars > 500) AS hits FROM documents GROUP BY 1),
n AS (SELECT lang, hits::DOUBLE / total AS p, unnest(range(1, 20001))::DOUBLE AS x FROM g),
h AS (SELECT lang, x, round(1.96 * sqrt(p * (1 - p) / x + 1.96 * 1.96 / (4 * x * x)) / (1 + 1.96 * 1.96 / x), 9) AS half FROM n)
SELECT lang, CAST(min(CASE WHEN half <= 0.05 THEN x END) AS BIGINT) AS n_needed, CAST(min(CASE WHEN half <= 0.01 THEN x END) AS BIGINT) AS n_needed_01 FROM h GROUP BY 1""",
    "label_reconciliation": """
WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, p_type, p_size FROM part),
e AS (SELECT name, count(DISTINCT p_type) AS n, min(p_type) AS target FROM p WHERE p_size > 25 GROUP BY 1)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'unmapped' WHEN n > 1 THEN 'conflict' ELSE 'mapped' END AS status, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM p LEFT JOIN e ON p.name = e.name""",
    "first_known_value": """
SELECT doc_id, coalesce(lower(substr(lang, 1, 2)), CASE WHEN doc_kind = 'journal' THEN 'en' END, CASE WHEN n_chars < 300 THEN 'zh' END) AS value,
       CASE WHEN lang IS NOT NULL THEN 'lang' WHEN doc_kind = 'journal' THEN 'kind' WHEN n_chars < 300 THEN 'length' END AS source FROM documents""",
    "gate_report": """
WITH m AS (SELECT count(*)::DOUBLE AS n, round(avg(l_discount), 6) AS discount, max(l_quantity) AS quantity, count(*) FILTER (WHERE l_partkey IS NULL)::DOUBLE AS nulls FROM lineitem),
g AS (
  SELECT 'rows' AS gate, n AS value, 1.0::DOUBLE AS low, 1e15::DOUBLE AS high FROM m UNION ALL SELECT 'mean_discount', discount, 0.0, 0.04 FROM m
  UNION ALL SELECT 'quantity', quantity, 1.0, 50.0 FROM m UNION ALL SELECT 'null_parts', nulls, 0.0, 0.0 FROM m
)
SELECT *, value >= low AND value <= high AS passed FROM g""",
    "payload_hashes": """
WITH x AS (SELECT message_type, sha256(payload) = lower(payload_hash) AS same FROM message_log)
SELECT message_type, count(*) FILTER (WHERE same) AS n_same, count(*) FILTER (WHERE NOT same) AS n_other, count(*) FILTER (WHERE same IS NULL) AS n_open FROM x GROUP BY 1""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "partition_check": """
WITH o AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT CASE WHEN l_partkey IS NULL THEN 'none' WHEN p_partkey IS NULL THEN 'unknown' WHEN n = 1 THEN 'one' ELSE 'several' END AS membership, count(*) AS n_parts FROM part FULL JOIN o ON p_partkey = l_partkey GROUP BY 1""",
}
