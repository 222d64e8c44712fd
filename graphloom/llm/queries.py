"""The pN_ queries, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import p1_history_dedup, p2_pii, p3_neighbours, p4_rank, p5_near_duplicates, p6_components, p7_clusters, p8_tokenize, p9_leakage, p10_residue
from graphloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_history_dedup.repeated_items(table(spark, d, "store_batch"), table(spark, d, "store_request"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pii.find(table(spark, d, "entity"), "id", ["content", "metadata"])


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    return p2_pii.redact(table(spark, d, "entity"), "id", ["content", "metadata"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_neighbours.neighbours(table(spark, d, "store_request")).select("id", "neighbour_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_rank.ranked_results(table(spark, d, "search_result"), table(spark, d, "entity"), 3).select("query_id", "id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_near_duplicates.near_duplicates(table(spark, d, "entity"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return p5_near_duplicates.near_duplicate_groups(table(spark, d, "entity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_components.match_groups(table(spark, d, "link_detail"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_clusters.Forest(table(spark, d, "store_request")).flat()


def p7_clusters_described(spark: SparkSession, d: str) -> DataFrame:
    return p7_clusters.clusters(table(spark, d, "store_request"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return p8_tokenize.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return p9_leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_residue.residue(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_masked, p3_found, p4_found, p5_found, p5_groups, p6_found, p7_found, p7_clusters_described, p8_ids, p9_found, p9_clean, p10_found)}

#: SQL on whole tables where it is feasible.
ORACLES: dict[str, str] = {}
ORACLES["p6_found"] = r"""
WITH RECURSIVE m AS (
  SELECT trim(source_id, E' \t\n\r') AS a, trim(target_id, E' \t\n\r') AS b FROM link_detail
  WHERE lower(regexp_replace(rel_type, '[\s_]+', '', 'g')) = 'relatedto'),
e AS (SELECT a, b FROM m WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM m WHERE a <> '' AND b <> '' AND a <> b),
r AS (SELECT a AS id, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id)
SELECT id, min(g) AS group_id FROM r GROUP BY id
"""
ORACLES["p9_found"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
ew AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item WHERE text IS NOT NULL),
dg AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12),
eg AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM ew WHERE len(w) >= 12)
SELECT DISTINCT d.doc_id, e.item_id
FROM (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM dg) d
JOIN (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM eg) e ON d.g = e.g
"""
ORACLES["p5_found"] = r"""
WITH t AS (SELECT DISTINCT id, list_sort(list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'))) AS w FROM entity WHERE id IS NOT NULL AND content IS NOT NULL),
s AS (SELECT w, row_number() OVER () AS sid FROM (SELECT DISTINCT w FROM t WHERE len(w) > 0)),
m AS (SELECT t.id, s.sid FROM t JOIN s ON t.w = s.w),
x AS (SELECT sid, len(w) AS n, unnest(w) AS tok FROM s),
f AS (SELECT tok, count(*) AS c FROM x GROUP BY tok),
o AS (SELECT x.sid, x.n, x.tok, row_number() OVER (PARTITION BY x.sid ORDER BY f.c, x.tok) AS r FROM x JOIN f USING (tok)),
p AS (SELECT sid, n, tok FROM o WHERE r <= n - ceil(0.7 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.sid AS a, b.sid AS b FROM p a JOIN p b ON a.tok = b.tok AND a.sid < b.sid AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9),
l AS (SELECT c.a, c.b, len(list_intersect(sa.w, sb.w)) AS i, len(sa.w) + len(sb.w) AS n FROM c JOIN s sa ON sa.sid = c.a JOIN s sb ON sb.sid = c.b),
g AS (SELECT a, b FROM l WHERE i >= 0.7 * (n - i) - 1e-9 UNION ALL SELECT sid, sid FROM s)
SELECT DISTINCT least(ma.id, mb.id) AS id_a, greatest(ma.id, mb.id) AS id_b
FROM g JOIN m ma ON ma.sid = g.a JOIN m mb ON mb.sid = g.b WHERE ma.id <> mb.id
"""
_USABLE = r"""u AS (SELECT id, embedding::DOUBLE[] AS v, received_at FROM store_request WHERE id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
o AS (SELECT id, v FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at IS NULL, received_at, v) = 1),
s AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 12) AS c FROM o a JOIN o b ON a.id <> b.id)"""
ORACLES["p3_found"] = f"""
WITH {_USABLE}
SELECT id, other AS neighbour_id FROM s WHERE c >= 0.68 QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, other) <= 5
"""
ORACLES["p7_found"] = f"""
WITH RECURSIVE {_USABLE},
e AS (SELECT id, other FROM s WHERE c >= 0.68),
r AS (SELECT id, id AS g FROM o UNION SELECT e.other, r.g FROM r JOIN e ON e.id = r.id),
l AS (SELECT id, min(g) AS cluster_id FROM r GROUP BY id)
SELECT cluster_id, id FROM l WHERE cluster_id IN (SELECT cluster_id FROM l GROUP BY 1 HAVING count(*) >= 6)
"""
ORACLES["p1_found"] = r"""
WITH b AS (SELECT batch_id, entities FROM store_batch WHERE batch_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY received_at NULLS LAST) = 1),
i AS (SELECT batch_id, unnest(range(0, len(entities)))::BIGINT AS pos, unnest(entities).content AS t FROM b),
w AS (SELECT batch_id, pos, list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS w FROM i WHERE t IS NOT NULL),
h AS (SELECT DISTINCT -1::BIGINT AS batch_id, -1::BIGINT AS pos, list_sort(list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'))) AS w FROM store_request WHERE content IS NOT NULL),
x AS (SELECT * FROM h WHERE len(w) > 0 UNION ALL SELECT * FROM w WHERE len(w) > 0)
SELECT DISTINCT w.batch_id, w.pos FROM w JOIN x ON (x.batch_id, x.pos) < (w.batch_id, w.pos) AND len(x.w) >= 0.7 * len(w.w) - 1e-9 AND len(w.w) >= 0.7 * len(x.w) - 1e-9
WHERE len(w.w) > 0 AND len(list_intersect(w.w, x.w)) >= 0.7 * (len(w.w) + len(x.w) - len(list_intersect(w.w, x.w))) - 1e-9
"""
