"""Queries over the driver's tables seen as a graph, each with SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, memory, search
from graphloom.plans.engine import Engine
from graphloom.runtime import table
from graphloom.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Node tables: label, table, key; relationship tables: name, table, ends, their columns, properties, edge id.
NODES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Orders": ("orders", "o_orderkey"), "Document": ("documents", "doc_id"), "Event": ("events", "event_id")}
RELS: dict[str, tuple] = {
    "IN_REGION": ("nation", "Nation", "Region", "n_nationkey", "n_regionkey", [], "n_nationkey"),
    "CUSTOMER_OF": ("customer", "Customer", "Nation", "c_custkey", "c_nationkey", [], "c_custkey"),
    "SUPPLIER_OF": ("supplier", "Supplier", "Nation", "s_suppkey", "s_nationkey", [], "s_suppkey"),
    "PLACED": ("orders", "Customer", "Orders", "o_custkey", "o_orderkey", ["o_orderdate"], "o_orderkey"),
    "CONTAINS_PART": ("lineitem", "Orders", "Part", "l_orderkey", "l_partkey", None, lambda: F.col("l_orderkey") * 1000 + F.col("l_linenumber")),
    "SUPPLIED_BY": ("lineitem", "Part", "Supplier", "l_partkey", "l_suppkey", [], None),
    "NEXT": ("nation", "Nation", "Nation", "n_nationkey", "to", [], lambda: F.col("n_nationkey") * 100 + F.col("to")),
    "LINKED": ("link_detail", "Entity", "Entity", "_src", "_dst", [], None),
}


def engine(spark: SparkSession, d: str, text: str | None = None) -> Engine:
    """The graph of the driver's tables; with ``text`` only the labels it names (and their ends) are opened."""
    e = Engine(spark)
    named = None if text is None else set(re.findall(r"\w+", text))
    rels = [r for r in RELS if named is None or r in named]
    ends = {x for r in rels for x in RELS[r][1:3]}
    for name, (source, key) in NODES.items():
        if named is None or name in named or name in ends:
            e.register_node(name, table(spark, d, source), key)
    if (named is not None and "Entity" in named) or "Entity" in ends:
        e.register_node("Entity", table(spark, d, "entity").select(F.trim("id").alias("id")).where("id <> ''").distinct(), "id")
    for name in rels:
        source, src, dst, a, b, props, eid = RELS[name]
        df = table(spark, d, source)
        if name == "NEXT":
            df = df.withColumn("to", F.pmod(F.col(a) * 3 + 1, F.lit(25)).cast("int")).unionByName(df.withColumn("to", F.pmod(F.col(a) + 7, F.lit(25)).cast("int")))
        elif name == "SUPPLIED_BY":
            df = df.select(a, b).distinct()
        elif name == "LINKED":
            df = links(spark, d)
        e.register_rel(name, df, src, dst, a, b, df.columns if props is None else props, eid() if callable(eid) else eid)
    return e


def add(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return engine(spark, d, text).cypher(text)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, sql


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 1000 RETURN c.c_mktsegment AS segment, count(*) AS n, ROUND(sum(o.o_totalprice)) AS total ORDER BY total DESC LIMIT 5"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, FLAGSHIP).cypher(FLAGSHIP)


add("flagship_segments", FLAGSHIP, "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice)) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY total DESC LIMIT 5")
# scans, filters, projections
add("scan_filter", "MATCH (p:Part) WHERE p.p_size >= 40 AND NOT p.p_brand = 'Brand#11' AND (p.p_retailprice < 1500 OR p.p_size = 50) RETURN p.p_partkey AS k, p.p_size AS size", "SELECT p_partkey AS k, p_size AS size FROM part WHERE p_size >= 40 AND NOT p_brand = 'Brand#11' AND (p_retailprice < 1500 OR p_size = 50)")
add("key_lookup", "MATCH (o:Orders {o_orderkey: 7}) RETURN o.o_orderkey AS k, o.o_orderstatus AS s", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey = 7")
add("dummy_row", "RETURN 7 / 2 AS a, 7 % 4 AS b, 1 / 0 IS NULL AS c, 2 + 3 * 4 AS d, -7 / 2 AS e", "SELECT 3::BIGINT AS a, 3::BIGINT AS b, TRUE AS c, 14::BIGINT AS d, -3::BIGINT AS e")
add("rel_count", "MATCH ()-[r:CONTAINS_PART]->() RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
add("return_star", "MATCH (n:Nation) RETURN *", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
add("predicates", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_acctbal > 0 XOR c.c_nationkey < 10 AS x, c.c_nationkey IN [1, 2, 3] AS i, NOT c.c_nationkey IN [4, 5] AS ni, c.c_name STARTS WITH 'Cust' AS s, c.c_name ENDS WITH '7' AS e, c.c_mktsegment CONTAINS 'BUIL' AS h, c.c_name IS NOT NULL AS nn", "SELECT c_custkey AS k, (c_acctbal > 0) <> (c_nationkey < 10) AS x, c_nationkey IN (1, 2, 3) AS i, c_nationkey NOT IN (4, 5) AS ni, starts_with(c_name, 'Cust') AS s, suffix(c_name, '7') AS e, contains(c_mktsegment, 'BUIL') AS h, c_name IS NOT NULL AS nn FROM customer")
add("case_when", "MATCH (p:Part) RETURN p.p_partkey AS k, CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'middle' ELSE 'large' END AS c, CASE p.p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS m", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS c, CASE p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS m FROM part")
add("cast_extract", "MATCH (o:Orders) RETURN o.o_orderkey AS k, CAST(o.o_totalprice AS STRING) IS NOT NULL AS s, CAST('x' AS INT64) IS NULL AS bad, EXTRACT(YEAR FROM o.o_orderdate) AS y, EXTRACT(QUARTER FROM o.o_orderdate) AS q, EXTRACT(DOY FROM o.o_orderdate) AS doy", "SELECT o_orderkey AS k, TRUE AS s, TRUE AS bad, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy FROM orders")
add("quantifiers", "MATCH (n:Nation) RETURN n.n_nationkey AS k, ALL(x IN RANGE(1, n.n_regionkey) WHERE x < 3) AS a, ANY(x IN RANGE(1, n.n_regionkey) WHERE x = 2) AS b, NONE(x IN RANGE(1, n.n_regionkey) WHERE x > 3) AS c, SINGLE(x IN RANGE(1, n.n_regionkey) WHERE x > 2) AS d", "SELECT n_nationkey AS k, n_regionkey < 3 AS a, n_regionkey >= 2 AS b, n_regionkey <= 3 AS c, n_regionkey = 3 AS d FROM nation")
add("subscripts", "UNWIND [[1, 2, 3, 4], [5, 6]] AS l RETURN l[0] AS a, l[-1] AS b, l[9] IS NULL AS c, SIZE(l[2..3]) AS d, LIST_SUM(l) AS s", "SELECT l[1] AS a, l[-1] AS b, l[10] IS NULL AS c, len(l[2:3]) AS d, list_sum(l)::DOUBLE AS s FROM (SELECT unnest([[1::BIGINT, 2, 3, 4], [5::BIGINT, 6]]) AS l)")
# joins and patterns
add("two_hops", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:CUSTOMER_OF]-(c:Customer) RETURN r.r_name AS region, count(*) AS n, ROUND(avg(c.c_acctbal)) AS bal", "SELECT r_name AS region, count(*) AS n, round(avg(c_acctbal)) AS bal FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
add("four_hops", "MATCH (c:Customer)-[:PLACED]->(o:Orders)-[l:CONTAINS_PART]->(p:Part) WHERE l.l_quantity > 45 AND p.p_size < 5 RETURN c.c_mktsegment AS seg, p.p_brand AS brand, count(*) AS n, ROUND(sum(l.l_extendedprice)) AS total", "SELECT c_mktsegment AS seg, p_brand AS brand, count(*) AS n, round(sum(l_extendedprice)) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45 AND p_size < 5 GROUP BY 1, 2")
add("either_direction", "MATCH (a:Nation)-[r:NEXT]-(b:Nation) RETURN a.n_nationkey AS a, count(*) AS n", "WITH e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS d FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation), b AS (SELECT s, d FROM e UNION ALL SELECT d, s FROM e WHERE s <> d) SELECT s AS a, count(*) AS n FROM b GROUP BY s")
add("unique_rels_all", "MATCH (a:Part)<-[x:CONTAINS_PART]-(o:Orders)-[y:CONTAINS_PART]->(b:Part) RETURN o.o_orderkey AS k, count(*) AS n", "SELECT x.l_orderkey AS k, count(*) AS n FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND (x.l_linenumber <> y.l_linenumber) WHERE x.l_orderkey IN (SELECT o_orderkey FROM orders) AND x.l_partkey IN (SELECT p_partkey FROM part) AND y.l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1")
add("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 200000 RETURN c.c_custkey AS k, count(o.o_orderkey) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1")
add("exists_semi", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_orderstatus = 'F' AND o.o_totalprice > c.c_acctbal } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > c_acctbal)")
add("exists_anti", "MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 200000 } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
add("count_subquery", "MATCH (n:Nation) RETURN n.n_nationkey AS k, COUNT { MATCH (n)<-[:CUSTOMER_OF]-(c:Customer) WHERE c.c_acctbal > 5000 } AS n", "SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AS n FROM nation")
add("second_match", "MATCH (n:Nation) MATCH (n)<-[:SUPPLIER_OF]-(s:Supplier) RETURN n.n_name AS nation, max(s.s_acctbal) AS best", "SELECT n_name AS nation, max(s_acctbal) AS best FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
add("comma_cross", "MATCH (a:Region), (b:Region) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
add("shared_nation", "MATCH (c:Customer)-[:CUSTOMER_OF]->(n:Nation), (s:Supplier)-[:SUPPLIER_OF]->(n) WHERE c.c_acctbal > 9000 AND s.s_acctbal > 9000 RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal > 9000 AND s_acctbal > 9000 GROUP BY 1")
# aggregates
add("aggregates", "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(*) AS n, count(DISTINCT c.c_nationkey) AS nations, ROUND(sum(c.c_acctbal)) AS s, ROUND(avg(c.c_acctbal)) AS a, min(c.c_acctbal) AS lo, max(c.c_name) AS hi, ROUND(stddev(c.c_acctbal)) AS sd, ROUND(stddev_samp(c.c_acctbal)) AS ss, ROUND(SQRT(var_pop(c.c_acctbal))) AS v, ROUND(median(c.c_acctbal)) AS m", "SELECT c_mktsegment AS seg, count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(sum(c_acctbal)) AS s, round(avg(c_acctbal)) AS a, min(c_acctbal) AS lo, max(c_name) AS hi, round(stddev_pop(c_acctbal)) AS sd, round(stddev_samp(c_acctbal)) AS ss, round(sqrt(var_pop(c_acctbal))) AS v, round(median(c_acctbal)) AS m FROM customer GROUP BY 1")
add("collecting", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, ARRAY_SIZE(collect(n.n_name)) AS n, group_concat(n.n_name) AS names, sum(DISTINCT n.n_regionkey) AS d", "SELECT r_name AS region, count(*) AS n, string_agg(n_name, ', ' ORDER BY n_name) AS names, sum(DISTINCT n_regionkey)::BIGINT AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("having", "MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, count(*) AS n, sum(o.o_totalprice) AS total WHERE n > 15 RETURN c.c_name AS name, n, ROUND(total) AS total", "SELECT c_name AS name, count(*) AS n, round(sum(o_totalprice)) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15")
add("aggregate_expression", "MATCH (o:Orders) RETURN o.o_orderstatus AS s, 1 + count(*) AS n, ROUND(sum(o.o_totalprice) / count(*)) AS a", "SELECT o_orderstatus AS s, 1 + count(*) AS n, round(sum(o_totalprice) / count(*)) AS a FROM orders GROUP BY 1")
add("global_empty", "MATCH (p:Part) WHERE p.p_size > 1000 RETURN count(*) AS n, max(p.p_size) IS NULL AS m", "SELECT count(*) AS n, max(p_size) IS NULL AS m FROM part WHERE p_size > 1000")
# sorting, unnesting, sets
add("distinct_rows", "MATCH (o:Orders) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
add("top_k", "MATCH (o:Orders) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY o.o_totalprice DESC, o.o_orderkey SKIP 10 LIMIT 25", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 10")
add("unwind", "MATCH (n:Nation) UNWIND [n.n_nationkey, n.n_regionkey] AS x RETURN x, count(*) AS n", "SELECT x, count(*) AS n FROM (SELECT unnest([n_nationkey, n_regionkey]) AS x FROM nation) GROUP BY 1")
add("unwind_struct", "UNWIND [{a: 1, b: 'x'}, {a: 2, b: 'y'}] AS row RETURN row.a AS a, row.b AS b", "SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, 'y'")
add("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("union_all", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
# functions
add("string_functions", "MATCH (p:Part) RETURN p.p_partkey AS k, UPPER(p.p_name) AS u, LOWER(p.p_type) AS l, REVERSE(p.p_brand) AS r, LENGTH(p.p_name) AS n, CONCAT(p.p_brand, '-', NULL, p.p_size) AS c, SUBSTRING(p.p_name, 2, 4) AS s, REPLACE(p.p_name, 'a', 'b') AS rp, LEFT(p.p_name, 3) AS lf, RIGHT(p.p_name, 3) AS rt, REPEAT(p.p_brand, 2) AS rep, SPLIT_PART(p.p_name, ' ', 1) AS sp, LPAD(p.p_brand, 12, '*') AS lp, RPAD(p.p_brand, 12, '*') AS rpd, CONCAT_WS('/', p.p_brand, p.p_type) AS cw, TRIM('  x ') AS t, LEVENSHTEIN(p.p_brand, 'Brand#12') AS lev, REGEXP_MATCH(p.p_name, '[0-9]+') AS rm, REGEXP_REPLACE(p.p_brand, '[0-9]', '') AS rr, REGEXP_EXTRACT(p.p_brand, '[0-9]+') AS re, MD5(p.p_name) AS md, SHA256(p.p_name) AS sh, TO_HEX(p.p_size) AS hx, FROM_HEX('ff') AS fh", "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_type) AS l, reverse(p_brand) AS r, strlen(p_name) AS n, concat(p_brand, '-', NULL, p_size) AS c, substring(p_name, 3, 4) AS s, replace(p_name, 'a', 'b') AS rp, left(p_name, 3) AS lf, right(p_name, 3) AS rt, repeat(p_brand, 2) AS rep, split_part(p_name, ' ', 1) AS sp, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rpd, concat_ws('/', p_brand, p_type) AS cw, 'x' AS t, levenshtein(p_brand, 'Brand#12') AS lev, regexp_matches(p_name, '[0-9]+') AS rm, regexp_replace(p_brand, '[0-9]', '', 'g') AS rr, regexp_extract(p_brand, '[0-9]+') AS re, md5(p_name) AS md, sha256(p_name) AS sh, lower(printf('%x', p_size)) AS hx, 255::BIGINT AS fh FROM part")
add("math_functions", "MATCH (p:Part) RETURN p.p_partkey AS k, ABS(p.p_size - 25) AS a, CEIL(p.p_retailprice) AS c, FLOOR(p.p_retailprice) AS f, ROUND(p.p_retailprice) AS r, ROUND(SQRT(p.p_size) * 1000) AS sq, ROUND(LN(p.p_size) * 1000) AS ln, ROUND(LOG(p.p_size) * 1000) AS lg, ROUND(LOG2(p.p_size) * 1000) AS l2, ROUND(SIN(p.p_size) * 1000) AS sn, ROUND(ATAN2(p.p_size, 3) * 1000) AS at, POW(p.p_size, 2) AS pw, MOD(p.p_size, 7) AS md, SIGN(p.p_size - 25) AS sg, BIT_AND(p.p_size, 12) AS ba, BIT_OR(p.p_size, 3) AS bo, BIT_XOR(p.p_size, 5) AS bx, BIT_SHIFT_LEFT(p.p_size, 2) AS bl, BIT_COUNT(p.p_size) AS bc", "SELECT p_partkey AS k, abs(p_size - 25) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(p_retailprice) AS r, round(sqrt(p_size) * 1000) AS sq, round(ln(p_size) * 1000) AS ln, round(log10(p_size) * 1000) AS lg, round(log2(p_size) * 1000) AS l2, round(sin(p_size) * 1000) AS sn, round(atan2(p_size, 3) * 1000) AS at, pow(p_size, 2) AS pw, (p_size % 7)::DOUBLE AS md, CASE WHEN p_size < 25 THEN -1 ELSE 1 END::DOUBLE AS sg, (p_size & 12)::BIGINT AS ba, (p_size | 3)::BIGINT AS bo, xor(p_size, 5)::BIGINT AS bx, (p_size << 2)::BIGINT AS bl, bit_count(p_size)::BIGINT AS bc FROM part")
add("null_functions", "MATCH (d:Document) RETURN d.doc_id AS k, COALESCE(d.lang, 'none') AS c, IFNULL(d.source, '?') AS i, NULLIF(d.lang, 'en') AS n, IF(d.n_chars > 500, 'long', 'short') AS f, TO_INT('12x') IS NULL AS t, TO_FLOAT('1.5') AS fl, TO_BOOL('true') AS b, d.text IS NULL AS z", "SELECT doc_id AS k, coalesce(lang, 'none') AS c, coalesce(source, '?') AS i, nullif(lang, 'en') AS n, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END AS f, TRUE AS t, 1.5::DOUBLE AS fl, TRUE AS b, text IS NULL AS z FROM documents")
add("date_functions", "MATCH (o:Orders) RETURN o.o_orderkey AS k, YEAR(o.o_orderdate) AS y, MONTH(o.o_orderdate) AS m, DAY(o.o_orderdate) AS d, DATE_ADD(o.o_orderdate, 1, 'MONTH') AS da, DATE_SUB(o.o_orderdate, 2, 'WEEK') AS ds, DATE_TRUNC('month', o.o_orderdate) AS dt, DATE_DIFF('day', DATE('1995-01-01'), o.o_orderdate) AS df, MONTHNAME(o.o_orderdate) AS mn, DAYNAME(o.o_orderdate) AS dn, LEAP_YEAR(o.o_orderdate) AS ly, EPOCH(o.o_orderdate) AS ep, DATE('1995-13-01') IS NULL AS bad", "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS da, (o_orderdate::DATE - INTERVAL 14 DAY)::DATE AS ds, date_trunc('month', o_orderdate)::DATE AS dt, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS df, monthname(o_orderdate) AS mn, dayname(o_orderdate) AS dn, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS ly, epoch(o_orderdate)::BIGINT AS ep, TRUE AS bad FROM orders")
add("list_functions", "MATCH (n:Nation) WITH n.n_nationkey AS k, RANGE(1, 4) AS l RETURN k, LIST_CONTAINS(l, k) AS c, LIST_EXTRACT(l, -1) AS e, SIZE(LIST_SLICE(l, 2, 3)) AS s, LIST_POSITION(l, 9) IS NULL AS p, LIST_SUM(LIST_APPEND(l, k)) AS a, LIST_AVG(l) AS av, LIST_MAX(LIST_REPLACE(l, 4, 40)) AS mx, SIZE(LIST_REMOVE(l, 2)) AS r, LIST_EXTRACT(LIST_INSERT(l, 2, 9), 1) AS i, SIZE(RANGE(5, 1)) AS empty, SIZE(RANGE(5, 1, -2)) AS down, LIST_MIN(LIST_DISTINCT([3, 3, 2])) AS d", "SELECT n_nationkey AS k, n_nationkey BETWEEN 1 AND 4 AS c, 4::BIGINT AS e, 2::BIGINT AS s, TRUE AS p, (10 + n_nationkey)::DOUBLE AS a, 2.5::DOUBLE AS av, 40::DOUBLE AS mx, 3::BIGINT AS r, 9::BIGINT AS i, 0::BIGINT AS empty, 3::BIGINT AS down, 2::DOUBLE AS d FROM nation")
add("map_functions", "UNWIND [1, 2] AS x WITH x, MAP_CREATE(['a', 'b'], [x, x * 10]) AS m RETURN x, MAP_EXTRACT(m, 'b') AS b, MAP_EXTRACT(m, 'z') IS NULL AS z, MAP_CONTAINS_KEY(m, 'a') AS k, SIZE(MAP_KEYS(MAP_REMOVE(m, 'a'))) AS n, LIST_SUM(MAP_VALUES(m)) AS s, JSON_SERIALIZE({v: x}) AS j", "SELECT x::INT AS x, (x * 10)::BIGINT AS b, TRUE AS z, TRUE AS k, 1::BIGINT AS n, (x * 11)::DOUBLE AS s, '{\"v\":' || x || '}' AS j FROM (SELECT unnest([1, 2]) AS x)")
# traversals
_NEXT = "WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS d FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation), w AS (SELECT n_nationkey AS s, n_nationkey AS v, 0 AS d FROM nation UNION SELECT w.s, e.d, w.d + 1 FROM w JOIN e ON e.s = w.v WHERE w.d < 12), dist AS (SELECT s, v, min(d) AS d FROM w GROUP BY s, v)"
add("var_length", "MATCH (a:Nation)-[r:NEXT*2..3]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(r) AS d", f"{_NEXT} SELECT DISTINCT dist.s AS a, e.d AS b, dist.d + 1 AS d FROM dist JOIN e ON e.s = dist.v WHERE dist.d + 1 BETWEEN 2 AND 3")
add("shortest_path", "MATCH p = shortestPath((a:Nation {n_nationkey: 3})-[:NEXT*]->(b:Nation)) RETURN b.n_nationkey AS b, length(p) AS d", f"{_NEXT} SELECT v AS b, d FROM dist WHERE s = 3 AND v <> 3")
add("all_shortest_paths", "MATCH p = allShortestPaths((a:Nation {n_nationkey: 0})-[:NEXT*..4]->(b:Nation)) RETURN p", "WITH RECURSIVE e AS (SELECT DISTINCT s, d FROM (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS d FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation)), w AS (SELECT 0 AS v, [0] AS p UNION ALL SELECT e.d, list_append(w.p, e.d) FROM w JOIN e ON e.s = w.v WHERE len(w.p) <= 4), b AS (SELECT v, min(len(p)) AS n FROM w GROUP BY v) SELECT '[' || array_to_string(w.p, ', ') || ']' AS p FROM w JOIN b ON b.v = w.v AND b.n = len(w.p) WHERE w.v <> 0")


@query("WITH x AS (SELECT a.s, b.d FROM (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS d FROM nation UNION SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation) a JOIN (SELECT n_nationkey AS d FROM nation) b ON a.d = b.d WHERE a.s <> a.d), u AS (SELECT DISTINCT least(s, d) AS x, greatest(s, d) AS y FROM x) SELECT p.x AS a, p.y AS b, q.y AS c FROM u p JOIN u q ON p.y = q.x JOIN u r ON r.x = p.x AND r.y = q.y")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    return graph.triangles(engine(spark, d, "NEXT").catalog.get("NEXT").df)


def _pagerank_sql(rounds: int) -> str:
    parts = ["e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS d FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation)", "o AS (SELECT s, count(*) AS n FROM e GROUP BY s)", "r0 AS (SELECT n_nationkey AS v, 1.0 / 25 AS r FROM nation)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS (SELECT n_nationkey AS v, 0.15 / 25 + 0.85 * coalesce((SELECT sum(r{i}.r / o.n) FROM e JOIN r{i} ON r{i}.v = e.s JOIN o ON o.s = e.s WHERE e.d = n_nationkey), 0) AS r FROM nation)")
    return f"WITH {', '.join(parts)} SELECT v AS id, round(r * 1e6) AS rank FROM r{rounds}"


@query(_pagerank_sql(6))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, "NEXT").catalog
    return graph.pagerank(e.get("Nation").df, e.get("NEXT").df, 0.85, 6).select(F.col("_id").alias("id"), F.round(F.col("rank") * 1e6).alias("rank"))


@query(f"{_NEXT.replace('w AS (', 'f AS (SELECT s, d FROM e UNION SELECT d, s FROM e), w AS (').replace('JOIN e ON e.s = w.v WHERE w.d < 12', 'JOIN f e ON e.s = w.v WHERE w.d < 2')} SELECT v AS id, d AS hops FROM dist WHERE s = 5 AND v <> 5")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([(5,)], "s int")
    return graph.neighbourhood(start, engine(spark, d, "NEXT").catalog.get("NEXT").df, 2).select(F.col("v").alias("id"), F.col("d").alias("hops"))


# traversals of a growing, skewed edge table
def links(spark: SparkSession, d: str) -> DataFrame:
    """(_src, _dst): the distinct links of link_detail, ids trimmed; NULL and empty ids name nothing."""
    t = table(spark, d, "link_detail").select(F.trim("source_id").alias("_src"), F.trim("target_id").alias("_dst"))
    return t.where("_src <> '' and _dst <> ''").distinct()


@query()
def link_pagerank(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "entity").select(F.trim("id").alias("_id")).where("_id <> ''")
    return graph.pagerank(nodes, links(spark, d)).select(F.col("_id").alias("id"), "rank")


@query()
def link_triangles(spark: SparkSession, d: str) -> DataFrame:
    return graph.triangles(links(spark, d))


# search
@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id AS id, round((1 - list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[])) * 1e6) AS distance FROM embeddings, q ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), vec_id LIMIT 10")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]
    return search.vector_search(e, "embedding", q, 10, id_col="vec_id").select(F.col("vec_id").alias("id"), F.round(F.col("distance") * 1e6).alias("distance"))


BM25_SQL = r"""WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM documents WHERE text IS NOT NULL),
l AS (SELECT id, len(ts) AS n FROM d), t AS (SELECT count(*) AS docs, avg(n) AS av FROM l), p AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(ts) AS w FROM d) WHERE w IN ('vector', 'index', 'frozen') GROUP BY 1, 2),
f AS (SELECT w, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT p.id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / av))) AS s FROM p JOIN f USING (w) JOIN l ON l.id = p.id, t GROUP BY 1)
SELECT id, round(s * 1e6) AS score FROM s ORDER BY s DESC, id LIMIT 20"""


@query(BM25_SQL)
def full_text(spark: SparkSession, d: str) -> DataFrame:
    return search.TextIndex(table(spark, d, "documents"), "doc_id", "text").search("frozen vector index", 20).select("id", F.round(F.col("score") * 1e6).alias("score"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'vector index')")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return search.contains(table(spark, d, "documents"), "doc_id", "text", "vector index").select("doc_id")


@query("SELECT p_partkey FROM part WHERE contains(p_type, 'CONO')")
def trigram_search(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    return search.contains(parts, "p_partkey", "p_type", "CONO", search.trigrams(parts, "p_partkey", "p_type")).select("p_partkey")


def _store(spark: SparkSession, d: str) -> memory.MemoryStore:
    return memory.MemoryStore(spark, table(spark, d, "entity"))


@query("SELECT id, last_accessed FROM entity WHERE valid_until IN (0, 9223372036854775807) ORDER BY last_accessed DESC, id LIMIT 20")
def memory_recent(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).recent(20).select("id", "last_accessed")


@query("SELECT id, count(*) AS n FROM entity WHERE valid_from <= 1720000000000000 AND (valid_until IN (0, 9223372036854775807) OR valid_until > 1720000000000000) GROUP BY id")
def memory_at_time(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).at_time(1720000000000000).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT id) AS n FROM entity WHERE valid_until IN (0, 9223372036854775807)")
def memory_current(spark: SparkSession, d: str) -> DataFrame:
    return memory.current(table(spark, d, "entity")).agg(F.count(F.lit(1)).alias("n"))


_RECALL = BM25_SQL.replace("SELECT doc_id AS id,", "SELECT id,").replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT id, max(struct_pack(valid_from := valid_from, entity_type := entity_type, content := content)).content AS text FROM entity WHERE valid_until IN (0, 9223372036854775807) GROUP BY id) WHERE text IS NOT NULL")


@query(_RECALL.replace("SELECT id, round(s * 1e6) AS score FROM s ORDER BY s DESC, id LIMIT 20", "SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY s DESC, id)) AS score FROM s ORDER BY s DESC, id LIMIT 10"))
def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).recall("frozen vector index", None, 10)


@query()
def memory_consolidate(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).consolidate()


# streams, on batches
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value)) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return changes.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return changes.sessions(table(spark, d, "events"))


from graphloom import queries_more  # noqa: E402, F401  (adds to QUERIES and ORACLES)
