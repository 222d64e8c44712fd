"""Queries of the functions, writes, definitions, searches and memory verbs, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, memory, search
from graphloom.plans.engine import Engine
from graphloom.queries import ORACLES, QUERIES, _store, add, engine, links, query
from graphloom.runtime import shared_dir, table
from graphloom.streaming import changes

# functions
add("text_functions", "MATCH (p:Part) RETURN p.p_partkey AS k, TO_UPPER(p.p_name) AS u, TO_LOWER(p.p_type) AS l, STR_LEN(p.p_name) AS n, TO_STRING(p.p_size) AS s, STR(p.p_partkey) AS s2, INITCAP('red fox') AS ic, LTRIM('  x ') AS lt, RTRIM('  x ') AS rt, SIZE(SPLIT(p.p_name, ' ')) AS parts, OCTET_LENGTH(p.p_brand) AS ol, ROUND(JARO_WINKLER(p.p_brand, 'Brand#12') * 1000) AS jw, REGEXP_COUNT(p.p_name, '[aeiou]') AS rc, HASH(p.p_name) = HASH(p.p_name) AS h, LENGTH(GEN_RANDOM_UUID()) AS uu, CONTAINS(p.p_type, 'TIN') AS c, STARTS_WITH(p.p_type, 'LARGE') AS sw, ENDS_WITH(p.p_type, 'BRASS') AS ew, VERSION() IS NOT NULL AS ve, CURRENT_USER() IS NOT NULL AS cu", "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_type) AS l, strlen(p_name) AS n, p_size::VARCHAR AS s, p_partkey::VARCHAR AS s2, 'Red Fox' AS ic, 'x ' AS lt, '  x' AS rt, len(string_split(p_name, ' ')) AS parts, strlen(p_brand) AS ol, round(jaro_winkler_similarity(p_brand, 'Brand#12') * 1000) AS jw, len(regexp_extract_all(p_name, '[aeiou]')) AS rc, TRUE AS h, 36::BIGINT AS uu, contains(p_type, 'TIN') AS c, starts_with(p_type, 'LARGE') AS sw, suffix(p_type, 'BRASS') AS ew, TRUE AS ve, TRUE AS cu FROM part")
add("trigonometry", "MATCH (p:Part) RETURN p.p_partkey AS k, ROUND(EXP(p.p_size / 10.0) * 100) AS ex, ROUND(COS(p.p_size) * 1000) AS co, ROUND(TAN(p.p_size / 50.0) * 1000) AS ta, ROUND(ASIN(p.p_size / 50.0) * 1000) AS si, ROUND(ACOS(p.p_size / 50.0) * 1000) AS ac, ROUND(ATAN(p.p_size) * 1000) AS at, ROUND(COT(p.p_size) * 1000) AS ct, ROUND(SINH(p.p_size / 50.0) * 1000) AS sh, ROUND(COSH(p.p_size / 50.0) * 1000) AS ch, ROUND(TANH(p.p_size / 50.0) * 1000) AS th, ROUND(LOG10(p.p_size) * 1000) AS lg, ROUND(POWER(p.p_size, 0.5) * 1000) AS pw, ROUND(DEGREES(RADIANS(p.p_size))) AS dg", "SELECT p_partkey AS k, round(exp(p_size / 10.0) * 100) AS ex, round(cos(p_size) * 1000) AS co, round(tan(p_size / 50.0) * 1000) AS ta, round(asin(p_size / 50.0) * 1000) AS si, round(acos(p_size / 50.0) * 1000) AS ac, round(atan(p_size) * 1000) AS at, round(cot(p_size) * 1000) AS ct, round(sinh(p_size / 50.0) * 1000) AS sh, round(cosh(p_size / 50.0) * 1000) AS ch, round(tanh(p_size / 50.0) * 1000) AS th, round(log10(p_size) * 1000) AS lg, round(pow(p_size, 0.5) * 1000) AS pw, round(p_size)::DOUBLE AS dg FROM part")
add("number_functions", "MATCH (p:Part) RETURN p.p_partkey AS k, RAND() >= 0 AND RAND() < 1 AS ra, IS_NAN(LN(0 - p.p_size)) AS na, IS_INF(INFINITY()) AS inf, IS_INF(p.p_size) AS fin, ROUND(PI() * 1000) AS pi, ROUND(E() * 1000) AS e, ROUND(PHI() * 1000) AS phi, BIT_SHIFT_RIGHT(p.p_size, 1) AS sr, BIT_NOT(p.p_size) AS bn, ISNULL(NULL, p.p_size) AS n1, IIF(p.p_size > 25, 'big', 'small') AS ii, INTEGER('12') AS ti, FLOAT('2.5') AS fl, BOOL('false') AS bo, IS_NULL(p.p_name) AS isn, IS_NOT_NULL(p.p_name) AS inn, SIGN(0) AS zero", "SELECT p_partkey AS k, TRUE AS ra, TRUE AS na, TRUE AS inf, FALSE AS fin, 3142::DOUBLE AS pi, 2718::DOUBLE AS e, 1618::DOUBLE AS phi, p_size::BIGINT >> 1 AS sr, -(p_size::BIGINT) - 1 AS bn, p_size AS n1, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS ii, 12::BIGINT AS ti, 2.5::DOUBLE AS fl, FALSE AS bo, FALSE AS isn, TRUE AS inn, 1::DOUBLE AS zero FROM part")
add("time_functions", "MATCH (e:Event) RETURN e.event_id AS k, HOUR(e.ts) AS h, MINUTE(e.ts) AS m, SECOND(e.ts) AS s, TO_DATE('2024-02-03') AS td, TO_TIMESTAMP('2024-02-03 04:05:06') AS tt, DATETIME('2024-02-03 04:05:06') AS dt, TIMESTAMP_DIFF('hour', DATE('2024-01-01'), e.ts) AS hd, DATE_PART('quarter', e.ts) AS q, DATE_PART('dow', e.ts) AS w, AGE(CURRENT_DATE()) AS age, CURRENT_TIMESTAMP() IS NOT NULL AS ct, DATE() = CURRENT_DATE() AS cd", "SELECT event_id AS k, hour(ts) AS h, minute(ts) AS m, second(ts) AS s, DATE '2024-02-03' AS td, TIMESTAMP '2024-02-03 04:05:06' AS tt, TIMESTAMP '2024-02-03 04:05:06' AS dt, date_diff('day', DATE '2024-01-01', ts::DATE) * 24 AS hd, quarter(ts) AS q, dayofweek(ts) AS w, 0::BIGINT AS age, TRUE AS ct, TRUE AS cd FROM events")
add("more_list_functions", "MATCH (n:Nation) WITH n.n_nationkey AS k, [3, 1, 2] AS l RETURN k, LIST_EXTRACT(LIST_SORT(l), 0) AS first, LIST_EXTRACT(LIST_REVERSE(l), 0) AS last, SIZE(LIST_PREPEND(l, k)) AS p, LIST_SUM(LIST_CONCAT(l, [k])) AS s, LIST_SIZE(l) AS n, ARRAY_SIZE(LIST_DISTINCT(LIST_CONCAT(l, l))) AS d", "SELECT n_nationkey AS k, 1 AS first, 2 AS last, 4::BIGINT AS p, (6 + n_nationkey)::DOUBLE AS s, 3::BIGINT AS n, 3::BIGINT AS d FROM nation")
add("struct_functions", "UNWIND [1, 2] AS x WITH x, MAP_KV_LIST(['a', 'b'], [x, x * 10]) AS m, STRUCT_PACK(['p', 'q'], [x, 'v']) AS s RETURN x, MAP_CONTAINS_VALUE(m, x) AS v, STRUCT_EXTRACT(s, 'p') AS p, STRUCT_EXTRACT(s, 'q') AS q, STRUCT_EXTRACT(s, 'none') IS NULL AS none, s.p + 1 AS f, JSON_SERIALIZE(JSON_PARSE('{\"a\": 1}')) AS j, JSON_PARSE('{bad') IS NULL AS bad, CONCAT_WS('-', 'a', NULL, 'b') AS cw", "SELECT x::INT AS x, TRUE AS v, x::INT AS p, 'v' AS q, TRUE AS none, (x + 1)::BIGINT AS f, '{\"a\":1}' AS j, TRUE AS bad, 'a-b' AS cw FROM (SELECT unnest([1, 2]) AS x)")
add("graph_functions", "MATCH (n:Nation)-[r:IN_REGION]->(g:Region) RETURN ID(n) AS k, SIZE(LABELS(n)) AS l, LABEL(g) AS gl, SIZE(KEYS(n)) AS ks, TYPE(r) AS t, OFFSET(n) >= 0 AS o", "SELECT n_nationkey AS k, 1::BIGINT AS l, 'Region' AS gl, 3::BIGINT AS ks, 'IN_REGION' AS t, TRUE AS o FROM nation JOIN region ON r_regionkey = n_regionkey")
add("path_functions", "MATCH p = shortestPath((a:Nation {n_nationkey: 3})-[:NEXT*]->(b:Nation)) RETURN b.n_nationkey AS b, SIZE(NODES(p)) AS n, SIZE(RELATIONSHIPS(p)) AS r", QUERIES and ORACLES["shortest_path"].replace("SELECT v AS b, d FROM dist", "SELECT v AS b, (d + 1)::BIGINT AS n, d::BIGINT AS r FROM dist"))
add("path_expression", "MATCH (a:Nation {n_nationkey: 3}), (b:Nation) WHERE b.n_nationkey = 10 RETURN shortestPath((a)-[:NEXT*]->(b)) IS NOT NULL AS p", "SELECT TRUE AS p")
add("variances", "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, ROUND(VAR(c.c_acctbal)) AS v, ROUND(VAR_SAMP(c.c_acctbal)) AS vs, ROUND(VARIANCE(c.c_acctbal)) AS va, ROUND(STDDEV_POP(c.c_acctbal)) AS sp, SIZE(COLLECT(DISTINCT c.c_nationkey)) AS n, COUNT_DISTINCT(c.c_nationkey) AS cd", "SELECT c_mktsegment AS seg, round(var_pop(c_acctbal)) AS v, round(var_samp(c_acctbal)) AS vs, round(var_pop(c_acctbal)) AS va, round(stddev_pop(c_acctbal)) AS sp, count(DISTINCT c_nationkey) AS n, count(DISTINCT c_nationkey) AS cd FROM customer GROUP BY 1")
add("bare_variable", "MATCH (r:Region) RETURN r", 'SELECT r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM region')
add("self_pattern", "MATCH (a:Nation)-[r:NEXT]->(a) RETURN a.n_nationkey AS k", "SELECT n_nationkey AS k FROM nation WHERE (n_nationkey * 3 + 1) % 25 = n_nationkey OR (n_nationkey + 7) % 25 = n_nationkey")
add("unwind_dedup", "MATCH (c:Customer) UNWIND [c.c_nationkey, c.c_nationkey % 5] AS x RETURN DISTINCT x", "SELECT DISTINCT x FROM (SELECT unnest([c_nationkey, c_nationkey % 5]) AS x FROM customer)")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def parameters(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, "Orders").cypher("MATCH (o:Orders) WHERE o.o_orderstatus = $status AND o.o_totalprice > $least RETURN o.o_orderkey AS k", {"status": "F", "least": 150000})


# traversals of links with hubs
_LINKS = "l AS (SELECT DISTINCT trim(source_id) AS s, trim(target_id) AS d FROM link_detail WHERE trim(source_id) <> '' AND trim(target_id) <> ''), n AS (SELECT DISTINCT trim(id) AS id FROM entity WHERE trim(id) <> '')"
add("link_hops", "MATCH (a:Entity)-[:LINKED]->(b:Entity)-[:LINKED]->(c:Entity) RETURN a.id AS id, count(*) AS n", f"WITH {_LINKS} SELECT x.s AS id, count(*) AS n FROM l x JOIN l y ON y.s = x.d WHERE (x.s, x.d) <> (y.s, y.d) AND x.s IN (SELECT id FROM n) AND x.d IN (SELECT id FROM n) AND y.d IN (SELECT id FROM n) GROUP BY 1")


@query(f"WITH {_LINKS} SELECT least(x.s, x.d) AS a, greatest(x.s, x.d) AS b, count(*) AS n FROM l x GROUP BY 1, 2")
def link_pairs(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).groupBy(F.least("_src", "_dst").alias("a"), F.greatest("_src", "_dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH RECURSIVE " + _LINKS + ", h AS (SELECT s AS hub FROM l GROUP BY s ORDER BY count(*) DESC, s LIMIT 1), w AS (SELECT hub AS v, 0 AS d FROM h UNION SELECT l.d, w.d + 1 FROM w JOIN l ON l.s = w.v WHERE w.d < 4) SELECT v AS id, min(d) AS hops FROM w GROUP BY v")
def link_distances(spark: SparkSession, d: str) -> DataFrame:
    """From the id with the most links out, up to four links far."""
    e = links(spark, d)
    hub = e.groupBy("_src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_src").limit(1).select(F.col("_src").alias("s"))
    return graph.distances(hub, e, 4).select(F.col("v").alias("id"), F.col("d").alias("hops"))


# writes: statements run, then the table is read
def script(name: str, labels: str, statements: list[str], text: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = engine(spark, d, labels)
        for s in statements:
            e.execute(s)
        return e.cypher(text)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, sql


_NEW = "CREATE NODE TABLE Tag (id INT64, name STRING, PRIMARY KEY (id)); CREATE REL TABLE TAGGED (FROM Tag TO Tag, weight DOUBLE)"
script("create_nodes", "none", [_NEW, "UNWIND RANGE(1, 5) AS x CREATE (t:Tag {id: x, name: CONCAT('t', x)})"], "MATCH (t:Tag) RETURN t.id AS id, t.name AS name", "SELECT x AS id, 't' || x AS name FROM (SELECT unnest(range(1, 6)) AS x)")
script("create_rels", "none", [_NEW, "UNWIND RANGE(1, 3) AS x CREATE (t:Tag {id: x, name: 'n'})", "MATCH (a:Tag), (b:Tag) WHERE b.id = a.id + 1 CREATE (a)-[:TAGGED {weight: 0.5}]->(b)"], "MATCH (a:Tag)-[r:TAGGED]->(b:Tag) RETURN a.id AS a, b.id AS b, r.weight AS w", "SELECT x AS a, x + 1 AS b, 0.5::DOUBLE AS w FROM (SELECT unnest(range(1, 3)) AS x)")
script("set_property", "Customer", ["MATCH (c:Customer) WHERE c.c_acctbal < 0 SET c.c_acctbal = 0, c.c_mktsegment = 'NONE'"], "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(*) AS n, ROUND(sum(c.c_acctbal)) AS s", "SELECT CASE WHEN c_acctbal < 0 THEN 'NONE' ELSE c_mktsegment END AS seg, count(*) AS n, round(sum(greatest(c_acctbal, 0))) AS s FROM customer GROUP BY 1")
script("set_map", "Region", ["MATCH (r:Region) WHERE r.r_regionkey = 1 SET r += {r_name: 'ONE'}", "MATCH (r:Region) WHERE r.r_regionkey = 2 SET r = {r_name: 'TWO'}", "MATCH (r:Region) WHERE r.r_regionkey = 3 REMOVE r.r_name"], "MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name", "SELECT r_regionkey AS k, CASE r_regionkey WHEN 1 THEN 'ONE' WHEN 2 THEN 'TWO' WHEN 3 THEN NULL ELSE r_name END AS name FROM region")
script("detach_delete", "CUSTOMER_OF", ["MATCH (n:Nation) WHERE n.n_regionkey = 2 DETACH DELETE n"], "MATCH (c:Customer)-[:CUSTOMER_OF]->(n:Nation) RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY 1")
script("delete_rel", "IN_REGION", ["MATCH (n:Nation)-[r:IN_REGION]->(g:Region) WHERE g.r_regionkey = 0 DELETE r"], "MATCH (n:Nation)-[r:IN_REGION]->(g:Region) RETURN g.r_regionkey AS k, count(*) AS n", "SELECT n_regionkey AS k, count(*) AS n FROM nation WHERE n_regionkey <> 0 GROUP BY 1")
script("merge_nodes", "Region", ["UNWIND RANGE(3, 7) AS x MERGE (r:Region {r_regionkey: x}) ON CREATE SET r.r_name = 'NEW' ON MATCH SET r.r_name = 'OLD'"], "MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name", "SELECT r_regionkey AS k, CASE WHEN r_regionkey >= 3 THEN 'OLD' ELSE r_name END AS name FROM region UNION ALL SELECT x, 'NEW' FROM (SELECT unnest(range(5, 8)) AS x)")
script("alter_columns", "Region", ["ALTER TABLE Region ADD COLUMN note STRING; ALTER TABLE Region RENAME COLUMN r_name TO title; ALTER TABLE Region RENAME TO Area", "MATCH (a:Area) SET a.note = UPPER(a.title)"], "MATCH (a:Area) RETURN a.r_regionkey AS k, a.title AS title, a.note AS note", "SELECT r_regionkey AS k, r_name AS title, upper(r_name) AS note FROM region")
script("drop_things", "CUSTOMER_OF", ["ALTER TABLE Nation DROP COLUMN n_name; DROP TABLE CUSTOMER_OF; DROP TABLE IF EXISTS nothing"], "CALL show_tables() YIELD name AS n RETURN n", "SELECT 'Nation' AS n UNION ALL SELECT 'Customer'")
script("transactions", "Region", ["BEGIN", "MATCH (r:Region) WHERE r.r_regionkey = 0 SET r.r_name = 'LOST'", "ROLLBACK", "BEGIN", "MATCH (r:Region) WHERE r.r_regionkey = 1 SET r.r_name = 'KEPT'", "COMMIT", "CHECKPOINT", "VACUUM"], "MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name", "SELECT r_regionkey AS k, CASE r_regionkey WHEN 1 THEN 'KEPT' ELSE r_name END AS name FROM region")
script("constraints", "Region", ["CREATE CONSTRAINT u FOR (r:Region) REQUIRE r.r_name IS UNIQUE", "DROP CONSTRAINT u", "CREATE (r:Region {r_regionkey: 90, r_name: 'ASIA'})"], "MATCH (r:Region) RETURN r.r_name AS name, count(*) AS n", "SELECT r_name AS name, count(*) AS n FROM (SELECT r_name FROM region UNION ALL SELECT 'ASIA') GROUP BY 1")
script("key_index", "Orders", ["CREATE INDEX i FOR (o:Orders) ON (o.o_custkey)"], "MATCH (o:Orders) WHERE o.o_custkey = 7 RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_custkey = 7")
script("trigram_index", "Document", ["CREATE TRIGRAM INDEX t FOR (d:Document) ON (d.text)"], "MATCH (d:Document) WHERE d.text CONTAINS 'vector index' RETURN d.doc_id AS k", "SELECT doc_id AS k FROM documents WHERE contains(text, 'vector index')")
script("catalog_labels", "IN_REGION", [], "CALL db.labels() YIELD label AS l RETURN l", "SELECT 'Nation' AS l UNION ALL SELECT 'Region'")
script("catalog_rels", "IN_REGION", [], "CALL db.relationshiptypes() YIELD relationshipType AS l RETURN l", "SELECT 'IN_REGION' AS l")
script("catalog_schema", "Region", [], "CALL db.schema() YIELD property AS p, type AS t RETURN p, t", "SELECT 'r_regionkey' AS p, 'int' AS t UNION ALL SELECT 'r_name', 'string'")


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def time_travel(spark: SparkSession, d: str) -> DataFrame:
    """What the table held before a write."""
    e = engine(spark, d, "Region")
    before = e.catalog.history[-1][0]
    e.execute("MATCH (r:Region) SET r.r_name = 'GONE'")
    return e.execute_at("MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name", before)


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer")
def bulk_insert(spark: SparkSession, d: str) -> DataFrame:
    """Rows from a DataFrame and, as rows, none more."""
    e = Engine(spark)
    e.execute("CREATE NODE TABLE Buyer (id INT64, name STRING, bal DOUBLE, PRIMARY KEY (id))")
    e.insert("Buyer", table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS bal"))
    return e.cypher("MATCH (b:Buyer) RETURN b.id AS id, b.name AS name, b.bal AS bal")


@query("SELECT x AS id, 'row' || x AS name FROM (SELECT unnest(range(1, 4)) AS x)")
def row_insert(spark: SparkSession, d: str) -> DataFrame:
    import pyarrow as pa

    e = Engine(spark)
    e.execute("CREATE NODE TABLE Tag (id INT64, name STRING, PRIMARY KEY (id))")
    e.insert("Tag", [{"id": 1, "name": "row1"}, {"id": 2, "name": "row2"}])
    e.insert("Tag", pa.table({"id": [3], "name": ["row3"]}))
    return e.cypher("MATCH (t:Tag) RETURN t.id AS id, t.name AS name")


def _copied(spark: SparkSession, d: str, how: str) -> DataFrame:
    """A table written to a folder and read back into another."""
    import uuid

    e = engine(spark, d, "Nation")
    e.copy_dir = f"{shared_dir(spark)}/tables"
    at = f"copy-{uuid.uuid4().hex}"
    e.execute(f"COPY Nation TO '{at}' ({how})")
    e.execute("CREATE NODE TABLE Land (n_nationkey INT64, n_name STRING, n_regionkey INT64, PRIMARY KEY (n_nationkey))")
    e.execute(f"COPY Land FROM '{at}' ({how})")
    return e.cypher("MATCH (n:Land) RETURN n.n_nationkey AS k, n.n_name AS name, n.n_regionkey AS r")


_LAND = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation"


@query(_LAND)
def copy_csv(spark: SparkSession, d: str) -> DataFrame:
    return _copied(spark, d, "FORMAT='CSV', DELIM='|', HEADER=true")


@query(_LAND)
def copy_json(spark: SparkSession, d: str) -> DataFrame:
    return _copied(spark, d, "FORMAT='JSON'")


@query("SELECT c_custkey AS k, c_acctbal * 2 + 1 AS x FROM customer")
def user_function(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, "Customer")
    e.register_function("TWICE_AND_ONE", lambda s: s * 2 + 1)
    return e.cypher("MATCH (c:Customer) RETURN c.c_custkey AS k, TWICE_AND_ONE(c.c_acctbal) AS x")


@query("SELECT c_mktsegment AS seg, round(max(c_acctbal) - min(c_acctbal)) AS spread FROM customer GROUP BY 1")
def user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, "Customer")
    e.register_aggregate("SPREAD", lambda s: float(s.max() - s.min()))
    return e.cypher("MATCH (c:Customer) RETURN c.c_mktsegment AS seg, ROUND(SPREAD(c.c_acctbal)) AS spread")


@query("SELECT x * x AS y FROM (SELECT unnest(range(0, 5)) AS x)")
def user_table_function(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    e.register_table_function("squares", lambda n: spark.range(n).select((F.col("id") * F.col("id")).alias("y")))
    return e.cypher("CALL squares(5) YIELD y AS y RETURN y")


@query("SELECT 'INSERT' AS kind, 2::BIGINT AS n UNION ALL SELECT 'UPDATE', 1 UNION ALL SELECT 'DELETE', 1")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of inserts, updates and deletes, read back."""
    import uuid

    e = Engine(spark)
    log = changes.ChangeLog(spark, f"{shared_dir(spark)}/tables/log-{uuid.uuid4().hex}")
    e.listeners.append(log)
    e.execute("CREATE NODE TABLE Tag (id INT64, name STRING, PRIMARY KEY (id)); UNWIND [1, 2] AS x CREATE (t:Tag {id: x, name: 'a'})")
    e.execute("MATCH (t:Tag) WHERE t.id = 1 SET t.name = 'b'")
    e.execute("MATCH (t:Tag) WHERE t.id = 2 DELETE t")
    return log.read().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value)) AS total FROM events GROUP BY 1, 2")
def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The windowed counts by a stream that reads the table's file once."""
    import uuid

    name = f"w{uuid.uuid4().hex[:12]}"
    at = f"{shared_dir(spark)}/tables/{name}"
    events = table(spark, d, "events")
    events.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{at}/in")
    counts = changes.windowed_counts(stream)
    counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination(300)
    return spark.table(name).withColumn("total", F.round("total"))


# search
def _first_vector(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, d, "embeddings")
    return e, e.orderBy("vec_id").select("embedding").first()[0]


_Q = "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


@query(f"{_Q} SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], q.e) * 1e6) AS distance FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], q.e), vec_id LIMIT 10")
def vector_l2(spark: SparkSession, d: str) -> DataFrame:
    e, q = _first_vector(spark, d)
    return search.vector_search(e, "embedding", q, 10, "l2", "vec_id").select(F.col("vec_id").alias("id"), F.round(F.col("distance") * 1e6).alias("distance"))


@query(f"{_Q} SELECT vec_id AS id, round(-list_inner_product(embedding::DOUBLE[], q.e) * 1e6) AS distance FROM embeddings, q ORDER BY -list_inner_product(embedding::DOUBLE[], q.e), vec_id LIMIT 10")
def vector_ip(spark: SparkSession, d: str) -> DataFrame:
    e, q = _first_vector(spark, d)
    return search.vector_search(e, "embedding", q, 10, "ip", "vec_id").select(F.col("vec_id").alias("id"), F.round(F.col("distance") * 1e6).alias("distance"))


@query(f"{_Q} SELECT vec_id AS id, round((1 - list_cosine_similarity(embedding::DOUBLE[], q.e)) * 1e6) AS distance FROM embeddings, q ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q.e), vec_id LIMIT 10")
def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """By inverted lists, all of them read, so the answer is the exact one; ``vector_index_recall`` reads a few."""
    e, q = _first_vector(spark, d)
    return search.VectorIndex(e, "vec_id", "embedding").saved().search(q, 10, 10_000).select("id", F.round(F.col("distance") * 1e6).alias("distance"))


@query()
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    e, q = _first_vector(spark, d)
    return search.VectorIndex(e, "vec_id", "embedding").saved().search(q, 10)


@query(ORACLES["full_text"])
def full_text_index(spark: SparkSession, d: str) -> DataFrame:
    """By postings written in buckets of their terms."""
    index = search.TextIndex(table(spark, d, "documents"), "doc_id", "text").saved()
    return index.search("frozen vector index", 20).select("id", F.round(F.col("score") * 1e6).alias("score"))


@query(ORACLES["full_text"].replace("ORDER BY s DESC, id LIMIT 20", "ORDER BY s DESC, id LIMIT 1"))
def node_search(spark: SparkSession, d: str) -> DataFrame:
    """The score of one node: the best document's."""
    e = engine(spark, d, "Document")
    e.execute("CREATE FULLTEXT INDEX f FOR (d:Document) ON (d.text)")
    best = e.full_text("Document", "text", "frozen vector index", 1).first()["id"]
    return spark.createDataFrame([(best, float(round(e.search("Document", "text", best, "frozen vector index") * 1e6)))], "id long, score double")


@query("SELECT doc_id FROM documents WHERE contains(text, 'GX-1')")
def trigram_search_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return search.contains(docs, "doc_id", "text", "GX-1", search.trigrams(docs, "doc_id", "text")).select("doc_id")


# memory
_ACTIVE = "valid_until IN (0, 9223372036854775807)"
_CURRENT = f"c AS (SELECT id, max(struct_pack(valid_from := valid_from, entity_type := entity_type, content := content, metadata := metadata, created_at := created_at, last_accessed := last_accessed, access_count := access_count, ttl_seconds := ttl_seconds, valid_until := valid_until)) AS b FROM entity WHERE {_ACTIVE} GROUP BY id)"


@query(f"SELECT id, last_accessed FROM entity WHERE {_ACTIVE} AND entity_type = 'fact' ORDER BY last_accessed DESC, id LIMIT 20")
def memory_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).by_type("fact", 20).select("id", "last_accessed")


@query(f"SELECT id, created_at FROM entity WHERE {_ACTIVE} AND created_at BETWEEN 1700000000000000 AND 1720000000000000 ORDER BY created_at DESC, id LIMIT 20")
def memory_by_time(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).by_time(1700000000000000, 1720000000000000, 20).select("id", "created_at")


@query("SELECT valid_from, valid_until FROM entity WHERE id = (SELECT id FROM entity GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)")
def memory_history(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark, d)
    most = s.entities.groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").first()["id"]
    return s.history(most).select("valid_from", "valid_until")


_NOW = 1800000000000000


@query(f"WITH {_CURRENT} SELECT count(*) AS n, sum(CASE WHEN id = 'new-1' THEN 1 ELSE 0 END) AS fresh FROM (SELECT id FROM c UNION SELECT 'new-1')")
def memory_store(spark: SparkSession, d: str) -> DataFrame:
    """A batch of one new and one known entity."""
    s = _store(spark, d)
    known = memory.current(s.entities).agg(F.min("id")).first()[0]
    s.store([{"id": "new-1", "entity_type": "fact", "content": "a new one"}, {"id": known, "entity_type": "fact", "content": "changed"}], now=_NOW)
    return memory.current(s.entities).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("id") == "new-1").cast("int")).alias("fresh"))


@query(f"SELECT count(DISTINCT id) - 1 AS n FROM entity WHERE {_ACTIVE}")
def memory_forget(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark, d)
    known = memory.current(s.entities).agg(F.min("id")).first()[0]
    s.forget([known], now=_NOW)
    return memory.current(s.entities).agg(F.count(F.lit(1)).alias("n")) if s.get(known).isEmpty() else spark.createDataFrame([(-1,)], "n long")


@query(f"SELECT count(*) AS n FROM entity WHERE {_ACTIVE} AND ttl_seconds > 0 AND created_at / 1e6 + ttl_seconds <= {_NOW} / 1e6")
def memory_decay(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(_store(spark, d).decay(_NOW),)], "n long")


@query("WITH e AS (SELECT DISTINCT trim(source_id) AS s, trim(target_id) AS d FROM link_detail WHERE trim(source_id) <> '' AND trim(target_id) <> ''), b AS (SELECT s, d FROM e UNION SELECT d, s FROM e), h AS (SELECT s AS hub FROM e GROUP BY s ORDER BY count(*) DESC, s LIMIT 1), one AS (SELECT DISTINCT d FROM b WHERE s = (SELECT hub FROM h)), two AS (SELECT DISTINCT b.d FROM b JOIN one ON b.s = one.d) SELECT DISTINCT x.d AS id FROM (SELECT d FROM one UNION SELECT d FROM two) x WHERE x.d <> (SELECT hub FROM h) AND x.d IN (SELECT id FROM entity WHERE valid_until IN (0, 9223372036854775807))")
def memory_expand(spark: SparkSession, d: str) -> DataFrame:
    """Two steps from the id with the most links out, in either direction, among current entities."""
    e = links(spark, d)
    hub = e.groupBy("_src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_src").first()["_src"]
    s = memory.MemoryStore(spark, table(spark, d, "entity"), e.withColumn("type", F.lit("RelatesTo")))
    return s.expand(hub, 2, ["RelatesTo"]).select("id")


@query()
def memory_recall_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Words and vector together: the query vector is the first request's."""
    v = table(spark, d, "store_request").where(F.size("embedding") == 64).groupBy("id").agg(F.min("embedding").alias("embedding"))
    first = v.orderBy("id").first()["embedding"]
    return memory.MemoryStore(spark, table(spark, d, "entity"), None, v).recall("frozen vector index", first, 10)


@query()
def memory_contradictions(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "store_request").where(F.size("embedding") == 64).groupBy("id").agg(F.min("embedding").alias("embedding"))
    return memory.MemoryStore(spark, table(spark, d, "entity"), None, v).contradictions()
