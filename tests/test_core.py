"""Small graphs with expected rows, functions, writes, search, memory and streams."""

import itertools
import os
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import Engine
from graphloom.functions.registry import jaro_winkler
from graphloom.operators import graph, memory, search
from graphloom.plans.parser import Parser, QueryError
from graphloom.sources import copying
from graphloom.sources.catalog import CatalogError
from graphloom.streaming.changes import ChangeLog


def build(spark, edges, names=None):
    e = Engine(spark)
    e.execute("CREATE NODE TABLE N (id INT64, name STRING, PRIMARY KEY (id)); CREATE REL TABLE E (FROM N TO N, w INT64)")
    ids = names or sorted({x for p in edges for x in p[:2]})
    e.insert("N", [{"id": i, "name": f"n{i}"} for i in ids])
    if edges:
        e.insert("E", [{"_src": p[0], "_dst": p[1], "w": p[2] if len(p) > 2 else 1} for p in edges])
    return e


def rows(e, q, **params):
    return [tuple(r) for r in e.execute(q, params or None).collect()]


@pytest.mark.parametrize(
    ("edges", "query", "want"),
    [
        ([(1, 1)], "MATCH (a:N {id:1})-[r:E]->(b:N) RETURN b.id", [(1,)]),
        ([(1, 2), (2, 1)], "MATCH (a:N)-[r:E]->(b:N) RETURN count(*)", [(2,)]),
        ([(1, 2), (2, 3), (3, 4)], "MATCH (a:N {id:1})-[:E]->(b)-[:E]->(c)-[:E]->(d) RETURN d.id", [(4,)]),
        ([(1, 2), (1, 3), (2, 4), (3, 4)], "MATCH (a:N {id:1})-[:E]->(b:N)-[:E]->(c:N {id:4}) RETURN b.id ORDER BY b.id", [(2,), (3,)]),
        ([(1, 2), (2, 3), (3, 1)], "MATCH (a:N {id:1})-[:E*1..3]->(b:N) RETURN b.id ORDER BY b.id", [(1,), (2,), (3,)]),
        ([(1, 2), (2, 3), (3, 4)], "MATCH (a:N {id:1})-[:E*2..3]->(b:N) RETURN b.id ORDER BY b.id", [(3,), (4,)]),
        ([(1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7)], "MATCH (a:N {id:1})-[:E*2..2]->(b:N) RETURN b.id ORDER BY b.id", [(4,), (5,), (6,), (7,)]),
        ([(1, 2), (2, 3)], "MATCH (a:N)-[:E*1..2]->(b:N {id:3}) RETURN a.id ORDER BY a.id", [(1,), (2,)]),
        ([(1, 2), (1, 2)], "MATCH (a:N)-[:E]->(b:N) RETURN count(*)", [(2,)]),
        ([(1, 2), (2, 3)], "MATCH p = shortestPath((a:N {id:1})-[:E*]->(b:N {id:3})) RETURN p", [("[1, 2, 3]",)]),
        ([(1, 2), (1, 3), (2, 4), (3, 4)], "MATCH p = allShortestPaths((a:N {id:1})-[:E*]->(b:N {id:4})) RETURN p ORDER BY p", [("[1, 2, 4]",), ("[1, 3, 4]",)]),
        ([(1, 2)], "MATCH (a:N {id:2})<-[:E]-(b) RETURN b.id", [(1,)]),
        ([(1, 2), (2, 1)], "MATCH (a:N {id:1}), (b:N {id:2}) RETURN shortestPath((a)-[:E*]->(b)) AS p, shortestPath((b)-[:E*]->(a)) AS q", [("[1, 2]", "[2, 1]")]),
    ],
)
def test_graphs(spark, edges, query, want):
    assert rows(build(spark, edges), query) == want


def test_optional_and_null_paths(spark):
    e = build(spark, [(1, 2)], [1, 2, 3])
    assert rows(e, "MATCH (a:N) OPTIONAL MATCH (a)-[:E]->(b:N) RETURN a.id, b.id ORDER BY a.id") == [(1, 2), (2, None), (3, None)]
    assert rows(e, "MATCH (a:N {id:1}), (b:N {id:3}) RETURN shortestPath((a)-[:E*]->(b)) AS p") == [(None,)]


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("1 / 0", None), ("5 % 0", None), ("7.0 / 2", 3.5), ("2 + 3 * 4", 14), ("3 - 1", 2), ("NULL = 1", None), ("NULL AND FALSE", False), ("TRUE XOR NULL", None), ("2 IN [1, 2]", True), ("2 NOT IN [1, 2]", False), ("2 IN []", False),
        ("'it\\'s'", "it's"), ("CONCAT('a', NULL, 1)", "a1"), ("SUBSTRING('hello', 1, 3)", "ell"), ("SPLIT('a.b', '.')", ["a", "b"]), ("SPLIT_PART('a,b', ',', 3)", None), ("LENGTH('é')", 2), ("TRIM('\t x\n')", "x"), ("LEFT('abc', -1)", ""), ("RIGHT('abc', 2)", "bc"), ("CONCAT_WS('-', 'a', NULL, 'b')", "a-b"),
        ("FROM_HEX('zz')", None), ("FROM_HEX('ff')", 255), ("TO_HEX(255)", "ff"), ("REGEXP_EXTRACT('abc', '[0-9]')", ""), ("REGEXP_COUNT('a1b2', '[0-9]')", 2), ("LOG(100)", 2.0), ("LN(0)", float("-inf")), ("ROUND(2.5)", 3.0), ("CEIL(1.2)", 2.0), ("SIGN(-3)", -1.0), ("BIT_NOT(0)", -1), ("PI() > 3", True),
        ("DATE('2024-02-30')", None), ("LEAP_YEAR(DATE('2024-01-01'))", True), ("DATE_DIFF('month', DATE('2024-01-15'), DATE('2024-03-14'))", 1), ("DATE_PART('quarter', DATE('2024-05-01'))", 2), ("MONTHNAME(DATE('2024-05-01'))", "May"), ("DATE_ADD(DATE('2024-01-31'), 1, 'MONTH') = DATE('2024-02-29')", True),
        ("[1, 2, 3][0]", 1), ("[1, 2, 3][-1]", 3), ("[1, 2, 3][7]", None), ("LIST_SLICE([1, 2, 3], 2)", [2, 3]), ("LIST_POSITION([1, 2], 9)", None), ("LIST_INSERT([1, 3], 2, 2)", [1, 2, 3]), ("LIST_INSERT([1], 9, 2)", None), ("RANGE(3, 1)", []), ("RANGE(5, 1, -2)", [5, 3, 1]), ("LIST_SUM([])", None), ("LIST_DISTINCT([2, 1, 2])", [2, 1]), ("LIST_REPLACE([1, 2], 2, 5)", [1, 5]),
        ("MAP_EXTRACT(MAP_CREATE(['a'], [1]), 'b')", None), ("JSON_SERIALIZE({a: 1})", '{"a":1}'), ("CAST('x' AS INT64)", None), ("IF(NULL, 1, 2)", 2), ("COALESCE(NULL, 3)", 3), ("ALL(x IN [] WHERE x > 0)", True), ("ANY(x IN [] WHERE x > 0)", False), ("NONE(x IN [1] WHERE x > 1)", True), ("SINGLE(x IN [1, 2] WHERE x > 1)", True), ("CASE 2 WHEN 1 THEN 'a' END", None), ("EXTRACT(DOY FROM DATE('2024-02-01'))", 32), ("JARO_WINKLER('', 'a')", 0.0), ("MD5('a')", "0cc175b9c0f1b6a831c399e269772661"),
    ],
)
def test_expressions(spark, expression, want):
    got = Engine(spark).cypher(f"RETURN {expression} AS x").first()[0]
    assert got == want


def test_nulls_sort_first_both_ways(spark):
    e = Engine(spark)
    for d in ("", "DESC"):
        assert e.cypher(f"UNWIND [1, NULL, 2] AS x RETURN x ORDER BY x {d}").first()[0] is None


def test_aggregates(spark):
    e = Engine(spark)
    q = "UNWIND [1, 2, 2, NULL] AS x RETURN count(*) AS n, count(x) AS c, count(DISTINCT x) AS d, sum(x) AS s, avg(x) AS a, collect(x) AS l, collect(DISTINCT x) AS u, group_concat(x) AS g, median(x) AS m, stddev(x) > 0 AS sd, sum(DISTINCT x) AS sd2"
    r = e.cypher(q).first()
    assert (r.n, r.c, r.d, r.s, r.l, r.u, r.m, r.sd2) == (4, 3, 2, 5, [1, 2, 2], [1, 2], 2.0, 3)
    assert e.cypher("UNWIND [5] AS x RETURN stddev(x) AS s, var_samp(x) AS v").first() == (None, None)
    assert rows(e, "UNWIND [1, 1, 2] AS x WITH x, count(*) AS n WHERE n > 1 RETURN x, n * 10 AS m") == [(1, 20)]


def test_union_and_parameters(spark):
    e = Engine(spark)
    assert sorted(rows(e, "RETURN 1 AS x UNION RETURN 1 AS x UNION RETURN 2 AS x")) == [(1,), (2,)]
    assert sorted(rows(e, "RETURN 1 AS x UNION ALL RETURN 1 AS x")) == [(1,), (1,)]
    assert rows(e, "RETURN $s AS x", s="'; DROP") == [("'; DROP",)]


def test_writes_time_travel_and_transactions(spark):
    e = build(spark, [(1, 2)])
    before = e.catalog.history[-1][0]
    assert rows(e, "MATCH (a:N {id:1}) SET a.name = 'x' RETURN a.name") == [("x",)]
    rows(e, "MATCH (a:N {id:2}) SET a += {name: 'y'}")
    rows(e, "MATCH (a:N {id:2}) REMOVE a.name")
    assert rows(e, "MATCH (a:N) RETURN a.name ORDER BY a.id") == [("x",), (None,)]
    assert [r[0] for r in e.execute_at("MATCH (a:N) RETURN a.name ORDER BY a.id", before).collect()] == ["n1", "n2"]
    for want in ("new", "old"):
        assert rows(e, "MERGE (a:N {id:9}) ON CREATE SET a.name='new' ON MATCH SET a.name='old' RETURN a.name") == [(want,)]
    with pytest.raises(CatalogError):
        rows(e, "CREATE (a:N {id: 9})")
    rows(e, "MATCH (a:N {id:9}), (b:N {id:1}) CREATE (a)-[:E {w: 4}]->(b)")
    assert rows(e, "MATCH (a)-[r:E]->(b) WHERE r.w = 4 RETURN a.id, b.id") == [(9, 1)]
    with pytest.raises(CatalogError):
        rows(e, "MATCH (a:N {id:9}) DELETE a")
    rows(e, "BEGIN")
    rows(e, "MATCH (a:N {id:9}) DETACH DELETE a")
    assert rows(e, "MATCH (a:N) RETURN count(*)") == [(2,)]
    rows(e, "ROLLBACK")
    assert rows(e, "MATCH (a:N) RETURN count(*)") == [(3,)]
    rows(e, "CHECKPOINT; VACUUM")
    assert len(e.catalog.history) == 1


def test_ddl_and_catalog(spark):
    e = build(spark, [(1, 2)])
    rows(e, "ALTER TABLE N ADD COLUMN age INT64; ALTER TABLE N RENAME COLUMN name TO title; ALTER TABLE N RENAME TO M")
    assert rows(e, "MATCH (a:M) RETURN a.title, a.age ORDER BY a.id LIMIT 1") == [("n1", None)]
    assert rows(e, "MATCH (a:M)-[:E]->(b:M) RETURN b.id") == [(2,)]
    rows(e, "CREATE CONSTRAINT u FOR (a:M) REQUIRE a.title IS UNIQUE")
    with pytest.raises(CatalogError):
        rows(e, "CREATE (a:M {id: 5, title: 'n1'})")
    rows(e, "DROP CONSTRAINT u; CREATE INDEX i FOR (a:M) ON (a.title); DROP INDEX i; ALTER TABLE M DROP COLUMN age")
    assert sorted(rows(e, "CALL show_tables()")) == [("E", "REL"), ("M", "NODE")]
    assert rows(e, "CALL db.labels() YIELD label AS l RETURN l") == [("M",)]
    e.create_macro("TWICE", ["x"], "x * 2")
    assert rows(e, "RETURN TWICE(4) AS x") == [(8,)]
    e.register_function("PLUS_ONE", lambda s: s + 1.0)
    assert rows(e, "RETURN PLUS_ONE(2.0) AS x") == [(3.0,)]
    assert "Physical Plan" in rows(e, "EXPLAIN MATCH (a:M) RETURN a.id")[0][0]
    rows(e, "DROP TABLE E; DROP TABLE IF EXISTS nothing")


def test_copy(spark, tmp_path):
    e = build(spark, [(1, 2)])
    e.copy_dir = str(tmp_path)
    rows(e, "COPY N TO 'out' (FORMAT='CSV', HEADER=true)")
    rows(e, "CREATE NODE TABLE K (id INT64, name STRING, PRIMARY KEY (id))")
    rows(e, "COPY K FROM 'out' (FORMAT='CSV', DELIM=',', HEADER=true)")
    assert rows(e, "MATCH (a:K) RETURN a.id, a.name ORDER BY a.id") == [(1, "n1"), (2, "n2")]
    for bad in ("../x", "/etc/passwd"):
        with pytest.raises(ValueError):
            copying.checked(bad, str(tmp_path))


@pytest.mark.parametrize("text", ["MATCH (a", "RETURN", "MATCH (a:N) RETURN a.", "RETURN 1 +", "FOO"])
def test_syntax_errors(text):
    with pytest.raises(QueryError):
        Parser(text).script()


@given(st.text(max_size=30))
def test_parser_never_breaks_otherwise(text):
    try:
        Parser(text).script()
    except (QueryError, RecursionError):
        pass


@given(st.text(max_size=8), st.text(max_size=8))
def test_jaro_winkler_bounds(a, b):
    x = jaro_winkler(a, b)
    assert 0 <= x <= 1 and abs(x - jaro_winkler(b, a)) < 0.2
    assert a == "" or jaro_winkler(a, a) == 1


def test_pagerank_and_triangles(spark):
    e = build(spark, [(1, 2), (2, 3), (3, 1)]).catalog
    got = graph.pagerank(e.get("N").df, e.get("E").df).collect()
    assert all(abs(r["rank"] - 1 / 3) < 1e-9 for r in got) and len(got) == 3
    assert [tuple(r) for r in graph.triangles(e.get("E").df).collect()] == [(1, 2, 3)]
    lone = build(spark, [(1, 2)], [1, 2, 3]).catalog
    assert abs(sum(r["rank"] for r in graph.pagerank(lone.get("N").df, lone.get("E").df).collect()) - 1) < 1e-9


def test_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0])], "_id long, v array<float>")
    for metric in ("cosine", "l2", "ip"):
        assert search.vector_search(v, "v", [1.0, 0.1], 3, metric).first()[0] in (1, 3)
    assert [r[0] for r in search.vector_search(v, "v", [1.0, 0.1], 9).collect()] == [1, 3, 2]
    d = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, "")], "id long, t string")
    assert [r["id"] for r in search.TextIndex(d, "id", "t").search("red fox", 5).collect()] == [1, 2]
    assert [r["id"] for r in search.contains(d, "id", "t", "d do", search.trigrams(d, "id", "t")).collect()] == [2]


def test_memory(spark):
    m = memory.MemoryStore(spark)
    m.store([{"id": "a", "entity_type": "fact", "content": "the red fox runs", "ttl_seconds": 10}, {"id": "b", "entity_type": "fact", "content": "the red fox runs fast"}, {"id": "c", "entity_type": "note", "content": "nothing alike"}], now=1_000_000)
    m.store([{"id": "b", "entity_type": "fact", "content": "the red fox runs far"}], now=2_000_000)
    assert m.get("b").first()["access_count"] == 1 and m.history("b").count() == 2
    assert {r["id"] for r in m.recall("fox", None, 5).collect()} == {"a", "b"}
    assert m.at_time(1_500_000).where("id = 'b'").first()["content"].endswith("fast")
    m.associate("a", "b", "RelatesTo", now=1)
    m.associate("b", "c", "Other", now=1)
    assert {r["id"] for r in m.expand("a", 2).collect()} == {"b", "c"}
    assert {r["id"] for r in m.expand("a", 2, ["RelatesTo"]).collect()} == {"b"}
    assert [(r["_src"], r["_dst"]) for r in m.consolidate().collect()] == [("a", "b")]
    rag = m.rag_query("red fox", None, 3, now=3_000_000)
    assert "red fox" in rag.context and set(rag.ids) >= {"a", "b"}
    assert m.decay(now=20_000_000) == 1 and m.get("a").count() == 0
    m.forget(["b"], now=21_000_000)
    assert [r["id"] for r in m.recent(9).collect()] == ["c"]
    assert m.central(1).count() == 1


def test_struct_and_limits(spark):
    e = Engine(spark)
    assert rows(e, "WITH STRUCT_PACK(['a', 'b'], [1, 'x']) AS s RETURN STRUCT_EXTRACT(s, 'a') AS a, STRUCT_EXTRACT(s, 'z') AS z, s.b AS b") == [(1, None, "x")]
    assert rows(e, "RETURN CONCAT_WS('-', 'p\u0001q', 'b') AS x, SIGN(0) AS z, SIGN(-2) AS m") == [("p\u0001q-b", 1.0, -1.0)]
    with pytest.raises(Exception, match="too many"):
        rows(e, "RETURN SIZE(RANGE(1, 20000000)) AS n")


def test_explain_and_profile_write_nothing(spark):
    e = build(spark, [(1, 2)])
    for text in ("EXPLAIN CREATE (a:N {id: 9})", "EXPLAIN DROP TABLE E", "PROFILE MATCH (a:N) SET a.name = 'x'"):
        with pytest.raises(QueryError):
            rows(e, text)
    assert rows(e, "MATCH (a:N) RETURN count(*)") == [(2,)] and "E" in e.catalog.at()
    got = rows(e, "PROFILE MATCH (a:N) RETURN a.id")
    assert got[0][1:3] == ("Query", "total time in ms") and any("rows" in m for _, _, m, _ in got)


def test_copy_guard(tmp_path):
    os.symlink("/etc", tmp_path / "out")
    for bad in ("file:/etc/passwd", "file:///etc/passwd", "s3a://b/x", "HDFS://x", "out/passwd", "../x", "a/../../x", "/etc/passwd"):
        for base in (None, str(tmp_path)):
            if base is None and bad == "out/passwd":
                continue
            with pytest.raises(ValueError):
                copying.checked(bad, base)
    assert copying.checked("s3a://b/x", None, ("s3a",)) == "s3a://b/x"
    assert copying.checked("sub/x.csv", str(tmp_path)) == str(tmp_path.resolve() / "sub" / "x.csv")


def test_indexes(spark):
    e = Engine(spark)
    r = random.Random(1)
    texts = [" ".join(r.choice(["red fox", "old map", "tea", "graph store"]) for _ in range(4)) for _ in range(60)] + [None, ""]
    vecs = [[r.gauss(0, 1) for _ in range(8)] for _ in range(62)]
    e.register_node("Doc", spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, vecs, strict=True))], "id long, text string, v array<double>"), "id")
    plain = sorted(rows(e, "MATCH (d:Doc) WHERE d.text CONTAINS 'fox old' RETURN d.id"))
    scan = e.full_text("Doc", "text", "red map", 9).collect()
    e.execute("CREATE TRIGRAM INDEX t FOR (d:Doc) ON (d.text); CREATE FULLTEXT INDEX f FOR (d:Doc) ON (d.text); CREATE VECTOR INDEX v FOR (d:Doc) ON (d.v)")
    df = e.cypher("MATCH (d:Doc) WHERE d.text CONTAINS 'fox old' RETURN d.id")
    assert plain and sorted(map(tuple, df.collect())) == plain
    assert "bucket" in df._jdf.queryExecution().toString()  # the index is read
    assert [(x["id"], round(x["score"], 9)) for x in e.full_text("Doc", "text", "red map", 9).collect()] == [(x["id"], round(x["score"], 9)) for x in scan]
    near = [x["id"] for x in e.vector_neighbours("Doc", "v", vecs[3], 5, 1000).collect()]
    assert near == [x["_id"] for x in search.vector_search(e.catalog.get("Doc").df, "v", vecs[3], 5).collect()] and near[0] == 3
    assert e.search("Doc", "text", scan[0]["id"], "red map") == pytest.approx(scan[0]["score"]) and e.search("Doc", "text", 60, "red map") is None
    e.execute("CREATE (d:Doc {id: 100, text: 'a fox old'})")  # the index is not of this table any more
    assert sorted(rows(e, "MATCH (d:Doc) WHERE d.text CONTAINS 'fox old' RETURN d.id")) == sorted([*plain, (100,)])


def test_vector_index_recall(spark):
    import numpy as np

    g = np.random.default_rng(4)
    v = (g.standard_normal((40, 16))[g.integers(0, 40, 3000)] + 0.4 * g.standard_normal((3000, 16))).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v array<double>")
    index = search.VectorIndex(df, "id", "v").saved()
    assert index.rows.count() == 3000
    hit = 0
    for q in range(0, 3000, 300):
        want = {r["id"] for r in search.vector_search(df, "v", v[q], 10, id_col="id").collect()}
        hit += len(want & {r["id"] for r in index.search(v[q], 10).collect()})
    assert hit >= 90
    empty = search.VectorIndex(df.where("false"), "id", "v")
    assert empty.search([0.0], 3).count() == 0


def test_contradictions(spark):
    v = [("a", [1.0, 0.0, 0.1]), ("b", [1.0, 0.05, 0.1]), ("c", [0.0, 1.0, 0.0]), ("d", [1.0, 0.01, 0.12])]
    m = memory.MemoryStore(spark, embeddings=spark.createDataFrame(v, "id string, embedding array<double>"))
    m.store([{"id": "a", "content": "the door is open today"}, {"id": "b", "content": "every window stays shut"}, {"id": "c", "content": "nothing alike here"}, {"id": "d", "content": "the door is open today"}], now=1)
    assert {(r["_src"], r["_dst"]) for r in m.contradictions().collect()} == {("a", "b"), ("b", "d")}
    pairs, top = m.consolidated()
    assert {r["type"] for r in pairs.collect()} == {"RelatedTo", "Contradicts"} and top.count() == 4


def test_inserts_look_up_new_keys_only(spark):
    e = build(spark, [(1, 2)])
    for bad in ("CREATE (a:N {id: 1, name: 'again'})", "UNWIND [7, 7] AS x CREATE (a:N {id: x})"):
        with pytest.raises(CatalogError):
            rows(e, bad)
    assert rows(e, "MATCH (a:N) RETURN count(*)") == [(2,)]


def test_user_aggregate_and_table_function(spark):
    e = build(spark, [(1, 2), (2, 3)])
    e.register_aggregate("WIDTH", lambda s: float(s.max() - s.min()))
    assert rows(e, "MATCH (a:N) RETURN WIDTH(a.id) AS w") == [(2.0,)]
    e.register_table_function("upto", lambda n: spark.range(n))
    assert rows(e, "CALL upto(3) YIELD id AS x RETURN sum(x)") == [(3,)]
    assert rows(e, "CALL nextval('s') YIELD value AS v RETURN v") == [(0,)] and rows(e, "CALL nextval('s') YIELD value AS v RETURN v") == [(1,)]


def test_change_stream(spark, tmp_path):
    e = Engine(spark)
    log = ChangeLog(spark, str(tmp_path / "log"))
    e.listeners.append(log)
    e.execute("CREATE NODE TABLE N (id INT64, name STRING, PRIMARY KEY (id)); CREATE (a:N {id: 1, name: 'x'})")
    e.execute("MATCH (a:N) SET a.name = 'y'")
    q = log.stream().writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["kind"], r["id"]) for r in spark.sql("SELECT kind, id FROM changes").collect()) == [("INSERT", "1"), ("UPDATE", "1")]


def test_entry_point(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 40 and set(o) <= set(q)
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


def test_unique_rels_all_takes_every_order(spark, tmp_path):
    import __spark_entry__ as entry

    lines = spark.createDataFrame([(k, n, 1 + n) for k in (1, 399, 400, 5000) for n in range(3)], "l_orderkey int, l_linenumber int, l_partkey int")
    for name, df in {"lineitem": lines.withColumn("l_suppkey", F.lit(1)), "orders": spark.createDataFrame([(k, 1, None) for k in (1, 399, 400, 5000)], "o_orderkey int, o_custkey int, o_orderdate date"), "part": spark.createDataFrame([(i,) for i in (1, 2, 3)], "p_partkey int"), "nation": spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int"), "region": spark.createDataFrame([(0,)], "r_regionkey int"), "customer": spark.createDataFrame([(1, 0)], "c_custkey int, c_nationkey int"), "supplier": spark.createDataFrame([(1, 0)], "s_suppkey int, s_nationkey int"), "documents": spark.createDataFrame([(1,)], "doc_id int"), "events": spark.createDataFrame([(1,)], "event_id int")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = entry.queries()["unique_rels_all"](spark, str(tmp_path)).collect()
    assert {(r.k, r.n) for r in got} == {(k, 6) for k in (1, 399, 400, 5000)}


def test_link_queries_brute_force(spark, tmp_path):
    import __spark_entry__ as entry

    pairs = [(f"e{i}", "e0") for i in range(1, 30)] + [(f"e{i}", f"e{i + 1}") for i in range(1, 20)] + [("e0", "e5"), ("e3", "e3")]
    dirt = [(" e1 ", "e0"), (None, "e0"), ("", "e1"), ("e2", None)]
    ids = [f"e{i}" for i in range(32)]
    spark.createDataFrame([(i,) for i in [*ids, " e1", None]], "id string").write.parquet(f"{tmp_path}/entity.parquet")
    spark.createDataFrame(pairs + dirt, "source_id string, target_id string").write.parquet(f"{tmp_path}/link_detail.parquet")
    und = {frozenset(p) for p in pairs if p[0] != p[1]}
    want = {t for t in itertools.combinations(sorted(ids), 3) if all(frozenset(p) in und for p in itertools.combinations(t, 2))}
    assert {tuple(r) for r in entry.queries()["link_triangles"](spark, str(tmp_path)).collect()} == want
    rank = dict.fromkeys(ids, 1 / len(ids))
    out = {i: [b for a, b in pairs if a == i] for i in ids}
    for _ in range(25):
        lost = sum(rank[i] for i in ids if not out[i])
        nxt = dict.fromkeys(ids, (0.15 + 0.85 * lost) / len(ids))
        for i in ids:
            for b in out[i]:
                nxt[b] += 0.85 * rank[i] / len(out[i])
        rank = nxt
    got = dict(tuple(r) for r in entry.queries()["link_pagerank"](spark, str(tmp_path)).collect())
    assert got == pytest.approx(rank)


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("since", [0, 300])
@pytest.mark.parametrize("meetings", [0, 8, 1e9])
def test_consolidate_of_common_words_writes_no_pairs(spark, monkeypatch, meetings, since):
    monkeypatch.setattr(memory, "MEETINGS", meetings, raising=False)
    monkeypatch.setattr(memory, "SLAB", 90, raising=False)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = {f"id{i:03d}": rng.sample(words, rng.randint(1, 20)) + [f"only{i}"] * (i % 3) for i in range(400)}
    rows = spark.createDataFrame([(k, "fact", " ".join(x), None, 1, 1, 0, None, i + 1, 0) for i, (k, x) in enumerate(texts.items())], memory.ENTITY)
    before = shuffled(spark)
    got = [(r["_src"], r["_dst"], r["weight"]) for r in memory.MemoryStore(spark, rows).consolidate(since).collect()]
    if meetings == 8 and not since:
        assert 0 < shuffled(spark) - before < 5 * 400
    sets = {k: set(x) for k, x in texts.items()}
    alike = {(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if int(b[2:]) >= since}
    assert sorted(got) == sorted(x for x in alike if x[2] > memory.RELATED)
