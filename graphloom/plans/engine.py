"""The engine: tables, queries, writes, transactions and time travel."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import registry
from graphloom.plans.compiler import Compiler, Var, c
from graphloom.plans.parser import Clause, Node, Parser, Path, QueryError
from graphloom.runtime import written
from graphloom.sources import copying
from graphloom.sources.catalog import Catalog, CatalogError, Table

NOTHING = "void int"


class Engine:
    """``cypher(text)`` reads lazily; ``execute(text)`` also takes writes, DDL and transactions."""

    def __init__(self, spark: SparkSession, copy_dir: str | None = None):
        self.spark, self.copy_dir = spark, copy_dir
        self.catalog = Catalog(spark)
        self.table_functions: dict[str, Callable[..., DataFrame]] = {}
        self.listeners: list[Callable[[str, str, DataFrame], None]] = []
        self._parsed = functools.lru_cache(256)(lambda text: Parser(text).script())

    # -- tables
    def register_node(self, name: str, df: DataFrame, key: str | None = None, props: list[str] | None = None) -> Engine:
        self.catalog.node(name, df, key, props)
        return self

    def register_rel(self, name: str, df: DataFrame, src: str, dst: str, source: str, target: str, props: list[str] | None = None, eid=None) -> Engine:
        self.catalog.rel(name, df, src, dst, source, target, props, eid)
        return self

    def register_function(self, name: str, f: Callable, returns: str = "double") -> None:
        registry.register(name, f, returns)

    def create_macro(self, name: str, args: list[str], body: str) -> None:
        self.catalog.macros[name.upper()] = (args, Parser(body).expression())

    # -- reading
    def cypher(self, text: str, params: dict | None = None, at: float | None = None) -> DataFrame:
        import copy

        queries = self._parsed(text)
        if len(queries) != 1:
            raise QueryError("one query at a time; use execute() for scripts")
        return self._read(copy.deepcopy(queries[0]), params, at)

    def _compiler(self, params: dict | None, at: float | None = None) -> Compiler:
        return Compiler(self.catalog.at(at), params, self.spark, self._procedure, self.catalog.macros)

    def _read(self, q: dict, params: dict | None, at: float | None = None) -> DataFrame:
        frames = [self._compiler(params, at).run(part) for part in q["parts"]]
        out = frames[0]
        for nxt, every in zip(frames[1:], q["alls"], strict=True):
            if len(nxt.columns) != len(out.columns):
                raise QueryError("the parts of a UNION need as many columns each")
            out = out.union(nxt) if every else out.union(nxt).distinct()
        if q["mode"]:
            text = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
            if q["mode"] == "explain":
                return self.spark.createDataFrame([(text,)], "plan string")
            return self._profile(out)
        return out

    def _profile(self, out: DataFrame) -> DataFrame:
        """(step, operator, metric, value): the query run once, and what its physical operators counted."""
        out = out.select("*")
        plan = out._jdf.queryExecution().executedPlan()
        began = time.perf_counter()
        out._jdf.queryExecution().toRdd().count()
        took = int((time.perf_counter() - began) * 1000)
        rows: list[tuple[int, str, str, int]] = [(0, "Query", "total time in ms", took)]
        todo = [plan]
        while todo:
            node = todo.pop()
            name = node.nodeName()
            if name == "AdaptiveSparkPlan":
                todo.append(node.executedPlan())
                continue
            if name in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage"):
                todo.append(node.plan())
                continue
            metrics = node.metrics().toSeq()
            for i in range(metrics.size()):
                m = metrics.apply(i)._2()
                label = m.name()
                if label.isDefined() and m.value() >= 0:
                    rows.append((len(rows), name, label.get(), int(m.value())))
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size() - 1, -1, -1)]
        return self.spark.createDataFrame(rows, "step int, operator string, metric string, value long")

    def search(self, label: str, column: str, node_id, text: str) -> float | None:
        """The BM25 score of one node's text for a query; None where the node has none of its words."""
        t = self.catalog.get(label)
        index = self._index(t, "fulltext", column)
        got = index.scores(text, t.df.where(F.col("_id") == node_id).select(F.col("_id").alias("_n"))).first()
        return None if got is None else float(got["score"])

    def _index(self, t: Table, kind: str, column: str):
        """A built index of the table as it is now, or one made on the fly."""
        from graphloom.operators import search

        got = t.built.get((kind, column))
        if got is not None and got.of is t.df:
            return got
        return {"fulltext": search.TextIndex, "trigram": search.TrigramIndex, "vector": search.VectorIndex}[kind](t.df, "_id", column)

    def vector_neighbours(self, label: str, column: str, query: list[float], k: int, probes: int = 8) -> DataFrame:
        return self._index(self.catalog.get(label), "vector", column).search(query, k, probes)

    def full_text(self, label: str, column: str, text: str, k: int) -> DataFrame:
        return self._index(self.catalog.get(label), "fulltext", column).search(text, k)

    def register_aggregate(self, name: str, f: Callable, returns: str = "double") -> None:
        registry.register_aggregate(name, f, returns)

    def register_table_function(self, name: str, f: Callable[..., DataFrame]) -> None:
        """A function of literals that gives a DataFrame, called as CALL name(...) YIELD ..."""
        self.table_functions[name.lower()] = f

    def execute_at(self, text: str, when: float, params: dict | None = None) -> DataFrame:
        """The query on the tables as they were at ``when`` (seconds of the epoch)."""
        if self.catalog.staged is not None:
            raise CatalogError("no time travel inside a transaction")
        return self.cypher(text, params, when)

    def stream(self, text: str, params: dict | None = None):
        """Rows one by one, fetched ahead by partitions."""
        return self.cypher(text, params).toLocalIterator(prefetchPartitions=True)

    def _procedure(self, name: str, args: list) -> DataFrame:
        tables = self.catalog.at()
        kind = lambda t: "REL" if t.is_rel else "NODE"
        if name in ("show_tables", "db_tables"):
            return self.spark.createDataFrame([(t.name, kind(t)) for t in tables.values()] or [], "name string, type string")
        if name == "db_labels":
            return self.spark.createDataFrame([(t.name,) for t in tables.values() if not t.is_rel], "label string")
        if name == "db_relationshiptypes":
            return self.spark.createDataFrame([(t.name,) for t in tables.values() if t.is_rel], "relationshipType string")
        if name == "db_schema":
            return self.spark.createDataFrame([(t.name, p, dict(t.df.dtypes)[p]) for t in tables.values() for p in t.props], "table string, property string, type string")
        if name.lower() in self.table_functions:
            return self.table_functions[name.lower()](*args)
        if name == "nextval":
            return self.spark.createDataFrame([(self.catalog.next_ids(args[0], 1)[0],)], "value long")
        raise QueryError(f"unknown procedure {name}")

    # -- writing
    def execute(self, text: str, params: dict | None = None) -> DataFrame:
        import copy

        out = self.spark.createDataFrame([], NOTHING)
        for q in self._parsed(text):
            q = copy.deepcopy(q)
            first = q["parts"][0][0]
            writes = hasattr(self, "_do_" + first.kind) or any(cl.kind in ("create", "merge", "set", "delete") for part in q["parts"] for cl in part)
            if writes and q["mode"]:
                raise QueryError("EXPLAIN and PROFILE take reading queries; nothing was written")
            if writes and len(q["parts"]) > 1:
                raise QueryError("the parts of a UNION only read")
            if hasattr(self, "_do_" + first.kind):
                got = getattr(self, "_do_" + first.kind)(**first.data)
                out = got if got is not None else out
            elif any(cl.kind in ("create", "merge", "set", "delete") for part in q["parts"] for cl in part):
                out = self._write(q["parts"][0], params)
            else:
                out = self._read(q, params)
        return out

    def _do_begin(self) -> None:
        self.catalog.begin()

    def _do_commit(self) -> None:
        self.catalog.commit()

    def _do_rollback(self) -> None:
        self.catalog.rollback()

    def _do_checkpoint(self) -> None:
        """Every table written once, so later reads start from files."""
        self.catalog.put(*[replace(t, df=written(t.df, f"table-{t.name}")) for t in self.catalog.at().values()])

    def _do_vacuum(self) -> None:
        self.catalog.vacuum()

    def _do_create_node(self, name: str, columns: list, key: str | None, lax: bool) -> None:
        self.catalog.create(name, columns, key, lax=lax)

    def _do_create_rel(self, name: str, columns: list, key, lax: bool, src: str, dst: str) -> None:
        self.catalog.create(name, columns, None, src, dst, lax)

    def _do_drop_table(self, name: str, lax: bool) -> None:
        if name not in self.catalog.at() and not lax:
            raise CatalogError(f"no table {name}")
        self.catalog.put(drop=(name,))

    def _do_add_column(self, table: str, column: str, type: str) -> None:
        t = self.catalog.get(table)
        self.catalog.alter(table, t.df.withColumn(column, F.lit(None).cast(type)))

    def _do_drop_column(self, table: str, column: str) -> None:
        t = self.catalog.get(table)
        if column == t.key:
            raise CatalogError("the key column stays")
        self.catalog.alter(table, t.df.drop(column))

    def _do_rename_column(self, table: str, column: str, to: str) -> None:
        t = self.catalog.get(table)
        self.catalog.put(replace(t, df=t.df.withColumnRenamed(column, to), key=to if t.key == column else t.key))

    def _do_rename_table(self, table: str, to: str) -> None:
        t = self.catalog.get(table)
        ends = [replace(r, src=to if r.src == table else r.src, dst=to if r.dst == table else r.dst) for r in self.catalog.at().values() if r.is_rel and table in (r.src, r.dst)]
        self.catalog.put(replace(t, name=to), *ends, drop=(table,))

    def _do_create_index(self, name: str, table: str, column: str, kind: str = "key") -> None:
        """Builds the index and writes it; a table that changes afterwards is read without it until it is built again."""
        from graphloom.operators import search

        t = self.catalog.get(table)
        if column not in t.props:
            raise CatalogError(f"{table} has no column {column}")
        if kind == "key":  # files sorted by the column, so its minima and maxima skip them
            df = written(t.df.repartitionByRange(c(column)).sortWithinPartitions(c(column)), f"sorted-{table}")
            self.catalog.put(replace(t, df=df, indexes=t.indexes | {name: column}, built={}))
            return
        index = {"fulltext": search.TextIndex, "trigram": search.TrigramIndex, "vector": search.VectorIndex}[kind](t.df, "_id", column).saved()
        self.catalog.put(replace(t, indexes=t.indexes | {name: column}, built=t.built | {(kind, column): index}))

    def _do_drop_index(self, name: str) -> None:
        for t in self.catalog.at().values():
            if name in t.indexes:
                column = t.indexes[name]
                self.catalog.put(replace(t, indexes={k: v for k, v in t.indexes.items() if k != name}, built={k: v for k, v in t.built.items() if k[1] != column}))

    def _do_create_constraint(self, name: str, table: str, column: str) -> None:
        t = self.catalog.get(table)
        self._unique(t.df, [column], table)
        self.catalog.put(replace(t, unique=t.unique | {name: column}))

    def _do_drop_constraint(self, name: str) -> None:
        for t in self.catalog.at().values():
            if name in t.unique:
                self.catalog.put(replace(t, unique={k: v for k, v in t.unique.items() if k != name}))

    def _do_copy_from(self, table: str, path: str, options: dict) -> None:
        t = self.catalog.get(table)
        path = copying.checked(path, self.copy_dir)
        kinds = dict(t.df.dtypes)
        if t.is_rel:
            lead = f"`from` {kinds['_src']}, `to` {kinds['_dst']}"
            df = copying.read(self.spark, path, ", ".join([lead, *(f"`{p}` {kinds[p]}" for p in t.props)]), options)
            self._insert(table, df.withColumnsRenamed({"from": "_src", "to": "_dst"}))
        else:
            self._insert(table, copying.read(self.spark, path, ", ".join(f"`{p}` {kinds[p]}" for p in t.props), options))

    def _do_copy_to(self, table: str, path: str, options: dict) -> None:
        t = self.catalog.get(table)
        df = t.df.select(*([F.col("_src").alias("from"), F.col("_dst").alias("to")] if t.is_rel else []), *map(c, t.props))
        copying.write(df, copying.checked(path, self.copy_dir), options)

    def insert(self, table: str, rows) -> None:
        """Bulk insert of a DataFrame, a pandas or Arrow table, or a list of dicts."""
        if isinstance(rows, list):
            t = self.catalog.get(table)
            kinds = dict(t.df.dtypes)
            cols = (["_src", "_dst"] if t.is_rel else []) + t.props
            rows = self.spark.createDataFrame([tuple(r.get(x) for x in cols) for r in rows], ", ".join(f"`{x}` {kinds[x]}" for x in cols))
        elif not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame(rows)
        self._insert(table, rows)

    def _unique(self, df: DataFrame, columns: list[str], table: str) -> None:
        for col in columns:
            twice = df.where(c(col).isNotNull()).groupBy(c(col)).count().where("count > 1").limit(1).collect()
            if twice:
                raise CatalogError(f"{table}.{col} holds {twice[0][0]!r} twice")

    def _insert(self, table: str, rows: DataFrame) -> DataFrame:
        """Appends the rows; the keys must be new. Returns what was added."""
        t = self.catalog.get(table)
        kinds = dict(t.df.dtypes)
        rows = rows.select(*[c(x).cast(kinds[x]).alias(x) if x in rows.columns else F.lit(None).cast(kinds[x]).alias(x) for x in (["_src", "_dst"] if t.is_rel else []) + t.props])
        last = "_eid" if t.is_rel else "_id"
        if not t.is_rel and t.key:
            rows = written(rows.withColumn("_id", c(t.key)), "insert")
            if rows.where("_id is null").limit(1).count():
                raise CatalogError(f"{table}.{t.key} may not be NULL")
        else:  # numbered after what is there; written, so the numbers stay
            start = (t.df.agg(F.max(last)).first()[0] or 0) + 1
            rows = written(rows.withColumn(last, F.monotonically_increasing_id() + start), "insert")
        keys = [*([t.key] if t.key else []), *t.unique.values()]
        self._unique(rows, keys, table)
        for col in keys:  # only the new keys are looked up in the table
            twice = t.df.join(F.broadcast(rows.select(c(col)).distinct()) if rows.count() <= 100_000 else rows.select(c(col)).distinct(), col, "left_semi").select(c(col)).limit(1).collect()
            if twice:
                raise CatalogError(f"{table}.{col} holds {twice[0][0]!r} twice")
        new = t.df.unionByName(rows.select(*t.df.columns))
        self.catalog.alter(table, new)
        self._tell(table, "INSERT", rows)
        return rows

    def _tell(self, table: str, kind: str, rows: DataFrame) -> None:
        for f in self.listeners:
            f(table, kind, rows)

    def _write(self, clauses: list[Clause], params: dict | None) -> DataFrame:
        comp = self._compiler(params)

        def fix() -> None:
            """The rows found so far, written once: what follows changes the tables they came from."""
            if comp.df is not None:
                df = comp.df
                names = df.columns
                flat = written(df.toDF(*[f"c{i}" for i in range(len(names))]), "matched")
                comp.df = flat.toDF(*names)

        def on_write(comp: Compiler, cl: Clause) -> None:
            fix()
            getattr(self, "_w_" + cl.kind)(comp, **cl.data)
            comp.tables = self.catalog.at()

        out = comp.run(clauses, on_write)
        return out if clauses[-1].kind == "return" else self.spark.createDataFrame([], NOTHING)

    def _values(self, comp: Compiler, t: Table, props: list) -> list:
        kinds = dict(t.df.dtypes)
        for k, _ in props:
            if k not in t.props:
                raise QueryError(f"{t.name} has no property {k}")
        return [comp.expr(v).try_cast(kinds[k]).alias(k) for k, v in props]

    def _w_create(self, comp: Compiler, paths: list[Path]) -> None:
        for path in paths:
            for n in path.parts[::2]:
                if n.var is None:
                    n.var = next(comp.fresh)
                if n.var in comp.vars:
                    continue
                t = comp.table(n.labels[0], False)
                key = dict(n.props).get(t.key) if t.key else None
                rows = comp.frame().select(*self._values(comp, t, n.props))
                added = self._insert(t.name, rows)
                t = self.catalog.get(t.name)
                comp.tables = self.catalog.at()
                comp.vars[n.var] = Var("node", t.name, t.props)
                named = added.select(F.col("_id").alias(f"{n.var}:_id"), *[c(p).alias(f"{n.var}:{p}") for p in t.props])
                if comp.df is None:
                    comp.df = named
                elif key is not None:
                    comp.df = comp.df.join(named, comp.expr(key) == c(f"{n.var}:_id"))
                else:
                    comp.df = comp.df.crossJoin(named)
            for i in range(1, len(path.parts), 2):
                a, r, b = path.parts[i - 1 : i + 2]
                if r.left:
                    a, b = b, a
                t = comp.table(r.labels[0], True)
                rows = comp.frame().select(c(f"{a.var}:_id").alias("_src"), c(f"{b.var}:_id").alias("_dst"), *self._values(comp, t, r.props))
                self._insert(t.name, rows)

    def _w_set(self, comp: Compiler, items: list) -> None:
        by: dict[str, list] = {}
        for var, key, value in items:
            t = self._table_of(comp, var)
            pairs = [(key, value)] if key not in ("=", "+=") else list(value)
            if key == "=":
                pairs += [(p, ("lit", None)) for p in t.props if p != t.key and p not in dict(value)]
            by.setdefault(var, []).extend(pairs)
        for var, pairs in by.items():
            self._update(comp, var, dict(pairs))

    def _table_of(self, comp: Compiler, var: str) -> Table:
        v = comp.vars.get(var)
        if v is None or v.kind not in ("node", "rel") or v.label is None:
            raise QueryError(f"{var} is no node or relationship of one table")
        return self.catalog.get(v.label)

    def _update(self, comp: Compiler, var: str, pairs: dict, where=None) -> None:
        t = self._table_of(comp, var)
        if t.key in pairs:
            raise QueryError("the key of a node cannot be set")
        last = "_eid" if t.is_rel else "_id"
        kinds = dict(t.df.dtypes)
        new = [comp.expr(v).try_cast(kinds[k]).alias(f"new:{k}") for k, v in pairs.items()]
        frame = comp.frame() if where is None else comp.frame().where(where)
        ups = frame.select(c(f"{var}:{last}").alias("up:k"), *new).where(c("up:k").isNotNull())
        ups = ups.groupBy("up:k").agg(*[F.first(c(f"new:{k}")).alias(f"new:{k}") for k in pairs])
        joined = t.df.join(ups, c(last) == c("up:k"), "left")
        df = joined.select(*[F.when(c("up:k").isNotNull(), c(f"new:{x}")).otherwise(c(x)).alias(x) if x in pairs else c(x) for x in t.df.columns])
        df = written(df, "update")
        self._unique(df, [u for u in t.unique.values() if u in pairs], t.name)
        self.catalog.alter(t.name, df)
        self._tell(t.name, "UPDATE", df.join(ups.select(c("up:k")), c(last) == c("up:k"), "left_semi"))
        for k in pairs:  # the rows at hand see the new values
            comp.df = comp.frame().withColumn(f"{var}:{k}", (comp.expr(pairs[k]) if where is None else F.when(where, comp.expr(pairs[k])).otherwise(c(f"{var}:{k}"))).try_cast(kinds[k]))

    def _w_delete(self, comp: Compiler, vars: list[str], detach: bool) -> None:
        for var in vars:
            t = self._table_of(comp, var)
            last = "_eid" if t.is_rel else "_id"
            gone = comp.frame().select(c(f"{var}:{last}").alias("gone")).where("gone is not null").distinct()
            if not t.is_rel:
                for r in list(self.catalog.at().values()):
                    for end, table in (("_src", r.src), ("_dst", r.dst)):
                        if r.is_rel and table == t.name:
                            r = self.catalog.get(r.name)
                            if detach:
                                self.catalog.alter(r.name, r.df.join(gone, c(end) == c("gone"), "left_anti"))
                            elif r.df.join(gone, c(end) == c("gone"), "left_semi").limit(1).count():
                                raise CatalogError(f"{t.name} still has {r.name}; use DETACH DELETE")
            rows = t.df.join(gone, c(last) == c("gone"), "left_semi")
            self._tell(t.name, "DELETE", rows)
            self.catalog.alter(t.name, t.df.join(gone, c(last) == c("gone"), "left_anti"))

    def _w_merge(self, comp: Compiler, path: Path, create: list, match: list) -> None:
        """Node patterns: matched rows are updated, the others inserted once."""
        if len(path.parts) != 1 or not isinstance(path.parts[0], Node):
            raise QueryError("MERGE takes one node")
        n: Node = path.parts[0]
        if n.var is None:
            n.var = next(comp.fresh)
        t = comp.table(n.labels[0], False)
        kinds = dict(t.df.dtypes)
        want = [comp.expr(v).try_cast(kinds[k]).alias(f"want:{k}") for k, v in n.props]

        rows = comp.frame().select("*", *want)
        same = functools.reduce(lambda a, b: a & b, [c(f"want:{k}") == c(k) for k, _ in n.props])
        new = rows.select(*[c(f"want:{k}") for k, _ in n.props]).distinct().join(t.df, same, "left_anti")
        new = written(new.toDF(*[k for k, _ in n.props]), "merge")
        made = None
        if not new.isEmpty():
            made = self._insert(t.name, new)
            comp.tables = self.catalog.at()
        t = self.catalog.get(t.name)
        comp.vars[n.var] = Var("node", t.name, t.props)
        named = t.df.select(F.col("_id").alias(f"{n.var}:_id"), *[c(p).alias(f"{n.var}:{p}") for p in t.props])
        comp.df = rows.join(named, functools.reduce(lambda a, b: a & b, [c(f"want:{k}") == c(f"{n.var}:{k}") for k, _ in n.props])).drop(*[f"want:{k}" for k, _ in n.props])
        ids = made.select(F.col("_id").alias("made")) if made is not None else t.df.select(F.col("_id").alias("made")).where("false")
        flagged = comp.df.join(ids, c(f"{n.var}:_id") == c("made"), "left")
        cols = flagged.columns
        comp.df = written(flagged.toDF(*[f"c{i}" for i in range(len(cols))]), "merged").toDF(*cols)
        for items, cond in ((create, c("made").isNotNull()), (match, c("made").isNull())):
            if items:
                self._update(comp, n.var, {k: v for _, k, v in items}, cond)
                comp.tables = self.catalog.at()
        comp.df = comp.df.drop("made")



def now() -> float:
    return time.time()
