"""Trees of the parser to one lazy DataFrame.

A row of the working DataFrame holds the columns of every bound variable: a
node ``n`` has `n:_id` and `n:prop`, a relationship `r:_src`, `r:_dst`, `r:_eid`
and `r:prop`, a value its own name.  Everything is declared; Catalyst prunes
the columns, pushes the filters and picks the joins.
"""

from __future__ import annotations

import functools
import itertools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import registry as R
from graphloom.operators import graph as G
from graphloom.plans.parser import Clause, Node, Path, Projection, QueryError, Rel
from graphloom.sources.catalog import Table


@dataclass
class Var:
    kind: str  # node, rel, walk, path, value
    label: str | None = None
    props: list[str] = field(default_factory=list)

    def columns(self, name: str) -> list[str]:
        own = {"node": ["_id"], "rel": ["_src", "_dst", "_eid"], "walk": ["_depth", "_neighbor"]}.get(self.kind)
        return [name] if own is None else [f"{name}:{c}" for c in (*own, *self.props)]


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def all_of(conds: list[Column]) -> Column:
    return functools.reduce(operator.and_, conds) if conds else F.lit(True)


class Compiler:
    def __init__(self, tables: dict[str, Table], params: dict | None = None, spark=None, procedures=None, macros: dict | None = None):
        self.tables, self.params, self.spark = tables, params or {}, spark
        self.procedures = procedures
        self.macros = macros or {}
        self.fresh = (f"_a{i}" for i in itertools.count())
        self.df: DataFrame | None = None
        self.vars: dict[str, Var] = {}
        self.local: dict[str, Column] = {}
        self.inside = 0

    # ------------------------------------------------------------ expressions
    def kind(self, col: Column):
        """The column's type; None inside a lambda, where it is not known yet."""
        if self.inside:
            return None
        try:
            return self.frame().select(col.alias("x")).schema[0].dataType
        except Exception:
            return None

    def frame(self) -> DataFrame:
        return self.df if self.df is not None else self.spark.range(1).select()

    def expr(self, e: tuple) -> Column:
        return getattr(self, "_" + e[0])(*e[1:])

    def _lit(self, v) -> Column:
        return F.lit(v) if v is not None else F.lit(None).cast("double")

    def _param(self, name: str) -> Column:
        if name not in self.params:
            raise QueryError(f"no value for ${name}")
        v = self.params[name]
        return F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)

    def _var(self, name: str) -> Column:
        if name in self.local:
            return self.local[name]
        v = self.vars.get(name)
        if v is None:
            raise QueryError(f"unknown variable {name}")
        if v.kind == "node":
            return c(f"{name}:_id")
        if v.kind == "rel":
            return c(f"{name}:_eid")
        if v.kind == "walk":
            return c(f"{name}:_depth")
        return c(name)

    def _prop(self, base: tuple, key: str) -> Column:
        if base[0] == "var" and base[1] not in self.local and base[1] in self.vars:
            v = self.vars[base[1]]
            if v.kind in ("node", "rel", "walk"):
                if key in v.props or (v.kind == "node" and key == "_id") or (v.kind != "node" and key in ("_src", "_dst", "_eid")):
                    return c(f"{base[1]}:{key}")
                raise QueryError(f"{base[1]} has no property {key}")
        x = self.expr(base)
        return x.getField(key)

    def _neg(self, e: tuple) -> Column:
        return -self.expr(e)

    def _not(self, e: tuple) -> Column:
        return ~self.expr(e).cast("boolean")

    def _isnull(self, e: tuple, negative: bool) -> Column:
        x = self.expr(e)
        return x.isNotNull() if negative else x.isNull()

    def _bin(self, o: str, a: tuple, b: tuple) -> Column:
        x, y = self.expr(a), self.expr(b)
        if o == "AND":
            return x.cast("boolean") & y.cast("boolean")
        if o == "OR":
            return x.cast("boolean") | y.cast("boolean")
        if o == "XOR":
            x, y = x.cast("boolean"), y.cast("boolean")
            return (x & ~y) | (~x & y)
        if o in ("=", "<>", "<", "<=", ">", ">="):
            tx, ty = self.kind(x), self.kind(y)
            if isinstance(tx, T.StringType) and isinstance(ty, T.NumericType):
                x = x.try_cast("double")
            elif isinstance(ty, T.StringType) and isinstance(tx, T.NumericType):
                y = y.try_cast("double")
            elif isinstance(tx, T.DateType | T.TimestampType | T.TimestampNTZType) and isinstance(ty, T.StringType):
                y = y.try_cast(tx.simpleString())
            return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[o]
        tx, ty = self.kind(x), self.kind(y)
        if o == "+" and (isinstance(tx, T.StringType) or isinstance(ty, T.StringType)):
            return F.concat(x.cast("string"), y.cast("string"))
        if o == "+" and isinstance(tx, T.ArrayType):
            return F.concat(x, y) if isinstance(ty, T.ArrayType) else F.array_append(x, y)
        whole = all(isinstance(t, T.IntegralType) for t in (tx, ty))
        if whole:
            x, y = x.cast("long"), y.cast("long")
        elif tx is not None and ty is not None and not isinstance(tx, T.DateType | T.TimestampNTZType):
            x, y = x.try_cast("double"), y.try_cast("double")
        if o == "/":
            return self._div(x, y, whole)
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[o](x, y)

    @staticmethod
    def _div(x: Column, y: Column, whole: bool) -> Column:
        """Whole numbers divide towards zero; by zero gives NULL."""
        return F.try_divide(x - F.try_mod(x, y), y).cast("long") if whole else F.try_divide(x, y)

    def _in(self, x: tuple, items: tuple, negative: bool) -> Column:
        v = self.expr(x)
        if items[0] == "list":
            if not items[1]:
                return F.lit(negative)
            found = functools.reduce(operator.or_, [self._bin("=", x, i) for i in items[1]])
        else:
            found = F.array_contains(self.expr(items), v)
        return ~found if negative else found

    def _case(self, subject, whens, other) -> Column:
        out = None
        for cond, value in whens:
            test = self._bin("=", subject, cond) if subject is not None else self.expr(cond).cast("boolean")
            out = (F if out is None else out).when(test, self.expr(value))
        return out.otherwise(self.expr(other)) if other is not None else out

    def _list(self, items: list) -> Column:
        return F.array(*[self.expr(i) for i in items])

    def _map(self, items: list) -> Column:
        return F.struct(*[self.expr(v).alias(k) for k, v in items])

    def _cast(self, e: tuple, kind: str) -> Column:
        return self.expr(e).try_cast(kind)

    def _index(self, x: tuple, i: tuple) -> Column:
        return R.scalar("LIST_EXTRACT", [self.expr(x), self.expr(i)], [None, None])

    def _slice(self, x: tuple, a, b) -> Column:
        return R.list_slice(self.expr(x), self.expr(a) if a else F.lit(1), self.expr(b) if b else None)

    def _quant(self, which: str, var: str, items: tuple, p: tuple) -> Column:
        xs = self.expr(items)

        def inside(x: Column) -> Column:
            before = self.local
            self.local = before | {var: x}
            self.inside += 1
            try:
                return self.expr(p)
            finally:
                self.local = before
                self.inside -= 1

        if which == "LIST_TRANSFORM":
            return F.transform(xs, inside)
        if which == "LIST_FILTER":
            return F.filter(xs, lambda x: F.coalesce(inside(x), F.lit(False)))
        true = lambda x: F.coalesce(inside(x), F.lit(False))
        false = lambda x: F.coalesce(~inside(x), F.lit(False))
        if which == "ANY":
            return F.exists(xs, true)
        if which == "NONE":
            return ~F.exists(xs, true)
        if which == "SINGLE":
            return F.size(F.filter(xs, true)) == 1
        known = F.exists(xs, lambda x: inside(x).isNotNull()) | (F.size(xs) == 0)
        return ~F.exists(xs, false) & known

    def _call(self, name: str, args: list, distinct: bool) -> Column:
        if name in self.macros:
            names, body = self.macros[name]
            before = self.local
            self.local = before | dict(zip(names, [self.expr(a) for a in args], strict=True))
            try:
                return self.expr(body)
            finally:
                self.local = before
        if name in R.AGGREGATES:
            raise QueryError(f"{name} is not allowed here")
        first = self.vars.get(args[0][1]) if args and args[0] != "*" and args[0][0] == "var" and args[0][1] not in self.local else None
        if first is not None:
            n = args[0][1]
            if name == "ID":
                return self._var(n)
            if name in ("LABELS", "LABEL", "TYPE") and first.label:
                return F.lit(first.label) if name != "LABELS" else F.array(F.lit(first.label))
            if name in ("KEYS", "PROPERTIES") and first.kind in ("node", "rel"):
                return F.array(*map(F.lit, first.props)) if name == "KEYS" else F.struct(*[c(f"{n}:{p}").alias(p) for p in first.props])
            if first.kind == "walk" and name in ("LENGTH", "SIZE"):
                return c(f"{n}:_depth").cast("long")
            if first.kind == "path":
                if name in ("LENGTH", "SIZE"):
                    return (F.size(c(n)) - 1).cast("long")
                if name == "NODES":
                    return c(n)
                if name in ("RELATIONSHIPS", "RELS"):
                    return F.when(c(n).isNotNull(), F.zip_with(F.slice(c(n), F.lit(1), F.size(c(n)) - 1), F.slice(c(n), F.lit(2), F.size(c(n)) - 1), lambda a, b: F.struct(a.alias("_src"), b.alias("_dst"))))
        if name == "STRUCT_PACK" and len(args) == 2 and all(a[0] == "list" for a in args) and all(k[0] == "lit" for k in args[0][1]):
            if len(args[0][1]) != len(args[1][1]):
                raise QueryError("STRUCT_PACK takes as many values as keys")
            return F.struct(*[self.expr(v).alias(str(k[1])) for k, v in zip(args[0][1], args[1][1], strict=True)])
        cols = [self.expr(a) for a in args]
        if name == "STRUCT_EXTRACT" and len(args) == 2 and args[1][0] == "lit":
            kind = self.kind(cols[0])
            if isinstance(kind, T.StructType):  # a field that is not there gives NULL
                return cols[0].getField(args[1][1]) if args[1][1] in kind.names else F.lit(None).cast("string")
        if name in R.SCALARS and name not in R.TYPED and name not in R.USER:
            return R.scalar(name, cols, [None] * len(cols))
        return R.scalar(name, cols, [self.kind(x) for x in cols])

    # ------------------------------------------------- subqueries, by joining
    def _sub(self, paths: list[Path], where: tuple | None) -> tuple[Compiler, list[str], str]:
        """The pattern beside the outer row: (its compiler, shared variables, mark)."""
        mark = next(self.fresh)
        inner = Compiler(self.tables, self.params, self.spark, self.procedures, self.macros)
        inner.fresh = self.fresh
        shared = [p.var for path in paths for p in path.parts if isinstance(p, Node) and p.var in self.vars]
        shared = list(dict.fromkeys(shared))
        known = {v: self.vars[v] for v in shared}
        inner.match(paths, None, known)
        return inner, shared, mark

    def _pair(self, inner: Compiler, shared: list[str], where: tuple | None, mark: str) -> tuple[DataFrame, Column, Compiler]:
        """The inner DataFrame with its shared keys renamed, and the join condition."""
        right = inner.df
        for v in shared:
            right = right.withColumnRenamed(f"{v}:_id", f"{mark}:{v}")
        cond = [c(f"{v}:_id") == c(f"{mark}:{v}") for v in shared]
        both = Compiler(self.tables, self.params, self.spark, self.procedures, self.macros)
        both.vars = inner.vars | self.vars
        if where is not None:
            both.df = self.frame().join(right, all_of(cond)) if shared else self.frame().crossJoin(right)
            cond.append(both.expr(where))
        return right, all_of(cond), both

    def _counted(self, paths: list[Path], where: tuple | None) -> Column:
        """Joins the number of matches to the row, as a new column."""
        inner, shared, mark = self._sub(paths, where)
        right, cond, _ = self._pair(inner, shared, where, mark)
        used = [x for v in shared for x in [f"{v}:_id"]] + ([x for v, b in self.vars.items() if v in names(where) for x in b.columns(v)] if where is not None else [])
        used = list(dict.fromkeys(used))
        if not used:
            n = right.where(cond).agg(F.count(F.lit(1)).alias(mark))
            self.df = self.frame().crossJoin(F.broadcast(n))
            return c(mark)
        outer = self.frame().select(*map(c, used)).distinct()
        n = outer.join(right, cond).groupBy(*map(c, used)).agg(F.count(F.lit(1)).alias(mark))
        for x in used:
            n = n.withColumnRenamed(x, f"{mark}={x}")
        self.df = self.frame().join(n, all_of([c(x).eqNullSafe(c(f"{mark}={x}")) for x in used]), "left").drop(*[f"{mark}={x}" for x in used])
        return F.coalesce(c(mark), F.lit(0).cast("long"))

    def _count(self, paths, where) -> Column:
        return self._counted(paths, where)

    def _exists(self, paths, where) -> Column:
        return self._counted(paths, where) > 0

    def _path(self, path: Path) -> Column:
        a, r, b = path.parts
        mark = next(self.fresh)
        got = self.paths_between(a, r, b, path.shortest == "all")
        text = F.concat(F.lit("["), F.array_join(F.transform("path", lambda x: x.cast("string")), ", "), F.lit("]"))
        one = got.groupBy(F.col("s").alias(f"{mark}s"), F.col("t").alias(f"{mark}t")).agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias(mark))
        self.df = self.frame().join(one, (c(f"{a.var}:_id") == c(f"{mark}s")) & (c(f"{b.var}:_id") == c(f"{mark}t")), "left").drop(f"{mark}s", f"{mark}t")
        return c(mark)

    def paths_between(self, a: Node, r: Rel, b: Node, every: bool) -> DataFrame:
        edges = self.edges(r)
        least, most = r.hops or (1, 1)
        pairs = self.frame().select(c(f"{a.var}:_id").alias("s"), c(f"{b.var}:_id").alias("t")).where("s is not null and t is not null").distinct()
        return G.shortest_paths(pairs.select("s").distinct(), pairs, edges, least, most, every)

    # --------------------------------------------------------------- patterns
    def table(self, label: str, rel: bool) -> Table:
        t = self.tables.get(label)
        if t is None or t.is_rel != rel:
            raise QueryError(f"no {'relationship' if rel else 'node'} table {label}")
        return t

    def rels(self, r: Rel) -> list[Table]:
        return [self.table(x, True) for x in r.labels] if r.labels else [t for t in self.tables.values() if t.is_rel]

    def edges(self, r: Rel) -> DataFrame:
        """_src and _dst in reading direction, _eid and the properties all tables share or NULL."""
        tables = self.rels(r)
        if not tables:
            raise QueryError("no relationship table")
        out = None
        for t in tables:
            d = t.df if len(tables) == 1 else t.df.withColumn("_eid", F.xxhash64(F.lit(t.name), "_eid"))
            out = d if out is None else out.unionByName(d, allowMissingColumns=True)
        for k, v in r.props:
            out = out.where(c(k) == Compiler(self.tables, self.params, self.spark).expr(v))
        if r.left == r.right:
            return out.unionByName(self.turned(out.where("_src <> _dst")))
        return self.turned(out) if r.left else out

    @staticmethod
    def turned(edges: DataFrame) -> DataFrame:
        rest = [c(x) for x in edges.columns if x not in ("_src", "_dst")]
        return edges.select(F.col("_dst").alias("_src"), F.col("_src").alias("_dst"), *rest)

    def infer(self, path: Path) -> None:
        """Labels of unlabelled nodes from the relationships beside them."""
        for i in range(1, len(path.parts), 2):
            r = path.parts[i]
            tables = self.rels(r)
            a, b = path.parts[i - 1], path.parts[i + 1]
            if not r.labels:  # only the tables that fit the labelled ends
                ends = lambda t: {(t.src, t.dst)} if r.right and not r.left else {(t.dst, t.src)} if r.left and not r.right else {(t.src, t.dst), (t.dst, t.src)}  # noqa: E731, B023
                lab = lambda n: n.labels[0] if n.labels else self.vars[n.var].label if n.var in self.vars else None
                fit = [t for t in tables if any((lab(a) in (None, s)) and (lab(b) in (None, d)) for s, d in ends(t))]
                r.labels = [t.name for t in fit]
                tables = fit
            if not tables:
                raise QueryError("no relationship table fits the pattern")
            s, d = tables[0].src, tables[0].dst
            if r.left and not r.right:
                s, d = d, s
            for n, label in ((a, s), (b, d)):
                if not n.labels and not (n.var in self.vars):
                    n.labels = [label]

    def scan(self, n: Node) -> DataFrame:
        if not n.labels:
            nodes = [t for t in self.tables.values() if not t.is_rel]
            if len(nodes) != 1:
                raise QueryError(f"({n.var or ''}) needs a label")
            n.labels = [nodes[0].name]
        t = self.table(n.labels[0], False)
        self.vars[n.var] = Var("node", t.name, t.props)
        return t.df.select(F.col("_id").alias(f"{n.var}:_id"), *[c(p).alias(f"{n.var}:{p}") for p in t.props])

    def filtered(self, df: DataFrame, var: str, props: list) -> DataFrame:
        outer = self.df
        for k, v in props:
            self.df = df
            df = self.df.where(self._bin("=", ("prop", ("var", var), k), v))
        self.df = outer
        return df

    def one_path(self, path: Path, bound: set[str], used: list[tuple[str, Table, str]]) -> DataFrame:
        """The pattern as a DataFrame of its own; of bound variables only the ids, unless it is made here."""
        for p in path.parts:
            if p.var is None:
                p.var = next(self.fresh)
        self.infer(path)
        if path.shortest:
            return self.short_path(path, bound)
        df, here = None, set()
        for i in range(0, len(path.parts), 2):
            n = path.parts[i]
            if i == 0:
                if n.var in bound and len(path.parts) > 1:
                    continue
                if n.var in bound:
                    return None
                df = self.filtered(self.scan(n), n.var, n.props)
                here.add(n.var)
                continue
            a, r = path.parts[i - 2], path.parts[i - 1]
            if r.hops is not None:
                df = self.walk(df, a, r, n, bound, here)
            else:
                e = self.edges(r)
                props = [x for x in e.columns if x not in ("_src", "_dst", "_eid")]
                label = r.labels[0] if len(r.labels) == 1 else None
                self.vars[r.var] = Var("rel", label, props)
                e = e.select(*[c(x).alias(f"{r.var}:{x}") for x in ("_src", "_dst", "_eid", *props)])
                used.append((r.var, tuple(r.labels), ""))
                if df is None:
                    df = e.withColumn(f"{a.var}:_id", c(f"{r.var}:_src"))
                    here.add(a.var)
                else:
                    df = df.join(e, c(f"{a.var}:_id") == c(f"{r.var}:_src"))
                df = self.arrive(df, n, f"{r.var}:_dst", bound, here)
        return df

    def arrive(self, df: DataFrame, n: Node, at: str, bound: set[str], here: set[str]) -> DataFrame:
        if n.var in here:
            return df.where(c(f"{n.var}:_id") == c(at))
        here.add(n.var)
        if n.var in bound:
            return df.withColumn(f"{n.var}:_id", c(at))
        node = self.filtered(self.scan(n), n.var, n.props)
        return df.join(node, c(at) == c(f"{n.var}:_id"))

    def walk(self, df: DataFrame | None, a: Node, r: Rel, n: Node, bound: set[str], here: set[str]) -> DataFrame:
        least, most = r.hops
        e = self.edges(r)
        props = [x for x in e.columns if x not in ("_src", "_dst", "_eid")]
        if df is None:  # the start is bound outside: walk from the ids it has there
            start = self.frame().select(c(f"{a.var}:_id").alias("s")).where("s is not null").distinct()
            df = start.select(F.col("s").alias(f"{a.var}:_id"))
            here.add(a.var)
        else:
            start = df.select(c(f"{a.var}:_id").alias("s")).distinct()
        rows = G.var_length(start, e, least, most)
        self.vars[r.var] = Var("walk", None, props)
        rows = rows.select(F.col("s").alias(f"{r.var}:_s"), F.col("v").alias(f"{r.var}:_neighbor"), F.col("depth").alias(f"{r.var}:_depth"), *[c(p).alias(f"{r.var}:{p}") for p in props])
        df = df.join(rows, c(f"{a.var}:_id") == c(f"{r.var}:_s")).drop(f"{r.var}:_s")
        return self.arrive(df, n, f"{r.var}:_neighbor", bound, here)

    def short_path(self, path: Path, bound: set[str]) -> DataFrame:
        a, r, b = path.parts
        sides = []
        for n in (a, b):
            if n.var in bound:
                side = self.frame().select(c(f"{n.var}:_id")).distinct()
            else:
                side = self.filtered(self.scan(n), n.var, n.props)
            sides.append(side)
        starts, ends = sides[0].select(c(f"{a.var}:_id").alias("s")).distinct(), sides[1].select(c(f"{b.var}:_id").alias("t")).distinct()
        least, most = r.hops or (1, 1)
        got = G.paths_to_any(starts, ends, self.edges(r), least, most, path.shortest == "all")
        name = path.var or r.var
        self.vars[name] = Var("path")
        got = got.select(F.col("s").alias(f"{a.var}:_id"), F.col("t").alias(f"{b.var}:_id"), F.col("path").alias(name))
        for n, side in ((a, sides[0]), (b, sides[1])):
            if n.var not in bound:
                got = got.join(side.withColumnRenamed(f"{n.var}:_id", "_k"), c(f"{n.var}:_id") == c("_k")).drop("_k")
        return got

    def match(self, paths: list[Path], where: tuple | None, known: dict[str, Var] | None = None, optional: bool = False) -> None:
        outer_vars = dict(self.vars)
        bound = set(outer_vars) | set(known or {})
        self.vars |= known or {}
        used: list = []
        right: DataFrame | None = None
        inside: set[str] = set()
        first = self.df
        for p in paths:
            d = self.one_path(p, bound | inside, used)
            if d is None:
                continue
            if right is None:
                right = d
            else:
                common = [v for v in inside if f"{v}:_id" in d.columns]
                m = next(self.fresh)
                for v in common:
                    d = d.withColumnRenamed(f"{v}:_id", f"{m}:{v}")
                right = right.join(d, all_of([c(f"{v}:_id") == c(f"{m}:{v}") for v in common])).drop(*[f"{m}:{v}" for v in common]) if common else right.crossJoin(d)
            inside |= {x.var for x in p.parts if isinstance(x, Node) and x.var not in bound}
        if right is not None:
            for (v1, l1, _), (v2, l2, _) in itertools.combinations(used, 2):
                if set(l1) & set(l2):
                    right = right.where(c(f"{v1}:_eid") != c(f"{v2}:_eid"))
            shared = [v for v in outer_vars if f"{v}:_id" in right.columns]
            if first is None:
                self.df = right
            else:
                m = next(self.fresh)
                for v in shared:
                    right = right.withColumnRenamed(f"{v}:_id", f"{m}:{v}")
                cond = [c(f"{v}:_id") == c(f"{m}:{v}") for v in shared]
                if optional:
                    if where is not None:
                        probe = Compiler(self.tables, self.params, self.spark, self.procedures, self.macros)
                        probe.vars, probe.df = self.vars, first.join(right, all_of(cond))
                        cond.append(probe.expr(where))
                    self.df = first.join(right, all_of(cond), "left")
                else:
                    self.df = first.join(right, all_of(cond)) if cond else first.crossJoin(right)
                self.df = self.df.drop(*[f"{m}:{v}" for v in shared])
        # properties asked of bound nodes
        for p in paths:
            for n in p.parts:
                if isinstance(n, Node) and n.props and n.var in bound and not optional and n.var in outer_vars:
                    self.df = self.filtered(self.df, n.var, n.props)
        if where is not None and not (optional and first is not None):
            self.where(where)

    def where(self, e: tuple) -> None:
        """Conjuncts one by one, so that EXISTS becomes a semi join and NOT EXISTS an anti join."""
        if e[0] == "bin" and e[1] == "AND":
            self.where(e[2])
            self.where(e[3])
            return
        anti = e[0] == "not" and e[1][0] == "exists"
        if anti or e[0] == "exists":
            paths, where = (e[1] if anti else e)[1:]
            inner, shared, mark = self._sub(paths, where)
            right, cond, _ = self._pair(inner, shared, where, mark)
            self.df = self.frame().join(right, cond, "left_anti" if anti else "left_semi")
            return
        self.by_index(e)
        before = self.df.columns if self.df is not None else []
        cond = self.expr(e).cast("boolean")
        self.df = self.frame().where(cond)
        if before and self.df.columns != before:
            self.df = self.df.select(*map(c, before))

    def by_index(self, e: tuple) -> None:
        """CONTAINS of a literal on an indexed column reads the index's candidates only; the condition still verifies them."""
        if e[0] != "call" or e[1] != "CONTAINS" or len(e[2]) != 2:
            return
        (kind, *where), (lit, *value) = e[2]
        if kind != "prop" or where[0][0] != "var" or lit != "lit" or not isinstance(value[0], str) or len(value[0]) < 3:
            return
        name, column = where[0][1], where[1]
        v = self.vars.get(name)
        t = self.tables.get(v.label) if v is not None and v.kind == "node" and v.label else None
        index = t.built.get(("trigram", column)) if t is not None else None
        if index is not None and index.of is t.df:
            found = index.candidates(value[0]).select(F.col("id").alias("_c"))
            self.df = self.frame().join(found, c(f"{name}:_id") == F.col("_c"), "left_semi")

    # ------------------------------------------------------------ projections
    def title(self, e: tuple) -> str:
        if e[0] == "prop" and e[1][0] == "var":
            return f"{e[1][1]}.{e[2]}"
        if e[0] == "var":
            return e[1]
        if e[0] == "call":
            inner = "*" if e[2] == ["*"] else ", ".join(self.title(a) for a in e[2])
            return f"{e[1]}({'DISTINCT ' if e[3] else ''}{inner})"
        if e[0] == "lit":
            return str(e[1])
        return "result"

    def has_aggregate(self, e) -> bool:
        if isinstance(e, tuple):
            if e and e[0] == "call" and e[1] in R.AGGREGATES:
                return True
            return e[:1] not in (("exists",), ("count",)) and any(map(self.has_aggregate, e))
        return isinstance(e, list) and any(map(self.has_aggregate, e))

    def project(self, p: Projection, final: bool) -> None:
        items = p.items
        if items is None:
            if final:
                items, seen = [], {}
                for v in sorted(x for x in self.vars if not x.startswith("_a")):
                    b = self.vars[v]
                    for prop in b.props if b.kind in ("node", "rel") else [None]:
                        name = prop or v
                        seen[name] = seen.get(name, 0) + 1
                        items.append((("prop", ("var", v), prop) if prop else ("var", v), name if seen[name] == 1 else f"{v}.{name}"))
            else:
                items = [(("var", v), v) for v in self.vars if not v.startswith("_a")]
        out: list[tuple[str, tuple, Var | None]] = []  # name, expression, what a variable stays
        for e, alias in items:
            v = self.vars.get(e[1]) if e[0] == "var" and e[1] not in self.local else None
            if v is not None and v.kind in ("node", "rel", "walk"):
                if not final:
                    out.append((alias or e[1], e, v))
                elif v.kind == "walk":
                    out.append((alias or e[1], e, None))
                else:
                    out += [(f"{alias or e[1]}.{x}", ("prop", e, x), None) for x in v.props]
            else:
                out.append((alias or self.title(e), e, Var("path") if v is not None and v.kind == "path" and not final else None))
        grouped = any(self.has_aggregate(e) for _, e, _ in out)
        order = []
        for e, down in p.order:  # an alias, a repeated expression, or anything in scope
            hit = next((n for n, x, _ in out if x == e or (e[0] == "var" and n == e[1]) or n == self.title(e)), None)
            order.append((hit, e, down))
        if grouped:
            df, cols = self.aggregate(out, [e for h, e, _ in order if h is None])
        else:
            cols = {}
            for n, e, v in out:
                if v is not None and v.kind in ("node", "rel", "walk"):
                    for x in v.columns(e[1]):
                        cols[n + x[len(e[1]) :]] = c(x)
                elif final and e[0] == "var" and e[1] in self.vars and self.vars[e[1]].kind == "path" and e[1] not in self.local:
                    cols[n] = F.when(c(e[1]).isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(c(e[1]), lambda x: x.cast("string")), ", "), F.lit("]")))
                else:
                    cols[n] = self.expr(e)
            extra = {f"_s{i}": self.expr(e) for i, (h, e, _) in enumerate(order) if h is None}
            if p.distinct and extra:
                raise QueryError("with DISTINCT, order by what is returned")
            df = self.frame().select(*[x.alias(n) for n, x in {**cols, **extra}.items()])
            cols = list(cols)
        if p.distinct:
            df = df.distinct()
        if order:
            keys, others = [], itertools.count()
            for i, (h, _, down) in enumerate(order):
                if h is not None:
                    k = c(h) if h in df.columns else c(f"{h}:_id")
                else:
                    k = c(f"_g{next(others)}") if grouped else c(f"_s{i}")
                keys.append(k.desc_nulls_first() if down else k.asc_nulls_first())
            df = df.orderBy(*keys)
        bound = lambda e: max(0, int(self.params[e[1]] if e[0] == "param" else e[1]))
        if p.skip is not None:
            df = df.offset(bound(p.skip))
        if p.limit is not None:
            df = df.limit(bound(p.limit))
        self.df = df.select(*map(c, cols))
        self.vars = {n: v or Var("value") for n, _, v in out}
        if p.where is not None:
            self.where(p.where)

    def aggregate(self, out: list, sorts: list[tuple]) -> tuple[DataFrame, list[str]]:
        """Implicit grouping by all items without an aggregate."""
        keys: dict[str, Column] = {}
        carried: dict[str, Column] = {}
        calls: list[tuple] = []
        for n, e, v in out:
            if self.has_aggregate(e):
                continue
            if v is not None and v.kind in ("node", "rel"):
                ident = ("_id",) if v.kind == "node" else ("_src", "_dst", "_eid")
                for x in v.columns(e[1]):
                    (keys if x.split(":", 1)[1] in ident else carried)[n + x[len(e[1]) :]] = c(x)
            else:
                keys[n] = self.expr(e)

        def pull(e):
            """The expression with each aggregate replaced by the column that will hold it."""
            if isinstance(e, tuple) and e:
                if e[0] == "call" and e[1] in R.AGGREGATES:
                    if e not in calls:
                        calls.append(e)
                    return ("raw", f"_g:{calls.index(e)}")
                return tuple(pull(x) for x in e)
            return [pull(x) for x in e] if isinstance(e, list) else e

        done = [(n, pull(e) if self.has_aggregate(e) else None, e) for n, e, v in out]
        later = [pull(e) for e in sorts]
        aggs = []
        for i, (_, name, args, distinct) in enumerate(calls):
            arg = None if args == ["*"] else self.expr(args[0])
            aggs.append(R.aggregate(name, arg, distinct).alias(f"_g:{i}"))
        aggs += [F.first(x).alias(n) for n, x in carried.items()]
        frame = self.frame()
        g = frame.groupBy(*[x.alias(n) for n, x in keys.items()]).agg(*aggs) if keys else frame.agg(*aggs)
        after = Compiler(self.tables, self.params, self.spark, macros=self.macros)
        after.df = g
        after._raw = lambda name: c(name)
        after.vars = {n: v or Var("value") for n, e, v in out if not self.has_aggregate(e)}
        same = {repr(e): n for n, e, v in out if not self.has_aggregate(e) and v is None}

        def settle(e):
            """Grouped expressions inside an aggregate expression become their columns."""
            if repr(e) in same:
                return ("raw", same[repr(e)])
            if isinstance(e, tuple):
                return e if e[:1] == ("raw",) else tuple(settle(x) for x in e)
            return [settle(x) for x in e] if isinstance(e, list) else e

        cols: dict[str, Column] = {}
        for n, e, raw in done:
            if e is None:
                hit = [x for x in g.columns if x == n or x.startswith(f"{n}:")]
                cols |= {x: c(x) for x in hit}
            else:
                cols[n] = after.expr(settle(e))
        extra = {f"_g{i}": after.expr(settle(e)) for i, e in enumerate(later)}
        return after.frame().select(*[x.alias(n) for n, x in {**cols, **extra}.items()]), list(cols)

    # ---------------------------------------------------------------- clauses
    def run(self, clauses: list[Clause], on_write=None) -> DataFrame:
        for cl in clauses:
            d = cl.data
            if cl.kind == "match":
                self.match(d["paths"], d["where"], optional=d["optional"])
            elif cl.kind == "where":
                self.where(d["where"])
            elif cl.kind == "unwind":
                self.unwind(d["list"], d["var"])
            elif cl.kind == "with":
                self.project(d["p"], False)
            elif cl.kind == "return":
                self.project(d["p"], True)
            elif cl.kind == "call":
                self.call(d)
            elif on_write is not None:
                on_write(self, cl)
            else:
                raise QueryError(f"{cl.kind} writes; use execute()")
        return self.frame()

    def unwind(self, e: tuple, var: str) -> None:
        if e[0] == "list" and not e[1]:
            self.df = self.frame().withColumn(var, F.lit(None).cast("string")).where("false")
        else:
            x = self.expr(e)
            k = self.kind(x)
            if not isinstance(k, T.ArrayType):
                x = F.when(x.isNotNull(), F.array(x))
            self.df = self.frame().withColumn(var, F.explode(x))
        self.vars[var] = Var("value")

    def call(self, d: dict) -> None:
        if self.procedures is None:
            raise QueryError("no procedures here")
        df = self.procedures(d["name"], [a[1] if a[0] == "lit" else self.params.get(a[1]) for a in d["args"]])
        if d["yields"]:
            df = df.select(*[F.col(a).alias(b or a) for a, b in d["yields"]])
        self.df = df if self.df is None else self.df.crossJoin(df)
        self.vars |= {x: Var("value") for x in df.columns}


def names(e) -> set[str]:
    """Variables an expression speaks of."""
    if isinstance(e, tuple):
        return ({e[1]} if e[:1] == ("var",) else set()).union(*map(names, e)) if e else set()
    return set().union(*map(names, e)) if isinstance(e, list) and e else set()
