"""Node and relationship tables as DataFrames with metadata, in versions.

A version is a set of DataFrame handles, never a copy of rows; a commit swaps
the set, so a reader keeps what it began with and time travel reads an older
set.  One writer at a time.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Table:
    name: str
    df: DataFrame  # nodes: _id and properties; relationships: _src, _dst, _eid and properties
    key: str | None = None
    src: str | None = None
    dst: str | None = None
    unique: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, str] = field(default_factory=dict)
    built: dict[tuple[str, str], object] = field(default_factory=dict)  # (kind, column): an index and the rows it is of

    @property
    def is_rel(self) -> bool:
        return self.src is not None

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("_id", "_src", "_dst", "_eid")]


class CatalogError(ValueError):
    pass


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.history: list[tuple[float, dict[str, Table]]] = []
        self.staged: dict[str, Table] | None = None
        self.changes: list = []  # called with (time, table, kind, rows) at each commit
        self.macros: dict = {}
        self.sequences: dict[str, int] = {}

    # -- reading
    def at(self, when: float | None = None) -> dict[str, Table]:
        if when is None:
            return self.staged if self.staged is not None else self.tables
        past = [t for ts, t in self.history if ts <= when]
        return past[-1] if past else {}

    def get(self, name: str, when: float | None = None) -> Table:
        tables = self.at(when)
        if name not in tables:
            raise CatalogError(f"no table {name}")
        return tables[name]

    # -- writing
    def begin(self) -> None:
        if self.staged is not None:
            raise CatalogError("a transaction is open")
        self.staged = dict(self.tables)

    def commit(self) -> None:
        if self.staged is None:
            raise CatalogError("no transaction is open")
        self._swap(self.staged)
        self.staged = None

    def rollback(self) -> None:
        self.staged = None

    def _swap(self, tables: dict[str, Table]) -> None:
        self.tables = tables
        last = self.history[-1][0] if self.history else 0.0
        self.history.append((max(time.time(), last + 1e-6), dict(tables)))

    def put(self, *tables: Table, drop: tuple[str, ...] = ()) -> None:
        new = {k: v for k, v in self.at().items() if k not in drop} | {t.name: t for t in tables}
        if self.staged is not None:
            self.staged = new
        else:
            self._swap(new)

    def vacuum(self) -> None:
        """Forget versions that only time travel could reach."""
        self.history = self.history[-1:]

    # -- registering
    def node(self, name: str, df: DataFrame, key: str | None = None, props: list[str] | None = None) -> None:
        """Without a key the rows are numbered once and written, so the numbers stay."""
        if key is None:
            from graphloom.runtime import written

            df = written(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
            cols = props or [c for c in df.columns if c != "_id"]
            self.put(Table(name, df.select("_id", *cols)))
        else:
            cols = props or df.columns
            self.put(Table(name, df.select(F.col(key).alias("_id"), *cols), key))

    def rel(self, name: str, df: DataFrame, src: str, dst: str, source: str, target: str, props: list[str] | None = None, eid=None) -> None:
        """``eid`` is an expression that tells parallel edges apart."""
        cols = [c for c in (df.columns if props is None else props)]
        e = F.col(eid) if isinstance(eid, str) else eid
        if e is None:
            e = F.xxhash64(*df.columns)
        self.put(Table(name, df.select(F.col(source).alias("_src"), F.col(target).alias("_dst"), e.alias("_eid"), *cols), None, src, dst))

    def create(self, name: str, columns: list[tuple[str, str]], key: str | None = None, src: str | None = None, dst: str | None = None, lax: bool = False) -> None:
        if name in self.at():
            if lax:
                return
            raise CatalogError(f"table {name} exists")
        types = dict(columns)
        lead = f"_src {self._id_type(src)}, _dst {self._id_type(dst)}, _eid bigint" if src else f"_id {types[key] if key else 'bigint'}"
        schema = ", ".join([lead, *(f"`{c}` {t}" for c, t in columns)])
        self.put(Table(name, self.spark.createDataFrame([], schema), key, src, dst))

    def _id_type(self, table: str) -> str:
        return dict(self.get(table).df.dtypes)["_id"]

    def alter(self, name: str, df: DataFrame) -> None:
        self.put(replace(self.get(name), df=df))

    def next_ids(self, sequence: str, n: int) -> range:
        start = self.sequences.get(sequence, 0)
        self.sequences[sequence] = start + n
        return range(start, start + n)
