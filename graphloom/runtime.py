"""Session helpers: where lineage is cut, and how tables are read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_LOCAL: dict[str, str] = {}
_SCOPES = threading.local()
#: Removes a statement's shuffle files when it ends; else they stay until the driver collects its garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without it: there, and nowhere else, a
    machine-local temporary folder is as good as a shared one.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/").rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="graphloom-")
        _WRITTEN.append(_LOCAL[app])
    return _LOCAL[app]


def forget_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate rows when the driver ends, on whatever file system it lies."""
    if path.startswith(("/", "file:")):
        _WRITTEN.append(path.removeprefix("file:"))
    else:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    local = path.removeprefix("file:")
    if local in _WRITTEN:
        _WRITTEN.remove(local)


def _stack() -> list[dict[str, SparkSession]]:
    if not hasattr(_SCOPES, "stack"):
        _SCOPES.stack = []
    return _SCOPES.stack


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Tables written inside are removed at the end, but for those given to the function this yields.

    What leaves the scope must read no other table written in it.  The kept ones belong to the scope around.
    """
    stack = _stack()
    mine: dict[str, SparkSession] = {}
    stack.append(mine)
    kept: set[str] = set()
    try:
        yield lambda *tables: kept.update(t._written_at for t in tables)
    finally:
        stack.pop()
        for path, spark in mine.items():
            if path not in kept:
                remove(spark, path)
            elif stack:
                stack[-1][path] = spark


def release(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._written_at)
        for scope in _stack():
            scope.pop(t._written_at, None)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Statements that begin inside leave no shuffle files; a DataFrame made inside is for one statement only."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str = "cut", partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This is how lineage is cut here.  The files survive the loss of any executor,
    the plan is computed once (an eager checkpoint computes it twice), later
    readers keep column pruning, and no constraints of the old plan are carried
    into loops, where they would double with every join.  The shuffle files of the
    plan are removed with the statement, the table with the ``scratch`` around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        writer = df.select("*").write.mode("errorifexists").options(**(options or {}))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    forget_at_end(spark, path)
    if _stack():
        _stack()[-1][path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a written table (never a localCheckpoint)."""
    return written(df)


@atexit.register
def _clean() -> None:
    for path in _WRITTEN:
        shutil.rmtree(path, ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any cluster, once per application."""
    import hashlib
    import os
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    files = sorted(p for p in root.rglob("*") if p.is_file() and p.suffix in (".py", ".npz"))
    mark = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    out = Path(tempfile.mkdtemp(prefix="graphloom-ship-")) / f"graphloom_{mark}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(os.fspath(out))
    _SHIPPED[app] = os.fspath(out)


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """``df`` over all cores, for costly narrow maps over few input splits; large inputs stay as they are."""
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
