"""COPY FROM and COPY TO: CSV, JSON and Parquet, within a guarded folder."""

from __future__ import annotations

import re
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession


def checked(path: str, base: str | None, schemes: tuple[str, ...] = ()) -> str:
    """The path to use: no scheme but those allowed, no climbing, and within ``base`` once links are resolved.

    Without a folder only relative paths are taken; they lie under the working folder.
    """
    scheme, _, rest = path.partition(":")
    if rest and re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", scheme):
        if scheme.lower() not in schemes:
            raise ValueError(f"paths of {scheme}: are not allowed")
        if ".." in PurePosixPath(rest).parts:
            raise ValueError("a path may not hold ..")
        return path
    p = PurePosixPath(path)
    if ".." in p.parts or "\0" in path:
        raise ValueError("a path may not hold ..")
    if p.is_absolute() and base is None:
        raise ValueError("an absolute path needs a copy folder")
    if base is not None and re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*:.*", base):
        if p.is_absolute():
            raise ValueError("an absolute path must lie under the copy folder")
        return f"{base.rstrip('/')}/{p}"
    folder = Path(base or ".").resolve()
    real = (folder / p).resolve()
    if not real.is_relative_to(folder):
        raise ValueError("the path leaves the copy folder")
    return str(real) if base else path


def read(spark: SparkSession, path: str, schema: str, options: dict) -> DataFrame:
    kind = str(options.get("FORMAT", path.rsplit(".", 1)[-1] if "." in path else "CSV")).upper()
    r = spark.read.schema(schema)
    if kind == "JSON":
        return r.json(path)
    if kind == "PARQUET":
        return r.parquet(path)
    return r.option("sep", options.get("DELIM", ",")).option("header", options.get("HEADER", True)).csv(path)


def write(df: DataFrame, path: str, options: dict) -> None:
    kind = str(options.get("FORMAT", "CSV")).upper()
    w = df.write.mode("overwrite")
    if kind == "JSON":
        w.json(path)
    elif kind == "PARQUET":
        w.parquet(path)
    else:
        w.option("sep", options.get("DELIM", ",")).option("header", options.get("HEADER", True)).csv(path)
