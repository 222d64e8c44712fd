"""Traversals as frontier joins over edge tables (_src, _dst, ...)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import checkpoint

#: Levels between two cuts of the lineage.
CUT_EVERY = 3


def distances(starts: DataFrame, edges: DataFrame, most: int | None) -> DataFrame:
    """(s, v, d): d is the least number of edges from the start s to v, up to ``most``; starts have 0.

    Level-synchronous: the frontier joins the edges and loses what was visited.
    """
    step = edges.select("_src", "_dst").distinct()
    front = checkpoint(starts.select(F.col("s"), F.col("s").alias("v")).distinct().withColumn("d", F.lit(0)))
    seen = front
    level = 0
    while most is None or level < most:
        level += 1
        nxt = front.join(step, front["v"] == step["_src"]).select("s", F.col("_dst").alias("v")).distinct()
        nxt = checkpoint(nxt.join(seen.select("s", "v"), ["s", "v"], "left_anti").withColumn("d", F.lit(level)))
        if nxt.isEmpty():
            break
        seen = seen.unionByName(nxt)
        if level % CUT_EVERY == 0:
            seen = checkpoint(seen)
        front = nxt
    return seen


def var_length(starts: DataFrame, edges: DataFrame, least: int, most: int | None) -> DataFrame:
    """(s, v, depth, props...): each edge fires once, at the first depth its source is reached.

    Properties are those of the last edge, the one with the smallest _eid where
    several reach the same (v, depth).  A least of 0 also gives the start itself.
    """
    props = [c for c in edges.columns if c not in ("_src", "_dst")]
    d = distances(starts, edges, None if most is None else max(most - 1, 0))
    rows = d.join(edges, d["v"] == edges["_src"]).select("s", F.col("_dst").alias("v"), (F.col("d") + 1).alias("depth"), *props)
    rows = rows.where(F.col("depth") >= least)
    if most is not None:
        rows = rows.where(F.col("depth") <= most)
    rows = rows.groupBy("s", "v", "depth").agg(F.min(F.struct("_eid", *[c for c in props if c != "_eid"])).alias("e")).select("s", "v", "depth", *[F.col(f"e.{c}").alias(c) for c in props])
    if least == 0:
        own = starts.select(F.col("s"), F.col("s").alias("v"), F.lit(0).alias("depth"), *[F.lit(None).cast(t).alias(c) for c, t in edges.dtypes if c in props]).distinct()
        rows = rows.unionByName(own)
    return rows


def shortest_paths(starts: DataFrame, targets: DataFrame, edges: DataFrame, least: int = 1, most: int | None = None, every: bool = False) -> DataFrame:
    """(s, t, path): the shortest path of each pair that has one, the smallest by ids; all of them with ``every``.

    ``starts`` has s, ``targets`` has s and t (the pairs asked for).
    """
    step = edges.select("_src", "_dst").distinct()
    pairs = checkpoint(targets.select("s", "t").where("s <> t").distinct())
    front = checkpoint(starts.select("s", F.col("s").alias("v"), F.array("s").alias("path")).distinct())
    seen = front.select("s", "v")
    out, level = None, 0
    while most is None or level < most:
        level += 1
        nxt = front.join(step, front["v"] == step["_src"]).select("s", F.col("_dst").alias("v"), F.concat("path", F.array("_dst")).alias("path"))
        nxt = nxt.join(seen, ["s", "v"], "left_anti")
        if not every:
            nxt = nxt.groupBy("s", "v").agg(F.min("path").alias("path"))
        nxt = checkpoint(nxt)
        if nxt.isEmpty():
            break
        if level >= least:
            got = checkpoint(nxt.join(pairs, (nxt["s"] == pairs["s"]) & (nxt["v"] == pairs["t"])).select(pairs["s"], "t", "path"))
            out = got if out is None else out.unionByName(got)
            pairs = checkpoint(pairs.join(got.select("s", "t").distinct(), ["s", "t"], "left_anti"))
            if pairs.isEmpty():
                break
        seen = checkpoint(seen.unionByName(nxt.select("s", "v").distinct()))
        front = nxt.join(pairs.select("s").distinct(), "s", "left_semi")
    if out is None:
        kind = dict(starts.dtypes)["s"]
        return starts.sparkSession.createDataFrame([], f"s {kind}, t {kind}, path array<{kind}>")
    return out


def paths_to_any(starts: DataFrame, ends: DataFrame, edges: DataFrame, least: int = 1, most: int | None = None, every: bool = False) -> DataFrame:
    """(s, t, path) from each start (s) to each of the ends (t) it reaches; no pairs are formed before they are met.

    The search goes out from the starts, level by level; what arrives at an end is
    kept by a semi join, so unbound ends cost no product of starts and ends.
    """
    step = edges.select("_src", "_dst").distinct()
    front = checkpoint(starts.select("s", F.col("s").alias("v"), F.array("s").alias("path")).distinct())
    seen = front.select("s", "v")
    out, level = None, 0
    while most is None or level < most:
        level += 1
        nxt = front.join(step, front["v"] == step["_src"]).select("s", F.col("_dst").alias("v"), F.concat("path", F.array("_dst")).alias("path"))
        nxt = nxt.join(seen, ["s", "v"], "left_anti")
        if not every:
            nxt = nxt.groupBy("s", "v").agg(F.min("path").alias("path"))
        nxt = checkpoint(nxt)
        if nxt.isEmpty():
            break
        if level >= least:
            got = nxt.join(ends, nxt["v"] == ends["t"], "left_semi").select("s", F.col("v").alias("t"), "path")
            out = got if out is None else out.unionByName(got)
        seen = checkpoint(seen.unionByName(nxt.select("s", "v").distinct()))
        front = nxt
    if out is None:
        kind = dict(starts.dtypes)["s"]
        return starts.sparkSession.createDataFrame([], f"s {kind}, t {kind}, path array<{kind}>")
    return out.where("s <> t")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 25, cut_every: int = 5) -> DataFrame:
    """(_id, rank): ranks add up to 1; nodes without edges out share their rank with all.

    The graph side is joined with its out-degrees once, partitioned by source and
    persisted, so no round shuffles it again; a round is one join, one aggregate and one sum for the dangling mass.
    """
    nodes = checkpoint(nodes.select("_id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    inside = edges.select("_src", "_dst").join(nodes.select(F.col("_id").alias("_src")), "_src", "left_semi").join(nodes.select(F.col("_id").alias("_dst")), "_dst", "left_semi")
    degree = inside.groupBy("_src").agg(F.count(F.lit(1)).alias("out"))
    # repartitioned once by source and kept in executor memory or on their disks (recomputed if lost), so a round shuffles ranks only
    links = checkpoint(inside.join(degree, "_src")).repartition("_src").persist(StorageLevel.MEMORY_AND_DISK)
    ranks = nodes.join(degree.withColumnRenamed("_src", "_id"), "_id", "left").select("_id", "out", F.lit(1.0 / n).alias("rank"))
    ranks = checkpoint(ranks)
    base = ranks.select("_id", "out")
    for i in range(rounds):
        gain = links.join(ranks.select(F.col("_id").alias("_src"), "rank"), "_src").groupBy(F.col("_dst").alias("_id")).agg(F.sum(F.col("rank") / F.col("out")).alias("gain"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        ranks = base.join(gain, "_id", "left").crossJoin(F.broadcast(lost)).select("_id", "out", ((1 - damping) / n + damping * (F.coalesce("gain", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if i % cut_every == cut_every - 1:
            ranks = checkpoint(ranks)
    ranks = checkpoint(ranks)
    links.unpersist()
    return ranks.select("_id", "rank")


def neighbourhood(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(s, v, d): what lies within ``hops`` edges in either direction, without the start."""
    both = edges.select("_src", "_dst").unionByName(edges.select(F.col("_dst").alias("_src"), F.col("_src").alias("_dst")))
    return distances(starts, both, hops).where("d > 0")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: triples joined by edges in any direction.

    Edges are directed from the end of lower degree, which bounds the wedges of hubs.
    """
    e = edges.where("_src <> _dst").select(F.least("_src", "_dst").alias("x"), F.greatest("_src", "_dst").alias("y")).distinct()
    deg = e.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    e = e.join(deg.select(F.col("v").alias("x"), F.col("n").alias("nx")), "x").join(deg.select(F.col("v").alias("y"), F.col("n").alias("ny")), "y")
    up = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    d = checkpoint(e.select(F.when(up, F.col("x")).otherwise(F.col("y")).alias("u"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("v")))
    p, q, r = d.alias("p"), d.alias("q"), d.alias("r")
    t = p.join(q, F.col("p.v") == F.col("q.u")).join(r, (F.col("r.u") == F.col("p.u")) & (F.col("r.v") == F.col("q.v")))
    s = F.array_sort(F.array("p.u", "p.v", "q.v"))
    return t.select(F.get(s, F.lit(0)).alias("a"), F.get(s, F.lit(1)).alias("b"), F.get(s, F.lit(2)).alias("c"))
