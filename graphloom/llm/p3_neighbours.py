"""Problem 3: the most similar vectors of every vector.

Every unit vector is projected on ``DIMS`` Gaussian (2-stable) directions drawn
from a fixed seed, so a projected squared distance is the true one times a
chi-square variable of DIMS degrees.  A kd-tree over the projections, its top
fitted on a bounded sample and applied to all rows, deals the rows to cells; a
cell of more than ``CELL`` rows is split further by a tree fitted on a sample of
its own, again and again; within a cell a task builds the rest of the tree.  A query visits
the leaves in order of projected distance, verifies their vectors by cosine in
double precision, and stops when the projected distance squared exceeds the
``CERTAINTY`` quantile of chi-square times the squared distance of its k-th best
so far: what is left is then nearer with a chance below 1 - CERTAINTY.

First each vector is searched in its own cell, which bounds its k-th distance; then
in the other cells whose box the test does not rule out, the nearest first, in rounds
of ``VISITS`` copies of all vectors at most, so what travels at once does not grow with
the number of cells.  Every round lowers the bounds, so later ones visit less.  Cells
that no projection splits are split by hash, and so are the queries of a cell that many visit.

Equal vectors are one row of the index with their ids beside it, so a vector
that a third of all rows share neither fills a cell nor is searched twice.

Edge cases: an embedding that is NULL, of another length, all zeros, or that
holds a NULL, NaN or infinity is unusable and neither asks nor answers; a
repeated id counts once (its earliest usable row); ties go to the smaller id;
fewer than k similar ids give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import checkpoint, release, scratch

WIDTH, K, LEAST_COSINE = 64, 5, 0.68
DIMS, SEED, CERTAINTY = 8, 20240518, 0.9995
#: Rows on which the top of the kd-tree is fitted; rows of a cell; queries of one task; leaf of the tree.
SAMPLE, CELL, QUERIES, LEAF = 20_000, 16_384, 16_384, 128
#: Copies of all vectors that travel to other cells in one round.
VISITS = 3
#: Rows of one large cell on which its splits are fitted; of all such cells together; rounds of splitting at most.
FIT, FIT_ALL, ROUNDS = 512, 200_000, 6
LISTS = "vid long, others array<long>, cosines array<double>"


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p."""

    def below(x: float) -> float:
        a, y = m / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= y / k
            total += term
        return total * math.exp(-y + a * math.log(y) - math.lgamma(a)) if y > 0 else 0.0

    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(width: int = WIDTH, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def usable(df: DataFrame, id_col: str, vector: str, order: str | None, width: int = WIDTH) -> DataFrame:
    """(id, vec): one usable vector for each id."""
    v = F.col(vector)
    good = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(good)
    rank = F.struct(F.col(order).isNull(), F.col(order), v) if order else F.struct(v)
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.min_by(v, rank).alias("vec"))


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, vid) and (vid, vec), both written: equal vectors are one."""
    keyed = checkpoint(rows.withColumn("vid", F.xxhash64("vec")))
    members, vectors = checkpoint(keyed.select("id", "vid")), checkpoint(keyed.groupBy("vid").agg(F.first("vec").alias("vec")))
    release(keyed)
    return members, vectors


class Cells:
    """The top of the kd-tree: splits in heap order."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim = np.zeros(max(1, 2**depth - 1), np.int64)
        self.cut = np.zeros(max(1, 2**depth - 1))
        parts = [sample]
        for level in range(depth):
            nxt = []
            for i, part in enumerate(parts):
                node = 2**level - 1 + i
                if len(part):
                    self.dim[node] = d = int(np.argmax(part.var(axis=0)))
                    self.cut[node] = c = float(np.median(part[:, d]))
                    nxt += [part[part[:, d] < c], part[part[:, d] >= c]]
                else:
                    nxt += [part, part]
            parts = nxt

    def of(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.dim[node]] >= self.cut[node])
        return node - (2**self.depth - 1)


def leaves(p: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Balanced kd-tree leaves of the projected rows, as index arrays."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        idx = todo.pop()
        if len(idx) <= leaf:
            out.append(idx)
            continue
        d = int(np.argmax(p[idx].var(axis=0)))
        half = len(idx) // 2
        idx = idx[np.argpartition(p[idx, d], half)]
        todo += [idx[half:], idx[:half]]
    return out


def box_distance(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of each projected query to each box."""
    gap = np.maximum(np.maximum(lo[None] - q[:, None], q[:, None] - hi[None]), 0)
    return np.einsum("ijk,ijk->ij", gap, gap)


def search(qv: np.ndarray, qp: np.ndarray, worst: np.ndarray, q_id: np.ndarray, dv: np.ndarray, dp: np.ndarray, d_id: np.ndarray, k: int, chi: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the data for each query that beat its ``worst`` cosine so far: (ids, cosines), -2 where none."""
    groups = leaves(dp)
    lo = np.array([dp[g].min(axis=0) for g in groups])
    hi = np.array([dp[g].max(axis=0) for g in groups])
    order = np.concatenate(leaves(qp, 256)) if len(qp) else np.zeros(0, np.int64)
    ids = np.zeros((len(qv), k), np.int64)
    cos = np.full((len(qv), k), -2.0)
    data = [(np.ascontiguousarray(dv[g].T), d_id[g]) for g in groups]
    for at in range(0, len(order), 256):
        rows = order[at : at + 256]
        v, own = qv[rows], q_id[rows]
        far = box_distance(qp[rows], lo, hi)
        floor = worst[rows].copy()
        b_cos, b_id = cos[rows], ids[rows]
        for g in np.argsort(far.min(axis=0), kind="stable"):
            reach = chi * np.maximum(0, 2 - 2 * floor)
            live = np.flatnonzero(far[:, g] <= reach)
            if not len(live):
                if (far.min(axis=0)[g] > reach.max()):
                    break
                continue
            block, block_id = data[g]
            s = v[live] @ block
            s[own[live][:, None] == block_id[None]] = -2
            better = s > floor[live][:, None]
            hit = np.flatnonzero(better.any(axis=1))
            if not len(hit):
                continue
            r = live[hit]
            c = np.hstack((b_cos[r], np.where(better[hit], s[hit], -2)))
            i = np.hstack((b_id[r], np.broadcast_to(block_id, (len(hit), len(block_id)))))
            top = np.argpartition(-c, k - 1, axis=1)[:, :k]
            b_cos[r], b_id[r] = np.take_along_axis(c, top, 1), np.take_along_axis(i, top, 1)
            floor[r] = np.maximum(floor[r], b_cos[r].min(axis=1))
        cos[rows], ids[rows] = b_cos, b_id
    return ids, cos


def refined(placed: DataFrame, dims: int, most: int) -> DataFrame:
    """``placed`` with every cell of more than ``most`` rows split by a tree of its own."""
    spark = placed.sparkSession
    for _ in range(ROUNDS):
        counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # about rows / CELL cells
        over = {c: n for c, n in counts.items() if n > most}
        if not over:
            break
        fit = max(64, min(FIT, FIT_ALL // len(over)))
        share = spark.createDataFrame([(c, fit / n) for c, n in over.items()], "cell int, share double")
        drawn = F.pmod(F.xxhash64("vid"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
        sample = placed.join(F.broadcast(share), "cell").where(drawn).select("cell", "p").toArrow()
        cells, points = sample.column("cell").to_numpy(), matrix(sample.column("p"), dims) if sample.num_rows else np.zeros((0, dims))
        trees, free = {}, max(counts) + 1
        for c, n in over.items():
            part = points[cells == c]
            depth = min(math.ceil(math.log2(n / most)), int(math.log2(max(1, len(part) / 16))))
            if depth >= 1 and part.var(axis=0).max() > 1e-12:
                trees[c] = (Cells(part, depth), free)
                free += 2**depth
        if not trees:
            break
        shared = spark.sparkContext.broadcast(trees)

        def split(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                cell, p = b.column(3).to_numpy().copy(), matrix(b.column(2), dims)
                for c in np.unique(cell):
                    if int(c) in shared.value:
                        tree, start = shared.value[int(c)]
                        at = np.flatnonzero(cell == c)
                        cell[at] = start + tree.of(p[at])
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cell.astype(np.int32))], names=["vid", "vec", "p", "cell"])

        coarse, placed = placed, checkpoint(placed.mapInArrow(split, "vid long, vec array<float>, p array<double>, cell int"))
        if hasattr(coarse, "_written_at"):
            release(coarse)
    return placed


def nearest(vectors: DataFrame, k: int = K, least: float = LEAST_COSINE, width: int = WIDTH, certainty: float = CERTAINTY, dims: int = DIMS, last: bool = False) -> DataFrame:
    """(vid, other, cosine): for each distinct vector its k most similar others of cosine >= ``least``.

    With ``last``, the table of ``vectors`` is removed as soon as it is placed.
    """
    with scratch() as keep:
        best = _nearest(vectors, k, least, width, certainty, dims, last)
        keep(best)
    return _top(best, k, least)


def _nearest(vectors: DataFrame, k: int, least: float, width: int, certainty: float, dims: int, last: bool) -> DataFrame:
    """(vid, others, cosines), written: the lists of every vector."""
    spark = vectors.sparkSession
    w = directions(width, dims)
    chi = chi_square_quantile(certainty, dims)
    n = vectors.count()
    # One of every vector by hash, the smallest first: a sample of bounded size that no row order changes.
    sample = vectors.orderBy("vid").limit(SAMPLE).select("vec").toArrow()
    fit = unit(matrix(sample.column(0), width)) @ w if n else np.zeros((0, dims))
    want = max(math.ceil(n / CELL), min(4 * spark.sparkContext.defaultParallelism, math.ceil(n / 1024)), 1)
    tree = Cells(fit, min(max(0, math.ceil(math.log2(want))), int(math.log2(SAMPLE / 16))))
    shared = spark.sparkContext.broadcast((w, tree))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, tree = shared.value
        for b in batches:
            if b.num_rows:
                p = unit(matrix(b.column(1), width)) @ w
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, dims), pa.int32()), pa.array(p.ravel())), pa.array(tree.of(p).astype(np.int32))], names=["vid", "vec", "p", "cell"])

    placed = checkpoint(vectors.select("vid", "vec").mapInArrow(place, "vid long, vec array<float>, p array<double>, cell int"))
    if last:
        release(vectors)
    placed = refined(placed, dims, CELL)
    bounds = [f(F.get("p", F.lit(i))).alias(f"{s}{i}") for s, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *bounds).collect()  # one row a cell, about rows / CELL
    cells = sorted(r["cell"] for r in boxes)
    by = {r["cell"]: r for r in boxes}
    parts = {c: max(1, math.ceil(by[c]["n"] / CELL)) for c in cells}
    lo = np.array([[by[c][f"lo{i}"] for i in range(dims)] for c in cells]).reshape(-1, dims)
    hi = np.array([[by[c][f"hi{i}"] for i in range(dims)] for c in cells]).reshape(-1, dims)
    split = spark.createDataFrame([(c, parts[c]) for c in cells], "cell int, parts int")
    data = placed.join(F.broadcast(split), "cell").withColumn("sub", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))

    def own(t: pa.Table) -> pa.Table:
        ids, v, p = t.column("vid").to_numpy(), unit(matrix(t.column("vec"), width)), matrix(t.column("p"), dims)
        i, c = search(v, p, np.full(len(v), least - 1e-12), ids, v, p, ids, k, chi)
        return found(ids, i, c, k)

    best = checkpoint(data.select("cell", "sub", "vid", "vec", "p").groupBy("cell", "sub").applyInArrow(own, LISTS))
    if len(cells) == 1 and parts[cells[0]] == 1:
        return best
    item_cell = np.repeat(np.array(cells, np.int32), [parts[c] for c in cells])
    item_sub = np.concatenate([np.arange(parts[c], dtype=np.int32) for c in cells]) if cells else np.zeros(0, np.int32)
    at = np.repeat(np.arange(len(cells)), [parts[c] for c in cells])
    frame = spark.sparkContext.broadcast((item_cell, item_sub, lo[at], hi[at]))

    def ordered(p: np.ndarray, cell: np.ndarray, sub: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query, the other cells with the nearest first, and how many of them the test leaves."""
        of, part, lo, hi = frame.value
        far = box_distance(p, lo, hi)
        far[(of[None] == cell[:, None]) & (part[None] == sub[:, None])] = np.inf
        return np.argsort(far, axis=1, kind="stable"), (far <= chi * (2 - 2 * worst)[:, None]).sum(axis=1)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                p, cell, sub, worst, done = matrix(b.column(1), dims), *(b.column(i).to_numpy() for i in range(2, 6))
                more = ordered(p, cell, sub, worst)[1] - done
                rows = pa.array(np.flatnonzero(more > 0))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(6)), pa.array(more[more > 0].astype(np.int32))], names=["vid", "p", "cell", "sub", "worst", "done", "more"])

    worst = F.when(F.size("cosines") >= k, F.array_min("cosines")).otherwise(F.lit(least - 1e-12)).alias("worst")
    rows = data.select("vid", "p", "cell", "sub").join(best.select("vid", worst), "vid").withColumn("done", F.lit(0))
    kept = "vid long, p array<double>, cell int, sub int, worst double, done int"
    asking = checkpoint(rows.mapInArrow(left, f"{kept}, more int"))

    while True:
        more = {r["more"]: r["n"] for r in asking.groupBy("more").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as cells at most
        if not more:
            return best
        quota = 1
        while quota < max(more) and sum(min(m, quota + 1) * c for m, c in more.items()) <= VISITS * n:
            quota += 1

        def visits(batches: Iterator[pa.RecordBatch], quota=quota) -> Iterator[pa.RecordBatch]:
            of, part = frame.value[:2]
            for whole in batches:
                for lo in range(0, whole.num_rows, 500):
                    b = whole.slice(lo, 500)
                    p, cell, sub, worst, done, more = matrix(b.column(1), dims), *(b.column(i).to_numpy() for i in range(2, 7))
                    order = ordered(p, cell, sub, worst)[0]
                    place = np.arange(len(of))[None]
                    r, c = np.nonzero((place >= done[:, None]) & (place < (done + np.minimum(more, quota))[:, None]))
                    to, r = order[r, c], pa.array(r)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(r), pa.array(of[to]), pa.array(part[to]), b.column(4).take(r)], names=["vid", "cell", "sub", "worst"])

        asks = checkpoint(asking.mapInArrow(visits, "vid long, cell int, sub int, worst double"))
        load = checkpoint(asks.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("slices")))  # a row a cell
        sent = asks.join(placed.select("vid", F.col("vec").alias("asked")), "vid").join(F.broadcast(load), ["cell", "sub"]).withColumn("slice", F.pmod(F.hash("vid"), F.col("slices")))
        copies = data.join(F.broadcast(load), ["cell", "sub"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

        def other(q: pa.Table, d: pa.Table) -> pa.Table:
            ids = q.column("vid").to_numpy()
            if not len(ids) or not d.num_rows:
                return found(ids[:0], np.zeros((0, k), np.int64), np.zeros((0, k)), k)
            qv, dv = unit(matrix(q.column("asked"), width)), unit(matrix(d.column("vec"), width))
            i, c = search(qv, qv @ w, q.column("worst").to_numpy(), ids, dv, dv @ w, d.column("vid").to_numpy(), k, chi)
            hit = (c > -2).any(axis=1)
            return found(ids[hit], i[hit], c[hit], k)

        to = ["cell", "sub", "slice"]
        more_lists = sent.select(*to, "vid", "asked", "worst").groupBy(*to).cogroup(copies.select(*to, "vid", "vec").groupBy(*to)).applyInArrow(other, LISTS)
        got = checkpoint(more_lists)
        release(asks)
        # the lists of those that found more are merged
        pair = F.transform(F.arrays_zip("others", "cosines"), lambda x: F.struct((-x["cosines"]).alias("far"), x["others"].alias("other")))
        lists = got.unionByName(best).select("vid", pair.alias("l")).groupBy("vid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, k).alias("l"))
        before, best = best, checkpoint(lists.select("vid", F.col("l.other").alias("others"), F.transform("l.far", lambda x: -x).alias("cosines")))
        release(before, got, load)
        again = asking.where(F.col("more") > quota).select("vid", "p", "cell", "sub", (F.col("done") + quota).alias("done"))
        rows = again.join(best.select("vid", worst), "vid").select("vid", "p", "cell", "sub", "worst", "done")
        before, asking = asking, checkpoint(rows.mapInArrow(left, f"{kept}, more int"))
        release(before)


def found(ids: np.ndarray, others: np.ndarray, cosines: np.ndarray, k: int) -> pa.Table:
    """One row for each query with what was found for it."""
    ok = cosines > -2
    offsets = pa.array(np.concatenate(([0], np.cumsum(ok.sum(axis=1)))), pa.int32())
    return pa.table({"vid": pa.array(ids, pa.int64()), "others": pa.ListArray.from_arrays(offsets, pa.array(others[ok], pa.int64())), "cosines": pa.ListArray.from_arrays(offsets, pa.array(cosines[ok], pa.float64()))})


def _top(lists: DataFrame, k: int, least: float) -> DataFrame:
    rows = lists.select("vid", F.explode(F.arrays_zip("others", "cosines")).alias("x")).select("vid", F.col("x.others").alias("other"), F.col("x.cosines").alias("cosine")).where(F.col("cosine") >= least)
    best = Window.partitionBy("vid").orderBy(F.desc("cosine"), "other")
    return rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def neighbours(df: DataFrame, id_col: str = "id", vector: str = "embedding", order: str | None = "received_at", k: int = K, least: float = LEAST_COSINE, width: int = WIDTH, certainty: float = CERTAINTY) -> DataFrame:
    """(id, neighbour_id, cosine): the k most similar other ids of every usable id."""
    members, vectors = distinct_vectors(usable(df, id_col, vector, order, width))
    pairs = nearest(vectors, k, least, width, certainty, last=True)
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    itself = members.select("vid", F.col("vid").alias("other"), F.lit(1.0).alias("cosine")).distinct()
    lists = pairs.unionByName(itself).join(few.select(F.col("vid").alias("other"), F.col("id").alias("neighbour_id")), "other")
    # ties at the k-th cosine may hold any number of ids, so the smaller ones are taken
    best = Window.partitionBy("vid").orderBy(F.desc("cosine"), "neighbour_id")
    lists = lists.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = lists.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour_id", "cosine"))).alias("l"))
    rows = members.join(lists, "vid").select("id", F.explode(F.slice(F.filter("l", lambda x: x["neighbour_id"] != F.col("id")), 1, k)).alias("x"))
    return rows.select("id", F.col("x.neighbour_id").alias("neighbour_id"), F.col("x.cosine").alias("cosine")).where(F.col("cosine") >= least)
