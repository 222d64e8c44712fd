"""Vector, full-text and substring search, and the fusion of rankings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import written

#: BM25's usual parameters, and the constant of reciprocal rank fusion (fixed values).
K1, B, RRF = 1.2, 0.75, 60
#: Folders of a written text or trigram index; rows on which an index of vectors is fitted.
BUCKETS, SAMPLE = 64, 20_000
#: Rows of a list that one task compares.
PART = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Smaller is nearer: cosine 1 - cos, l2 the Euclidean distance, ip minus the inner product."""
    if metric == "cosine":
        return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
    if metric == "ip":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric}")


def vector_search(df: DataFrame, vector: str, query: list[float], k: int, metric: str = "cosine", id_col: str = "_id") -> DataFrame:
    """(id, distance): the k nearest rows; one scan and a bounded top-k, no shuffle of the table.

    Rows without a vector, or of another dimension, are not candidates; ties go to the smaller id.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = df.where(F.size(vector) == len(query)).select(F.col(id_col), distance(F.col(vector), q, metric).alias("distance"))
    return rows.where("distance is not null").orderBy("distance", id_col).limit(k)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


class TextIndex:
    """Postings (term, id, tf), lengths and the corpus figures; ``saved`` writes them, sorted by term."""

    buckets = False

    def __init__(self, df: DataFrame, id_col: str, text: str):
        self.id, self.of = id_col, df
        docs = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), terms(F.col(text)).alias("ts"))
        self.lengths = docs.select("id", F.size("ts").alias("len"))
        self.postings = docs.select("id", F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
        self.totals = self.lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avgdl"))

    def saved(self) -> TextIndex:
        """The index as files: postings in buckets of their terms, so a query reads those of its words."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        self.postings = written(self.postings.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("term"), "postings", ["bucket"])
        self.lengths, self.totals, self.buckets = written(self.lengths, "lengths"), written(self.totals, "totals"), True
        return self

    def scores(self, query: str, ids: DataFrame | None = None) -> DataFrame:
        """(id, score) of every document with a term of the query.

        The filter on the query's terms is pushed below the aggregate to the scan;
        only the matching postings are shuffled.
        """
        words = sorted(set(w for w in re.split(r"[^\w]+|_", query.lower()) if w))
        hit = self.postings.where(F.col("term").isin(words))
        if self.buckets:
            of = F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")
            here = [r[0] for r in hit.sparkSession.createDataFrame([(w,) for w in words], "w string").select(of).collect()]
            hit = hit.where(F.col("bucket").isin(here)).drop("bucket")
        df_ = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        both = hit.join(F.broadcast(df_), "term").crossJoin(F.broadcast(self.totals))
        if ids is not None:
            both = both.join(ids, both["id"] == ids[ids.columns[0]], "left_semi")
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
        return both.select("id", part.alias("part")).groupBy("id").agg(F.sum("part").alias("score"))

    def search(self, query: str, k: int) -> DataFrame:
        return self.scores(query).orderBy(F.desc("score"), "id").limit(k)


def trigrams(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(gram, id): the distinct 3-character pieces of every text, for CONTAINS on large tables."""
    n = F.length(text)
    grams = F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(F.col(text), i, F.lit(3))))).otherwise(F.array(F.col(text)))
    return df.where(F.col(text).isNotNull()).select(F.explode(grams).alias("gram"), F.col(id_col).alias("id"))


class TrigramIndex:
    """The trigrams of a column; ``saved`` writes them in buckets of their grams."""

    buckets = False

    def __init__(self, df: DataFrame, id_col: str, text: str):
        self.of, self.grams = df, trigrams(df, id_col, text)

    def saved(self) -> TrigramIndex:
        bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")
        self.grams, self.buckets = written(self.grams.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("gram"), "grams", ["bucket"]), True
        return self

    def candidates(self, pattern: str) -> DataFrame:
        """(id): the rows that hold every trigram of the pattern, which has at least three characters."""
        want = sorted({pattern[i : i + 3] for i in range(len(pattern) - 2)})
        hit = self.grams.where(F.col("gram").isin(want))
        if self.buckets:
            of = F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int")
            hit = hit.where(F.col("bucket").isin([r[0] for r in hit.sparkSession.createDataFrame([(g,) for g in want], "g string").select(of).collect()]))
        return hit.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(want)).select("id")


def scaled(v, metric: str):
    """Vectors of length 1 for the cosine, else as they are."""
    import numpy as np

    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12) if metric == "cosine" else v


class VectorIndex:
    """Inverted lists: every row lies in the list of its nearest centroid; a query reads the nearest lists.

    Centroids are fitted by k-means on a bounded sample (``SAMPLE`` rows, the smallest by hash); every row is
    indexed.  ``saved`` writes one folder a list, so a search prunes the others.  ``probes`` lists are read and
    their rows ranked by their true distance; with as many probes as lists the answer is exact.
    """

    def __init__(self, df: DataFrame, id_col: str, vector: str, metric: str = "cosine", lists: int | None = None):
        import numpy as np

        self.of, self.metric = df, metric
        rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        width = rows.select(F.size("v").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
        self.width = width["n"] if width else 0
        rows = rows.where(F.size("v") == self.width)
        sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").collect()], float).reshape(-1, max(1, self.width))
        count = lists or max(1, min(1024, int(len(sample) ** 0.5)))
        self.centroids = self._means(self._scaled(sample), min(count, len(sample))) if len(sample) else np.zeros((1, max(1, self.width)))
        shared = df.sparkSession.sparkContext.broadcast(self.centroids)
        kind = dict(rows.dtypes)["id"]

        def assign(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    v = scaled(np.array(b.column(1).to_pylist(), float), metric)
                    c = shared.value
                    near = np.argmin((c * c).sum(axis=1)[None] - 2 * v @ c.T, axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=["id", "v", "list"])

        self.rows = rows.mapInArrow(assign, f"id {kind}, v array<double>, list int")

    def _scaled(self, v):
        return scaled(v, self.metric)

    @staticmethod
    def _means(sample, k: int, rounds: int = 10):
        import numpy as np

        c = sample[np.random.default_rng(11).permutation(len(sample))[:k]].copy()
        for _ in range(rounds):
            near = np.argmin((c * c).sum(axis=1)[None] - 2 * sample @ c.T, axis=1)
            total, n = np.zeros_like(c), np.bincount(near, minlength=k)
            np.add.at(total, near, sample)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        return c

    def saved(self) -> VectorIndex:
        self.rows = written(self.rows.repartition("list"), "lists", ["list"])
        return self

    def pairs(self, k: int, most: float) -> DataFrame:
        """(id, other, distance): for every row its k nearest others by cosine distance up to ``most``, over two lists."""
        return _pairs(self, k, most)

    def search(self, query: list[float], k: int, probes: int = 8) -> DataFrame:
        """(id, distance): the k nearest rows of the lists read; ties go to the smaller id."""
        import numpy as np

        q = self._scaled(np.array(query, float))
        if len(q) != self.width:
            return self.rows.select("id", F.lit(0.0).alias("distance")).where("false")
        # for the inner product the lists whose centroids have the largest one, else the nearest
        far = -self.centroids @ q if self.metric == "ip" else ((self.centroids - q) ** 2).sum(axis=1)
        near = np.argsort(far, kind="stable")[:probes].tolist()
        return vector_search(self.rows.where(F.col("list").isin(near)), "v", query, k, self.metric, "id")


def _pairs(index: VectorIndex, k: int, most: float) -> DataFrame:
    """(id, other, distance): for every row its k nearest others of its own list and the next nearest one, up to ``most``.

    Rows meet by list; a list of more than ``PART`` rows is split, and every part of the askers meets every part.
    """
    import numpy as np

    shared, metric, width = index.of.sparkSession.sparkContext.broadcast(index.centroids), index.metric, index.width
    kind = dict(index.rows.dtypes)["id"]

    def second(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            v = scaled(np.array(b.column(1).to_pylist(), float), metric)
            c = shared.value
            order = np.argsort((c * c).sum(axis=1)[None] - 2 * v @ c.T, axis=1, kind="stable")[:, :2]
            for j in range(order.shape[1]):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(order[:, j].astype(np.int32))], names=["id", "v", "list"])

    asks = index.rows.select("id", "v").mapInArrow(second, f"id {kind}, v array<double>, list int")
    parts = index.rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # one row a list
    asks = asks.join(F.broadcast(parts), "list").withColumn("a", F.pmod(F.hash("id"), F.col("parts"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    data = index.rows.select("id", "v", "list").join(F.broadcast(parts), "list").withColumn("b", F.pmod(F.hash("id"), F.col("parts"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def near(q, d):
        import pyarrow as pa

        ids, other = q.column("id").to_pylist(), d.column("id").to_pylist()
        x, y = (scaled(np.array(t.column("v").to_pylist(), float).reshape(-1, width), "cosine") for t in (q, d))
        out: list[tuple] = []
        for lo in range(0, len(ids), 512):
            if not len(other):
                break
            far = 1 - x[lo : lo + 512] @ y.T
            for i, row in enumerate(np.argsort(far, axis=1, kind="stable")[:, : k + 1]):
                out += [(ids[lo + i], other[j], float(far[i, j])) for j in row if far[i, j] <= most and other[j] != ids[lo + i]]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table([pa.array(cols[0], q.schema.field("id").type), pa.array(cols[1], q.schema.field("id").type), pa.array(cols[2], pa.float64())], names=["id", "other", "distance"])

    at = ["list", "a", "b"]
    met = asks.select("id", "v", *at).groupBy(*at).cogroup(data.select("id", "v", *at).groupBy(*at)).applyInArrow(near, f"id {kind}, other {kind}, distance double")
    best = Window.partitionBy("id").orderBy("distance", "other")
    return met.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def contains(df: DataFrame, id_col: str, text: str, pattern: str, index: DataFrame | None = None) -> DataFrame:
    """The rows whose text holds the pattern; with an index only its candidates are read, then verified."""
    rows = df
    if index is not None and len(pattern) >= 3:
        grams = sorted({pattern[i : i + 3] for i in range(len(pattern) - 2)})
        found = index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select(F.col("id").alias("_c"))
        rows = df.join(found, F.col(id_col) == F.col("_c"), "left_semi")
    return rows.where(F.col(text).contains(pattern))


def fuse(arms: list[DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """(id, score): reciprocal rank fusion of bounded rankings (id, rank from 0)."""
    out = None
    for a in arms:
        part = a.select("id", (1.0 / (F.lit(constant) + F.col("rank") + 1)).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ranked(top: DataFrame, order: Column) -> DataFrame:
    """Numbers a top-k result from 0; it holds at most k rows, so one partition is enough."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(order, "id")) - 1)
