"""Problem 5: near-duplicate records with small edits.

The likeness of texts is that of their sets of words (or of word n-grams), so the
join is the product of the record-by-gram incidence matrix with its transpose, of
which only the entries above a size-derived bound matter.  It is taken in blocks:

* Equal sets are one row of the matrix, whatever the number of their records.
* The grams of a row are in one global order, rare ones first.  Two rows of
  likeness t have few grams outside their overlap, so the first k grams they
  share lie among the first n - ceil(t n) + k of each.  A block is the set of
  rows with the same first shared grams; a block of more than ``block`` rows is
  split by one more shared gram, again and again, so no block is ever large,
  however common a gram, and no pair is lost.
* The rows of a block meet by their sizes and a 128-bit image only; an entry of a
  block's product is started only if these allow the overlap that the bound asks
  for.  Started entries, each once, get the grams of their rows; the count is
  accumulated over the smaller row's grams, ``STRIDE`` at a time, and the entry is
  discarded as soon as what is left of the row cannot reach the bound any more.
* Blocks of one depth are taken in waves of ``WAVE`` rows for each row of the matrix,
  and only rows of blocks that are split again are written, so the disk that is in
  use at once follows the matrix, not the number of blocks.

Exact: every pair of likeness >= t is found.  Edge cases: NULL, empty and
wordless texts have no likeness and no partners; several texts of one id each
count; equal texts under several ids have likeness 1; repeated rows count once;
texts are read whole; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.p6_components import components
from graphloom.llm.words import PY_WORD, least_overlap, words
from graphloom.runtime import checkpoint, release, scratch, shuffles_end, written

LIKENESS = 0.7
#: Rows in a block before it is split by one more shared word.
BLOCK = 256
#: Rows of blocks in a wave for each row of the matrix.
WAVE = 8
#: Rows of a block that is not split any more on a side of a tile, twice; entries held at a time; grams that are accumulated between two looks at the bound.
TASK_ROWS, PAIRS, STRIDE = 200_000, 1_000_000, 8
#: Words that get a place in the global order by frequency; all rarer ones come before, by hash.
FREQUENT = 50_000
MET = "key long, sid long, pos int, n int, i0 long, i1 long, other long"
SETS = "sid long, n int, toks array<long>, b0 long, b1 long, b2 long, b3 long"


def grams_of(w: list[str], n: int) -> set[str]:
    """The distinct n-grams of consecutive words; a text of fewer words is one gram."""
    return set(w) if n == 1 else {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def frequent_words(texts: DataFrame, text: str, k: int = FREQUENT, gram: int = 1) -> dict[str, int]:
    """The ``k`` most frequent words or n-grams with their place, rarest first: a bounded table."""
    w = words(F.col(text))
    if gram > 1:
        w = F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - gram + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(gram)), " ")))
    with shuffles_end(texts.sparkSession):
        w = texts.select(F.explode(F.array_distinct(w)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
        top = w.where("c > 1").orderBy(F.desc("c"), "w").limit(k).select("w").collect()
    return {r[0]: len(top) - i for i, r in enumerate(top)}


def with_sets(texts: DataFrame, ids: list[str], text: str, order: dict[str, int], gram: int = 1) -> DataFrame:
    """(ids..., sid, n, toks, b0..b3): each text with words as its set of words in the global order.

    A word of ``order`` stands by its place, any other by its hash.
    """
    places = texts.sparkSession.sparkContext.broadcast(order)
    kinds = dict(texts.dtypes)
    order_given = bool(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, h64 = places.value.get, xxhash.xxh64_intdigest
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                rows, sids, ns, toks, bits = [], [], [], [], []
                for r, t in enumerate(b.column(len(ids)).to_pylist()):
                    w = grams_of(PY_WORD.findall(t.lower()), gram) if t else ()
                    if not w:
                        continue
                    a = np.array([h64(x) for x in w], np.uint64)
                    p = np.array([get(x, 0) for x in w], np.int64)
                    at = np.lexsort((a, p))
                    a, p = a[at], p[at]
                    tok = np.where(p > 0, p, (a | np.uint64(1 << 63)).view(np.int64)) if order_given else a.view(np.int64)
                    image = np.zeros(4, np.uint64)
                    np.bitwise_or.at(image, (a >> np.uint64(8)) & np.uint64(3), np.uint64(1) << (a & np.uint64(63)))
                    rows.append(r), ns.append(len(a)), toks.append(tok), bits.append(image.view(np.int64))
                    sids.append(xxhash.xxh64_intdigest(np.sort(a).tobytes()))
                image = np.array(bits, np.int64).reshape(-1, 4)
                flat = np.concatenate(toks) if toks else np.zeros(0, np.int64)
                offsets = np.concatenate(([0], np.cumsum(ns))).astype(np.int32)
                take = pa.array(rows, pa.int64())
                cols = [b.column(i).take(take) for i in range(len(ids))]
                cols += [pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(ns, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))]
                cols += [pa.array(np.ascontiguousarray(image[:, i])) for i in range(4)]
                yield pa.RecordBatch.from_arrays(cols, names=[*ids, "sid", "n", "toks", "b0", "b1", "b2", "b3"])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in ids) + SETS
    return texts.select(*ids, text).mapInArrow(run, schema)


def _alpha(n, t: float):
    """Smallest overlap of a row of ``n`` words with anything of likeness ``t``."""
    return F.ceil(n * F.lit(t) - 1e-9).cast("int")


def meet(batches: Iterator[pa.RecordBatch], t: float, block: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, sid, pos, n, i0, i1, c) with each key's together: of blocks of up to ``block`` rows the pairs that
    sizes and images allow, as (sid, other), other rows as they are."""
    names = [x.split()[0] for x in MET.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def pairs(key: np.ndarray, sid: np.ndarray, n: np.ndarray, i0: np.ndarray, i1: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(start, len(key)))
        place = np.arange(len(key)) - np.repeat(start, length)  # of a row in its block
        left = np.repeat(length, length) - 1 - place  # rows behind it
        at = 0
        while at < len(key):  # as many rows of blocks as PAIRS pairs allow, with the rows behind them
            upto = at + max(1, int(np.searchsorted(np.cumsum(left[at:]), PAIRS, side="right")))
            x = np.repeat(np.arange(at, min(upto, len(key))), left[at:upto])
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(left[at:upto]) - left[at:upto], left[at:upto])
            at = upto
            total = n[x] + n[y]
            need = np.ceil(t / (1 + t) * total - 1e-9).astype(np.int64)
            ok = np.flatnonzero((need <= np.minimum(n[x], n[y])) & (sid[x] != sid[y]))
            x, y, most = x[ok], y[ok], (total - 2 * need)[ok]
            differ = np.bitwise_count(i0[x] ^ i0[y]).astype(np.int64) + np.bitwise_count(i1[x] ^ i1[y])
            x, y = x[differ <= most], y[differ <= most]
            if len(x):
                both = np.unique(np.stack([np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])]), axis=1)
                void = [pa.nulls(both.shape[1], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([void[0], pa.array(both[0]), *void[2:6], pa.array(both[1])], names=names)

    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if block is not None:
            hot = np.flatnonzero(b.column(6).to_numpy() > block)
            if len(hot):
                rows = b.take(pa.array(hot))
                yield pa.RecordBatch.from_arrays([*rows.columns[:6], pa.nulls(len(hot), pa.int64())], names=names)
            b = b.take(pa.array(np.flatnonzero(b.column(6).to_numpy() <= block)))
        new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy().astype(np.int64), *(b.column(i).to_numpy().view(np.uint64) for i in (4, 5))]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]):
            whole = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if held[0][0] != held[0][-1] else 0
            if whole:
                yield from pairs(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
    if held is not None and len(held[0]):
        yield from pairs(*held)


def met(state: DataFrame, t: float, block: int | None) -> DataFrame:
    """``MET``, written: the pairs of the blocks of ``state``, and the rows of blocks that are too large."""
    counted = state.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("c > 1")
    rows = counted.select("key", "sid", F.col("pos").cast("int").alias("pos"), "n", "i0", "i1", "c")
    return checkpoint(rows.mapInArrow(lambda batches: meet(batches, t, block), MET))


def tiled(rows: DataFrame) -> DataFrame:
    """Blocks of more than ``TASK_ROWS`` rows, all of which may reach the bound, as tiles of pairs of parts."""
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > TASK_ROWS)
    parts = held.select("key", F.ceil(F.col("c") / (TASK_ROWS // 2)).cast("int").alias("parts"))  # at most rows / TASK_ROWS keys
    rows = rows.join(F.broadcast(parts), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("i", F.pmod(F.hash("sid"), F.col("parts"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.xxhash64("key", F.least("i", "o"), F.greatest("i", "o"))
    return rows.withColumn("key", F.when(F.col("parts") > 1, tile).otherwise(F.col("key"))).drop("parts", "i", "o")


def candidates(sets: DataFrame, t: float = LIKENESS, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: pairs of rows that share a block and whose sizes and images allow likeness ``t``."""
    keep = ["sid", "n", "i0", "i1"]
    sets = sets.select("sid", "n", "toks", F.col("b0").bitwiseOR(F.col("b2")).alias("i0"), F.col("b1").bitwiseOR(F.col("b3")).alias("i1"))
    first = F.col("n") - _alpha(F.col("n"), t)  # the words that may lie outside the overlap
    n, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(first + 1), F.lit(0))).first()
    if not n:
        return sets.sparkSession.createDataFrame([], "a long, b long")
    waves = max(1, -(-int(total) // (WAVE * n)))
    state = sets.select(F.posexplode(F.slice("toks", F.lit(1), (first + 1).cast("int"))).alias("pos", "key"), *keep)
    found = [met(state.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == w), t, block) for w in range(waves)]
    done = [_pairs_of(x) for x in found]
    level = 1
    while True:
        hot = None
        for x in found:
            rows = x.where("other is null")
            hot = rows if hot is None else hot.unionByName(rows)
        upto = F.least(F.col("n"), F.col("n") - _alpha(F.col("n"), t) + level + 1)
        total = hot.agg(F.sum(F.greatest(upto - F.col("pos") - 1, F.lit(0)))).first()[0]
        if total is None:
            release(*found)
            break
        hot = checkpoint(hot.drop("other"))
        release(*found)
        # Rows whose overlap may end here: pairs of sizes for which the words so far suffice.
        ends = hot.where(_alpha(F.col("n"), t) <= level)
        ends = ends.withColumn("m", F.explode(F.sequence(F.lit(level), F.floor(F.lit(level) / t + 1e-9).cast("int"))))
        ends = ends.where(least_overlap(F.col("n"), F.col("m"), t) <= level)
        ends = ends.withColumn("key", F.xxhash64("key", F.least("n", "m"), F.greatest("n", "m"), F.lit("end"))).drop("m")
        if not ends.isEmpty():
            last = met(tiled(ends), t, None)
            done.append(_pairs_of(last))
            release(last)
        # Everything else shares at least one more word: the first of them splits the block.
        waves = max(1, -(-int(total) // (WAVE * n)))
        found = []
        for w in range(waves):
            rest = hot.where((F.col("pos") + 1 < upto) & (F.pmod(F.xxhash64("key"), F.lit(waves)) == w)).join(sets.select("sid", "toks"), "sid")
            nxt = F.transform(F.sequence(F.col("pos") + 1, (upto - 1).cast("int")), lambda i: F.struct(i.alias("pos"), F.get("toks", i).alias("tok")))
            state = rest.withColumn("x", F.explode(nxt)).select(F.col("x.pos").alias("pos"), F.xxhash64("key", "x.tok").alias("key"), *keep)
            found.append(met(state, t, block))
            done.append(_pairs_of(found[-1]))
        release(hot)
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _pairs_of(rows: DataFrame) -> DataFrame:
    """(a, b), written: the pairs of ``MET``, each once."""
    return checkpoint(rows.where("other is not null").select(F.col("sid").alias("a"), F.col("other").alias("b")).distinct())


def accumulated(row: np.ndarray, gram: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Which entries (a, b) of the product of the incidence (row, gram) reach the bound, and their counts: 0 where not.

    ``row`` is sorted, ``gram`` holds numbers from 0 in each row's order; ``size`` counts the grams of a row.
    """
    first = np.concatenate(([0], np.cumsum(size)))
    width = int(gram.max()) + 1 if len(gram) else 1
    cells = np.sort(row * width + gram)
    small, large = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    need = np.ceil(t / (1 + t) * (size[a] + size[b]) - 1e-9).astype(np.int64)
    count = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for at in range(0, int(size[small].max()) if len(a) else 0, STRIDE):
        take = np.minimum(STRIDE, size[small[live]] - at)
        begin = first[small[live]] + at
        part = np.repeat(np.cumsum(take) - take, take)
        grams = gram[np.repeat(begin, take) + np.arange(len(part)) - part]
        ask = np.repeat(large[live], take) * width + grams
        at_cell = np.searchsorted(cells, ask)
        hit = cells[np.minimum(at_cell, len(cells) - 1)] == ask
        count[live] += np.add.reduceat(hit, np.cumsum(take) - take)
        left = size[small[live]] - at - take
        possible = count[live] + left >= need[live]
        count[live[~possible]] = 0
        live = live[possible & (left > 0)]
        if not len(live):
            break
    return np.where(count >= need, count, 0)


def products(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(a, b, likeness): the entries (a, b) of the product that reach the bound."""
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("toks").alias(f"t{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = b.num_rows
            size = np.concatenate([b.column(i).value_lengths().to_numpy() for i in (2, 3)]).astype(np.int64)
            gram = np.unique(np.concatenate([b.column(i).flatten().to_numpy() for i in (2, 3)]), return_inverse=True)[1].astype(np.int64)
            c = accumulated(np.repeat(np.arange(2 * m), size), gram, size, np.arange(m), np.arange(m, 2 * m), t)
            ok = np.flatnonzero(c)
            rows = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(c[ok] / (size[ok] + size[m + ok] - c[ok]))], names=["a", "b", "likeness"])

    return full.mapInArrow(multiply, "a long, b long, likeness double")


def similar_sets(sets: DataFrame, t: float = LIKENESS, block: int = BLOCK) -> DataFrame:
    """(a, b, likeness), a < b, written: all pairs of different sets (one row each) of likeness >= ``t``."""
    with scratch() as keep:
        out = checkpoint(products(candidates(sets, t, block), sets, t))
        keep(out)
    return out


def incidence(df: DataFrame, id_col: str, text: str, gram: int = 1) -> tuple[DataFrame, DataFrame]:
    """(id, sid) and the distinct sets behind it, both written."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").distinct()
    order = frequent_words(rows, "text", gram=gram)
    whole = written(with_sets(rows, ["id"], "text", order, gram), "incidence")
    members = checkpoint(whole.select("id", "sid").distinct())
    sets = checkpoint(whole.drop("id").dropDuplicates(["sid"]))
    release(whole)
    return members, sets


def near_duplicates(df: DataFrame, id_col: str = "id", text: str = "content", t: float = LIKENESS, block: int = BLOCK, gram: int = 1) -> DataFrame:
    """(id_a, id_b), id_a < id_b: ids with texts of likeness >= ``t``."""
    members, sets = incidence(df, id_col, text, gram)
    pairs = similar_sets(sets, t, block).select("a", "b")
    release(sets)
    ma, mb = members.select(F.col("id").alias("ia"), F.col("sid").alias("a")), members.select(F.col("id").alias("ib"), F.col("sid").alias("b"))
    across = pairs.join(ma, "a").join(mb, "b").where("ia <> ib")
    across = across.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    same = ma.join(mb, F.col("a") == F.col("b")).where("ia < ib").select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"))
    return across.unionByName(same).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str = "id", text: str = "content", t: float = LIKENESS, block: int = BLOCK, gram: int = 1) -> DataFrame:
    """(id, group_id, links): every id with a partner, its group's smallest id, and its number of links.

    Links are between different sets of words; equal sets are members of one.
    """
    members, sets = incidence(df, id_col, text, gram)
    pairs = similar_sets(sets, t, block).select("a", "b")
    release(sets)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    group = components(pairs, "a", "b").select(F.col("id").alias("sid"), F.col("group_id").alias("g"))
    several = members.groupBy("sid").agg(F.count(F.lit(1)).alias("c"))
    rows = members.join(several, "sid").join(ends, "sid", "left").join(group, "sid", "left").where("links is not null or c > 1")
    rows = rows.select("id", "sid", F.coalesce("g", "sid").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    # An id with several texts joins their groups.
    first = rows.groupBy("id").agg(F.min("g").alias("a"), F.sum("links").alias("links"))
    chains = rows.join(first, "id").where("g <> a").select("a", F.col("g").alias("b"))
    merged = components(chains, "a", "b").select(F.col("id").alias("a"), F.col("group_id").alias("m"))
    named = first.join(merged, "a", "left").select("id", F.coalesce("m", "a").alias("g"), "links")
    least = named.groupBy("g").agg(F.min("id").alias("group_id"))
    return named.join(least, "g").select("id", "group_id", "links")

