"""Problem 9: evaluation texts that leak into training text.

The n-grams (12 consecutive words by default) of all evaluation items form a
hash set that is broadcast; each document is scanned once, window by window.
Words outside the items' vocabulary end a window at once, so almost all windows
cost one dictionary look-up a word; the rest are looked up whole, which verifies
the hit in the same step (keys are the words' numbers, not lossy hashes).

The broadcast is bounded: the items' characters are summed first, and beyond
``broadcast_chars`` the items are taken in blocks of that size, each scanned
against all documents.  No document is left out and nothing is collected from
the documents.

Edge cases: NULL, empty and wordless texts never match; an item with fewer
words than ``n`` has no n-gram and never matches; repeated documents each give
their rows, repeated items too; texts are scanned whole; empty tables give an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.words import PY_WORD

NGRAM = 12
#: Characters of evaluation text in one broadcast set (about 40 bytes of memory each).
BROADCAST_CHARS = 4_000_000


class NGrams:
    """The items' n-grams by their words' numbers."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.number: dict[str, int] = {}
        self.items: dict[bytes, tuple[int, ...]] = {}
        for item, text in items:
            w = PY_WORD.findall(text.lower())
            if len(w) < n:
                continue
            a = np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], np.int32)
            for i in range(len(a) - n + 1):
                k = a[i : i + n].tobytes()
                if item not in self.items.get(k, ()):
                    self.items[k] = (*self.items.get(k, ()), item)

    def hits(self, words: list[str]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(start, items) of each window of ``words`` that is an n-gram of an item."""
        get, n = self.number.get, self.n
        if len(words) < n:
            return
        a = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.cumsum(np.concatenate(([0], a > 0)))
        for i in np.flatnonzero(known[n:] - known[:-n] == n):
            found = self.items.get(a[i : i + n].tobytes())
            if found:
                yield int(i), found


def _blocks(items: DataFrame, item_id: str, text: str, broadcast_chars: int) -> Iterator[list[tuple[int, str]]]:
    items = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null and i is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-int(chars) // broadcast_chars))
    if n == 1:
        yield [tuple(r) for r in items.collect()]
        return
    block = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    for b in range(n):
        # rows arrive by partitions; a block whose hash drew more than its share is given out in parts, so each holds the bound (or one item)
        part, size = [], 0
        for r in block.where(F.col("b") == b).select("i", "t").toLocalIterator():
            if part and size + len(r["t"]) > broadcast_chars:
                yield part
                part, size = [], 0
            part.append(tuple(r))
            size += len(r["t"])
        if part:
            yield part


def _scan(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, n: int, broadcast_chars: int, emit, schema: str) -> DataFrame:
    out = None
    sc = docs.sparkSession.sparkContext
    for block in _blocks(items, item_id, item_text, broadcast_chars):
        grams = sc.broadcast(NGrams(block, n))

        def run(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield emit(b, grams.value)

        got = docs.select(doc_id, text).mapInArrow(run, schema)
        out = got if out is None else out.unionAll(got)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = NGRAM, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Distinct (doc_id, item_id): the document holds ``n`` consecutive words of the item."""
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]

    def emit(b: pa.RecordBatch, grams: NGrams) -> pa.RecordBatch:
        row, item = [], []
        for r, t in enumerate(b.column(1).to_pylist()):
            if t:
                found = {i for _, hit in grams.hits(PY_WORD.findall(t.lower())) for i in hit}
                row += [r] * len(found)
                item += sorted(found)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(item, item_type)], names=["doc_id", "item_id"])

    item_type = pa.string() if kinds[1] == "string" else pa.int32() if kinds[1] == "int" else pa.int64()
    return _scan(docs, items, doc_id, text, item_id, item_text, n, broadcast_chars, emit, f"doc_id {kinds[0]}, item_id {kinds[1]}").distinct()


def spans(text: str) -> list[tuple[int, int]]:
    """The place of each word."""
    low = text.lower()
    return [m.span() for m in PY_WORD.finditer(low if len(low) == len(text) else text)]


def cut_out(text: str, places: list[tuple[int, int]], gone: np.ndarray) -> str:
    """The text without the words marked, nor what stands between two of them."""
    parts, at = [], 0
    for i in np.flatnonzero(gone):
        if i == 0 or not gone[i - 1]:
            parts.append(text[at : places[i][0]])
        at = places[i][1]
    return "".join(parts) + text[at:]


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = NGRAM, drop_share: float = 0.5, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, text, removed): every text with its leaked spans cut out.

    ``removed`` is the number of words cut; a document of which more than
    ``drop_share`` of the words leaked is dropped, and NULL texts stay NULL.
    Every block of items gives the starts of its hits in each text; the starts of
    all blocks are joined by text before anything is cut, so any number of items
    is taken.  Equal texts are scanned and cut alike.
    """
    kind = dict(docs.dtypes)[doc_id]

    def starts(b: pa.RecordBatch, grams: NGrams) -> pa.RecordBatch:
        found = [sorted({i for i, _ in grams.hits([t[a:z].lower() for a, z in spans(t)])}) if t else [] for t in b.column(1).to_pylist()]
        keep = pa.array([bool(f) for f in found], pa.bool_())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["k", "starts"]).filter(keep)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("k", F.sha2(F.col("text"), 256))
    hits = _scan(rows, items, "k", "text", item_id, item_text, n, broadcast_chars, starts, "k string, starts array<int>")
    hits = hits.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                rows, texts, removed = [], [], []
                for r, (t, s) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    k = 0
                    if t and s:
                        places = spans(t)
                        gone = np.zeros(len(places), bool)
                        for i in s:
                            gone[i : i + n] = True
                        k = int(gone.sum())
                        if k > drop_share * len(places):
                            continue
                        t = cut_out(t, places, gone)
                    rows.append(r), texts.append(t), removed.append(k)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["doc_id", "text", "removed"])

    return rows.join(hits, "k", "left").select("doc_id", "text", "starts").mapInArrow(cut, f"doc_id {kind}, text string, removed int")
