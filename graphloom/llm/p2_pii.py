"""Problem 2: personal information inside free text.

Every text is tagged character by character by a bidirectional LSTM with CRF
transitions (p2_model; trained by p2_train from labelled spans, the weights lie
beside it).  Windows overlap; each character takes its scores from the window in
which it is farthest from an edge, and one Viterbi pass over the whole text
reconciles them.  A span found this way is kept only if it has the form of such an
item at all (an address has a number, a name two words, ...); no word list decides.

The operator is a narrow map: no shuffle but the spreading of small inputs over
the cores, one broadcast of fixed size (the weights), whole texts.

Edge cases: NULL, empty and blank texts hold nothing and are returned as they
are; escapes (HTML, JSON) are resolved for the tagger and the spans mapped back
to the raw text; texts of any length are tagged whole in bounded memory;
repeated rows are tagged each; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.p2_model import KINDS, Tagger, codes, units
from graphloom.runtime import spread

TEXTS = 400
WORD = re.compile(r"[^\W\d_]+")
AT = re.compile(r"@|\bat\b|[\[(]\s?at\s?[\])]", re.I)
SHORT = re.compile(r"\b[^\W\d_]{1,5}\.$")  # an abbreviation keeps its full stop
DOT = re.compile(r"\.|\bdot\b", re.I)


def plausible(kind: str, s: str) -> bool:
    """Whether the characters of ``s`` have the form of an item of that kind; no word is looked up."""
    digits = sum(c.isdigit() for c in s)
    words = WORD.findall(s)
    if kind == "EMAIL":
        at = AT.search(s)
        return bool(at and at.start() > 0 and DOT.search(s, at.end()))
    if kind == "PHONE":
        return 6 <= digits <= 17
    if kind == "ID_NUMBER":
        return digits >= 4 and len(s) <= 60
    if kind == "ADDRESS":
        return digits >= 1 and sum(map(len, words)) >= 4 and len(s) <= 120
    return not digits and len(words) >= 2 and max(map(len, words)) >= 2 and len(s) <= 80


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each run of tags; a continuation without a start begins one."""
    out = []
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    starts = (tags > 0) & ((tags % 2 == 1) | (np.concatenate(([-1], kind[:-1])) != kind))
    for s in np.flatnonzero(starts):
        e = s + 1
        while e < len(tags) and kind[e] == kind[s] and not starts[e]:
            e += 1
        out.append((int(s), int(e), KINDS[kind[s]]))
    return out


def detect(model: Tagger, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """The items of each text, as spans of the raw text."""
    clean = [units(t) if t and t.strip() else ("", np.zeros(1, int)) for t in texts]
    out = []
    for (plain, at), tags in zip(clean, model.tag([codes(p) for p, _ in clean]), strict=True):
        found = []
        for s, e, k in spans_of(tags):
            while s < e and (plain[s].isspace() or plain[s] in '"<,;:'):
                s += 1
            while e > s and (plain[e - 1].isspace() or plain[e - 1] in '",;:>'):
                e -= 1
            while 0 < s < e and plain[s - 1 : s + 1].replace("_", "a").isalnum():  # whole words only
                s -= 1
            while s < e < len(plain) and plain[e - 1 : e + 1].replace("_", "a").isalnum():
                e += 1
            if e > s and plain[s] == "(" and ")" not in plain[s : e - 1]:
                s += 1
            if e > s and plain[e - 1] == ")" and "(" not in plain[s:e]:
                e -= 1
            if e > s and plain[s] == "(" and plain[e - 1] == ")" and ")" not in plain[s : e - 1]:
                s, e = s + 1, e - 1
            if e > s and plain[e - 1] == "." and (k not in ("ADDRESS", "NAME") or not SHORT.search(plain[s:e])):
                e -= 1
            if e > s and plausible(k, plain[s:e]):
                if found and int(at[s]) < found[-1][1]:
                    continue
                found.append((int(at[s]), int(at[e]), k))
        out.append(found)
    return out


def masked(text: str | None, items: list[tuple[int, int, str]]) -> str | None:
    """The text with a typed placeholder for each item."""
    if not items:
        return text
    parts, last = [], 0
    for s, e, k in items:
        parts += [text[last:s], f"[{k}]"]
        last = e
    return "".join(parts) + text[last:]


def weights() -> dict[str, np.ndarray]:
    with files("graphloom.llm").joinpath("p2_weights.npz").open("rb") as f, np.load(f) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def find(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Distinct (id, field, kind): ids with an item of that kind in that field in any row."""
    shared = df.sparkSession.sparkContext.broadcast(weights())
    kind = dict(df.dtypes)[id_col]
    one = [F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]
    rows = spread(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *fields)).select("id", F.explode(F.array(*one)).alias("x")).select("id", "x.field", "x.text").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                b = whole.slice(lo, TEXTS)
                rows, kinds = [], []
                for i, items in enumerate(detect(model, b.column(2).to_pylist())):
                    for k in sorted({x[2] for x in items}):
                        rows.append(i), kinds.append(k)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(kinds, pa.string())], names=["id", "field", "kind"])

    return rows.mapInArrow(run, f"id {kind}, field string, kind string").distinct()


def redact(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, fields...): each row with placeholders in its fields."""
    shared = df.sparkSession.sparkContext.broadcast(weights())
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, " + ", ".join(f"`{f}` string" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                b = whole.slice(lo, TEXTS)
                cols = []
                for j in range(len(fields)):
                    texts = b.column(j + 1).to_pylist()
                    cols.append(pa.array([masked(t, items) for t, items in zip(texts, detect(model, texts), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, *fields])

    return spread(df.select(id_col, *fields)).mapInArrow(run, schema)
