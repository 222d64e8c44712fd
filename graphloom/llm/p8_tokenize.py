"""Problem 8: encoding a whole corpus with a public byte-level BPE vocabulary.

Every text is split by the vocabulary's public split pattern; a piece is mapped
byte by byte to Latin-1 characters, an Aho-Corasick automaton over the
vocabulary gives every token at every place, and the encoder walks from the
longest match, steps back to shorter ones (and to the token before) whenever
two neighbours are not what the merges would leave next to each other.  A text
is a correct encoding exactly when each adjacent pair is, so the memoised pair
test reproduces the merges without running them over the text, in time linear
in the piece.

Edge cases: NULL and empty texts have the empty list of ids; special-token
strings inside a text are ordinary text; texts of any length are encoded whole;
repeated rows are encoded one by one; an empty table gives an empty table; all
other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.runtime import spread

#: Split pattern of the public vocabulary (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and pairs remembered per worker; beyond it the memo starts afresh.
MEMO = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return f"{folder}/{name}"


def split_pattern() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.PATTERN
    except (ImportError, AttributeError):
        return SPLIT


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.text = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for word, rank in self.ranks.items():
            self.automaton.add_word(word, (len(word), rank))
        self.automaton.make_automaton()
        self.memo: dict[str, list[int]] = {}
        self.joined = lru_cache(MEMO)(self._joined)

    def merged(self, s: str) -> list[int]:
        """Plain merging of a short string, lowest rank first."""
        parts = list(s)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _joined(self, a: int, b: int) -> bool:
        """Would the merges leave token ``a`` next to token ``b``?"""
        return self.merged(self.text[a] + self.text[b]) == [a, b]

    def piece(self, s: str) -> list[int]:
        """Ids of one piece (already Latin-1)."""
        if (whole := self.ranks.get(s)) is not None:
            return [whole]
        at: list[list[tuple[int, int]]] = [[] for _ in s]
        for end, (n, rank) in self.automaton.iter(s):
            at[end - n + 1].append((n, rank))  # ends grow, so the longest is last
        out: list[int] = []
        left: list[int] = []  # for each chosen token, how many shorter matches are untried
        start, untried = 0, len(at[0])
        dead = bytearray(len(s) + 1)  # a place whose tokens have all failed never leads to the end
        starts: list[int] = []
        while start < len(s):
            found = False
            while untried:
                untried -= 1
                n, rank = at[start][untried]
                if dead[start + n] and start + n < len(s):
                    continue
                if not out or self.joined(out[-1], rank):
                    found = True
                    break
            if found:
                out.append(rank)
                left.append(untried)
                starts.append(start)
                start += n
                untried = len(at[start]) if start < len(s) else 0
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                dead[start] = 1
                out.pop()
                untried, start = left.pop(), starts.pop()
        return out

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        memo = self.memo
        for p in self.find(text or ""):
            got = memo.get(p)
            if got is None:
                got = self.piece(p.encode("utf-8").decode("latin-1"))
                if len(p) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[p] = got
            ids += got
        return ids


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>), one row for each row of ``df``.

    A narrow map over the scan: no shuffle, only two columns are read.  The
    vocabulary (a file of fixed size) is read once on the driver and broadcast.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path or vocabulary_path()))
    pattern = split_pattern()
    field = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (id(ranks.value), len(ranks.value))
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(ranks.value, pattern)
        enc = _ENCODERS[key]
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = pa.array([enc.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {field}, ids array<int>")
