"""Character-level bidirectional LSTM with CRF transitions, in numpy.

The activations are x / (1 + |x|) for the hyperbolic tangent, and half of it
plus one half for the logistic function: the same shape at a sixth of the cost.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

KINDS = ("NAME", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N = len(TAGS)
PUNCTUATION = " \n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters: a-z, digit, each of PUNCTUATION, other letter, other sign, padding; upper case is a second block.
DIGIT, OTHER_LETTER, OTHER_SIGN, PAD = 26, 27 + len(PUNCTUATION), 28 + len(PUNCTUATION), 29 + len(PUNCTUATION)
BLOCK = 30 + len(PUNCTUATION)
VOCABULARY = 2 * BLOCK
#: A window of training; a window of tagging and how far the next one is moved on.
TRAINED, WINDOW, STRIDE = 160, 320, 272

ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|&#(\d{1,6});|&#x([0-9a-fA-F]{1,5});|&(amp|lt|gt|quot|apos|nbsp);|\\(n|t|\"|/)")
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "n": "\n", "t": " ", '"': '"', "/": "/"}


def units(text: str) -> tuple[str, np.ndarray]:
    """The text with escapes resolved to one character each, and where each came from (plus the end)."""
    if "\\" not in text and "&" not in text:
        return text, np.arange(len(text) + 1)
    out, at, last = [], [], 0
    for m in ESCAPE.finditer(text):
        out.append(text[last : m.start()])
        at += range(last, m.start())
        h, d, x, name, c = m.groups()
        code = int(h, 16) if h else int(d) if d else int(x, 16) if x else 0
        out.append(NAMED[name or c] if name or c else chr(code) if 0 < code < 0xD800 or 0xE000 <= code < 0x110000 else " ")
        at.append(m.start())
        last = m.end()
    out.append(text[last:])
    at += range(last, len(text) + 1)
    return "".join(out), np.array(at)


_CODE: dict[str, int] = {}


def _code(ch: str) -> int:
    base = unicodedata.normalize("NFKD", ch)[0]
    low = base.lower()
    if "a" <= low <= "z" and len(low) == 1:
        return ord(low) - 97 + (BLOCK if base != low else 0)
    if base.isdigit():
        return DIGIT
    if ch == "ß":
        return 18
    if base.isspace():
        return 27 + (1 if ch in "\n\r" else 0)
    if base in "‐‑–—−":
        base = "-"
    elif base in "’‘":
        base = "'"
    i = PUNCTUATION.find(base)
    return 27 + i if i >= 0 else OTHER_LETTER if base.isalpha() else OTHER_SIGN


def codes(text: str) -> np.ndarray:
    get = _CODE.get
    out = np.empty(len(text), np.int16)
    for i, ch in enumerate(text):
        c = get(ch)
        if c is None:
            if len(_CODE) > 20_000:
                _CODE.clear()
            c = _CODE[ch] = _code(ch)
        out[i] = c
    return out


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Tagger:
    """p: xf, xb (VOCABULARY x 4H), hf, hb (H x 4H), bf, bb, out (2H x N), bo, trans (N x N), start, end."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @staticmethod
    def fresh(h: int, seed: int = 3) -> Tagger:
        r = np.random.default_rng(seed)
        g = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        p = {}
        for d in "fb":
            p["x" + d], p["h" + d], p["b" + d] = g(VOCABULARY, 4 * h, k=0.3), g(h, 4 * h, k=1 / np.sqrt(h)), np.zeros(4 * h, np.float32)
            p["b" + d][h : 2 * h] = 1.0
        p["out"], p["bo"] = g(2 * h, N, k=1 / np.sqrt(2 * h)), np.zeros(N, np.float32)
        p["trans"], p["start"], p["end"] = g(N, N, k=0.01), np.zeros(N, np.float32), np.zeros(N, np.float32)
        return Tagger(p)

    @staticmethod
    def load(path) -> Tagger:
        with np.load(path) as z:
            return Tagger({k: z[k].astype(np.float32) for k in z.files})

    def run(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states of one direction for codes ``x`` (T x B), already in reading order."""
        w, bias, table = self.p["h" + d], self.p["b" + d], self.p["x" + d]
        h4 = w.shape[1]
        n = h4 // 4
        t_len, b = x.shape
        table = table + bias
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        out = np.empty((t_len, b, n), np.float32)
        cache = []
        for t in range(t_len):
            z = table[x[t]]
            z += h @ w
            z /= 1 + np.abs(z)
            ifo = z[:, : 3 * n]
            ifo *= 0.5
            ifo += 0.5
            g = z[:, 3 * n :]
            prev = c
            c = ifo[:, n : 2 * n] * c
            c += ifo[:, :n] * g
            tc = squash(c)
            if keep:
                cache.append((ifo, g, prev, tc, h))
            h = ifo[:, 2 * n :] * tc
            out[t] = h
        return (out, cache) if keep else out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (T x B x N) of windows of codes ``x`` (T x B)."""
        n = self.p["hf"].shape[0]
        f = self.run(x, "f")
        b = self.run(x[::-1], "b")[::-1]
        return f @ self.p["out"][:n] + b @ self.p["out"][n:] + self.p["bo"]

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (T x B) of emissions ``e`` (T x B x N); beyond its length a text has tag 0."""
        t_len, b, n = e.shape
        trans = self.p["trans"].T[None]  # to, from
        score = e[0] + self.p["start"]
        back = np.zeros((t_len, b, n), np.int8)
        for t in range(1, t_len):
            m = score[:, None, :] + trans
            k = m.argmax(axis=2)
            live = (t < lengths)[:, None]
            score = np.where(live, np.take_along_axis(m, k[:, :, None], 2)[:, :, 0] + e[t], score)
            back[t] = np.where(live, k, np.arange(n)[None])
        tags = np.zeros((t_len, b), np.int8)
        cur = (score + self.p["end"]).argmax(axis=1)
        for t in range(t_len - 1, -1, -1):
            tags[t] = np.where(t < lengths, cur, 0)
            cur = back[t][np.arange(b), cur]
        return tags

    def surely_outside(self, e: np.ndarray) -> np.ndarray:
        """Characters that have tag 0 in every best path, whatever their neighbours' tags."""
        tr = self.p["trans"].astype(np.float64)
        ways = np.concatenate((tr, self.p["start"][None]))[:, :, None] + np.concatenate((tr, self.p["end"][:, None]), axis=1)[None]
        gain = (ways - ways[:, :1]).max(axis=(0, 2))[1:]  # what another tag may gain by its transitions
        return (e[:, :1] - e[:, 1:] > gain[None]).all(axis=1)

    def decoded(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each text: only the stretches between sure characters are searched."""
        tags = [np.zeros(len(s), np.int8) for s in scores]
        jobs = []
        for i, s in enumerate(scores):
            if not len(s):
                continue
            open_ = np.flatnonzero(~self.surely_outside(s))
            if not len(open_):
                continue
            cut = np.flatnonzero(np.diff(open_) > 2)  # a stretch keeps a sure character on both sides
            for a, z in zip(open_[np.concatenate(([0], cut + 1))], open_[np.concatenate((cut, [len(open_) - 1]))], strict=True):
                jobs.append((i, max(0, int(a) - 1), min(len(s), int(z) + 2)))
        jobs.sort(key=lambda j: j[2] - j[1])
        at = 0
        while at < len(jobs):
            longest = jobs[min(at + 255, len(jobs) - 1)][2] - jobs[min(at + 255, len(jobs) - 1)][1]
            part = jobs[at : at + max(1, min(256, 4_000_000 // longest))]  # bounds the memory whatever the length
            t_len = part[-1][2] - part[-1][1]
            e = np.zeros((t_len, len(part), N), np.float32)
            for j, (i, a, z) in enumerate(part):
                e[: z - a, j] = scores[i][a:z]
            # the start and end of the text weigh only where the stretch has them; elsewhere a sure character stands there
            got = self.viterbi(e, np.array([z - a for _, a, z in part]))
            for j, (i, a, z) in enumerate(part):
                tags[i][a:z] = got[: z - a, j]
            at += len(part)
        return tags

    def tag(self, texts: list[np.ndarray], batch: int = 512) -> list[np.ndarray]:
        """Tags of each text of codes: windows are scored, joined where they are farthest from an edge, and decoded whole."""
        jobs = []  # (text, start)
        for i, x in enumerate(texts):
            jobs += [(i, s) for s in range(0, max(1, len(x) - WINDOW + STRIDE), STRIDE)] if len(x) else []
        scores = [np.empty((len(x), N), np.float32) for x in texts]
        margin = (WINDOW - STRIDE) // 2
        jobs.sort(key=lambda j: min(WINDOW, len(texts[j[0]]) - j[1]))
        for at in range(0, len(jobs), batch):
            part = jobs[at : at + batch]
            t_len = max(min(WINDOW, len(texts[i]) - s) for i, s in part)
            x = np.full((t_len, len(part)), PAD, np.int16)
            for j, (i, s) in enumerate(part):
                w = texts[i][s : s + WINDOW]
                x[: len(w), j] = w
            e = self.emissions(x)
            for j, (i, s) in enumerate(part):
                end = min(s + WINDOW, len(texts[i]))
                lo = s if s == 0 else s + margin
                hi = end if end == len(texts[i]) else end - margin
                scores[i][lo:hi] = e[lo - s : hi - s, j]
        return self.decoded(scores)
