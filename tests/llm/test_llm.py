"""Each operator against brute force on small inputs, and its edge cases."""

import itertools
import os
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import p1_history_dedup as p1
from graphloom.llm import p2_model, p2_pii, p2_train
from graphloom.llm import p3_neighbours as p3
from graphloom.llm import p4_rank as p4
from graphloom.llm import p5_near_duplicates as p5
from graphloom.llm import p6_components as p6
from graphloom.llm import p7_clusters as p7
from graphloom.llm import p8_tokenize as p8
from graphloom.llm import p9_leakage as p9
from graphloom.llm import p10_residue as p10

WORD = re.compile(r"[^\W_]+")


def likeness(a, b):
    a, b = set(WORD.findall((a or "").lower())), set(WORD.findall((b or "").lower()))
    return len(a & b) / len(a | b) if a and b else 0.0


def near_texts(n, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "and"]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 4)):
                x = r.random()
                if x < 0.4 and w:
                    w.pop(r.randrange(len(w)))
                elif x < 0.8:
                    w.insert(r.randint(0, len(w)), r.choice(vocab))
                else:
                    r.shuffle(w)
        else:
            w = ["the", "of"] + [r.choice(vocab) for _ in range(r.randint(1, 18))]
        out.append(" ".join(w))
    return out


# -- 1
def batches(spark, rows):
    return spark.createDataFrame([(b, None, [(f"i{j}", c) for j, c in enumerate(cs)]) for b, cs in rows], "batch_id long, received_at timestamp, entities array<struct<id: string, content: string>>")


@pytest.mark.parametrize("block", [2, 64])
def test_p1_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(p1.ChunkStore.near, "__defaults__", (p1.LIKENESS, block))
    texts = near_texts(120, 5)
    hist, rest = texts[:50], texts[50:]
    rows = [(i, rest[i * 7 : i * 7 + 7]) for i in range(10)]
    got = {tuple(r) for r in p1.repeated_items(batches(spark, rows), spark.createDataFrame([(h, 1) for h in hist], "content string, x int")).collect()}
    earlier, want = list(hist), set()
    for b, cs in rows:
        for pos, t in enumerate(cs):
            if any(likeness(t, e) >= 0.7 for e in earlier):
                want.add((b, pos))
            earlier.append(t)
    assert got <= want
    assert len(got) >= 0.97 * len(want)  # chunks must survive the edits of a pair


def test_p1_edges(spark):
    none = spark.createDataFrame([], "content string")
    assert p1.repeated_items(batches(spark, []), none).count() == 0
    same = [(1, ["a b c d", None, "", "..!"]), (1, ["a b c d", None, "", "..!"]), (2, ["A  b, c d"])]
    assert {tuple(r) for r in p1.repeated_items(batches(spark, same), none).collect()} == {(2, 0)}
    many = [(1, ["common words here today"] * 300)]
    assert p1.repeated_items(batches(spark, many), none).count() == 299


@given(st.lists(st.text("abcdef", min_size=1, max_size=5), max_size=60))
def test_p1_chunks_round_trip(words):
    assert " ".join(p1.chunks(words)).split() == words


def test_p1_incremental(spark, tmp_path):
    s = p1.ChunkStore(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([("alpha beta gamma delta epsilon",)], "t string")
    s.append(one, "t")
    s.append(one, "t")
    assert s.records().count() == 1


def test_p1_many_appends_with_a_late_one(spark, tmp_path):
    texts = near_texts(60, 77)
    places = [(b, i, texts[b * 10 + i]) for b in range(6) for i in range(10)]
    s = p1.ChunkStore(spark, str(tmp_path / "late"))
    frame = lambda b: spark.createDataFrame([p for p in places if p[0] in b], "batch_id long, pos long, content string")
    got = set()
    for b in (0, 2, 1, 5, 3, 4):  # a batch of a smaller number comes after a larger one
        s.append(frame([b]), "content", "batch_id", "pos")
    for b in (1, 4):  # each checked by itself against all that is there
        got |= {tuple(r) for r in s.check(frame([b])).collect()}
    want = {(b, i) for b, i, t in places if b in (1, 4) and any(likeness(t, u) >= 0.7 for c, j, u in places if (c, j) < (b, i))}
    assert got == want and want
    first = s.seen(s.records()).toPandas()
    assert len(first) == s.records().count()
    # what was written without a commit mark is not read
    n = s.chunks().count()
    frame([0]).select("batch_id").write.parquet(str(tmp_path / "late" / "parts" / "000099-torn" / "chunks"))
    s.refresh()
    assert s.chunks().count() == n


def test_p1_rolling_cuts_are_local():
    r = random.Random(3)
    w = [f"{r.choice('abcdefgh')}word{r.randrange(99)}" for _ in range(200)]
    a, b = p1.chunks(w), p1.chunks([*w[:100], "inserted", *w[100:]])
    assert len(set(a) ^ set(b)) <= 4 and len(a) > 40
    assert [c.tolist() for c in p1.cuts([w, ["x"], w])] == [p1.cuts([w])[0].tolist(), p1.cuts([["x"]])[0].tolist(), p1.cuts([w])[0].tolist()]


def test_p1_near_copies_of_one_long_text(spark, monkeypatch):
    """All chunks are shared by more than a block; an own word late in both streams leaves no run that reaches the end."""
    monkeypatch.setattr(p1, "TILE", 600)
    late = (w for w in (f"x{i}" for i in itertools.count()) if xxhash.xxh64_intdigest(w) > 0.97 * 2**64)
    words = [f"template{i}" for i in range(30)]
    texts = [" ".join([*words[:27], next(late), *words[27:]]) for _ in range(1500)]
    none = spark.createDataFrame([], "content string")
    got = {tuple(r) for r in p1.repeated_items(batches(spark, [(0, texts[:700]), (1, texts[700:])]), none).collect()}
    assert got == {(0, i) for i in range(1, 700)} | {(1, i) for i in range(800)}


# -- 2
def test_p2_gradients():
    m = p2_model.Tagger.fresh(5, seed=1)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    r = random.Random(2)
    x, y, n = p2_train.windows(r, ["Some plain text of no interest. And more."], ['{"a": "b"}'], 3)
    x, y, n = x[:20], y[:20], np.minimum(n, 20)
    _, g = p2_train.gradients(m, x, y, n)
    for k in ("hf", "xb", "out", "trans", "bb", "start"):
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, loss = m.p[k][i], []
        for d in (1e-3, -1e-3):
            m.p[k][i] = old + d
            loss.append(p2_train.gradients(m, x, y, n)[0])
        m.p[k][i] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - g[k][i]) < 2e-3 + 0.05 * abs(g[k][i]), k


def test_p2_held_out_accuracy():
    m = p2_model.Tagger(p2_pii.weights())
    r = random.Random(4321)
    plain = ["The planner moved 31 rows late at night. Our cache was merged after 12 hops.", "Please keep the note about tea auctions: the lock table needs 31 pages."]
    texts = [p2_train.example(r, plain, ['{"channel": "api", "session": "s-1234567"}']) for _ in range(300)]
    got = p2_pii.detect(m, [t for t, _ in texts])
    hit = sum(len({x[2] for x in g} & {k for *_, k in sp}) for g, (_, sp) in zip(got, texts, strict=True))
    found, true = sum(len({x[2] for x in g}) for g in got), sum(len({k for *_, k in sp}) for _, sp in texts)
    assert hit / found > 0.93 and hit / true > 0.93


#: Ordinary sentences; no name, street, host or wording of them is in the generator's lists.
ORDINARY = [
    ("Siobhan Gallagher reviewed the draft on Thursday.", {"NAME"}),
    ("Das Gutachten stammt von Brigitte Vogel aus Kassel.", {"NAME"}),
    ("Le dossier a été transmis à Thibault Chevalier ce matin.", {"NAME"}),
    ("El paquete lo recogió Ximena Villalobos en recepción.", {"NAME"}),
    ("Questions about payroll go to Mrs. Abernathy.", {"NAME"}),
    ("He wrote to tadeusz.zielinski@poczta.pl about the delay.", {"EMAIL"}),
    ("Unsubscribe by writing to newsletter@gartenfreunde.at any time.", {"EMAIL"}),
    ("For support use help (at) kayakclub (dot) nz instead.", {"EMAIL"}),
    ("The helpline 0800 123 4567 is open around the clock.", {"PHONE"}),
    ("Rufen Sie uns an: 0221 / 47 11 08 15.", {"PHONE"}),
    ("My cell is (415) 867-5309, leave a message.", {"PHONE"}),
    ("Son portable est le 06 12 34 56 78.", {"PHONE"}),
    ("The clerk copied passport number 533380006 from the booklet.", {"ID_NUMBER"}),
    ("Her SSN 078-05-1120 was printed on the wallet card.", {"ID_NUMBER"}),
    ("Seine Steuernummer 93815/08152 steht auf dem Bescheid.", {"ID_NUMBER"}),
    ("The inspector lives at 221B Harley Street, Edinburgh.", {"ADDRESS"}),
    ("Die Praxis liegt in der Lindwurmstraße 88, 80337 Augsburg.", {"ADDRESS"}),
    ("Le colis part au 7 rue Lecourbe, 37000 Tours.", {"ADDRESS"}),
    ("La tienda está en Calle Serrano 45, Córdoba.", {"ADDRESS"}),
    ("Version 11.2.0 of the driver fixes 37 defects.", set()),
    ("The cluster at 10.1.22.9 rebooted at 03:14:15 on 2023-11-05.", set()),
    ("Commit 4f9c2e1ab7d0 closes ticket #88213.", set()),
    ("The Baltic Exchange published its freight index.", set()),
    ("We drove from Aarhus to Flensburg in two hours.", set()),
    ("Ein Drittel der 48210 Knoten war nach 12 Minuten leer.", set()),
]


def test_p2_ordinary_sentences_of_other_sources():
    from pathlib import Path

    source = Path(p2_train.__file__).read_text()
    assert not [w for w in ("Gallagher", "Brigitte", "Villalobos", "Abernathy", "Lindwurm", "Lecourbe", "Serrano", "Harley") if w in source]
    got = p2_pii.detect(p2_model.Tagger(p2_pii.weights()), [t for t, _ in ORDINARY])
    found = [{x[2] for x in g} for g in got]
    hit = sum(len(f & want) for f, (_, want) in zip(found, ORDINARY, strict=True))
    assert hit >= 0.8 * sum(len(w) for _, w in ORDINARY) and hit >= 0.8 * sum(map(len, found))


def test_p2_stretches_decode_like_the_whole():
    r = np.random.default_rng(5)
    m = p2_model.Tagger({k: v + (0.3 * r.standard_normal(v.shape) if k in ("start", "end") else 0) for k, v in p2_pii.weights().items()})
    scores = []
    for n in (1, 2, 7, 60, 300, 0):
        e = r.standard_normal((n, p2_model.N)).astype(np.float32) * 4
        e[r.random(n) < 0.6, 0] += 60
        scores.append(e)
    for e, got in zip(scores, m.decoded(scores), strict=True):
        if len(e):
            assert (m.viterbi(e[:, None], np.array([len(e)]))[:, 0] == got).all()


def test_p2_mask_and_edges(spark):
    text = "Reported by Petra Hollowfield; no reply yet. Write to rosa59@quillpost.example when it is done. Build 4.7.9-723 on 192.0.2.26 took 31 rows."
    rows = [("a", text, 1), ("b", None, 1), ("c", "", 1), ("d", "   ", 1), ("e", "x " * 30_000 + text, 1), ("a", text, 1)]
    df = spark.createDataFrame(rows, "id string, content string, field int")
    got = {tuple(r) for r in p2_pii.find(df, "id", ["content"]).collect()}
    assert got == {(i, "content", k) for i in "ae" for k in ("NAME", "EMAIL")}
    masked = {r.id: r.content for r in p2_pii.redact(df, "id", ["content"]).collect()}
    assert masked["a"] == "Reported by [NAME]; no reply yet. Write to [EMAIL] when it is done. Build 4.7.9-723 on 192.0.2.26 took 31 rows."
    assert masked["b"] is None and masked["c"] == "" and masked["d"] == "   "
    assert p2_pii.find(df.where("false"), "id", ["content"]).count() == 0


def test_p2_escapes():
    plain, at = p2_model.units("a\\u0040b &amp; c")
    assert plain == "a@b & c" and at[-1] == len("a\\u0040b &amp; c") and at[2] == 7


# -- 3
def vectors(spark, v, extra=()):
    rows = [(f"v{i:04d}", [float(x) for x in row], None) for i, row in enumerate(v)] + list(extra)
    return spark.createDataFrame(rows, "id string, embedding array<float>, received_at timestamp")


def clustered(n, seed, width=64):
    r = np.random.default_rng(seed)
    c = r.standard_normal((8, width))
    return (c[r.integers(0, 8, n)] + 0.5 * r.standard_normal((n, width))).astype(np.float32)


def brute_neighbours(ids, v):
    u = p3.unit(v)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        order = np.lexsort((ids, -s[i]))[:5]
        out |= {(ids[i], ids[j]) for j in order if s[i, j] >= 0.68}
    return out


def test_p3_recall(spark):
    v = clustered(3000, 1)
    ids = np.array([f"v{i:04d}" for i in range(3000)])
    got = {tuple(r) for r in p3.neighbours(vectors(spark, v)).select("id", "neighbour_id").collect()}
    want = brute_neighbours(ids, v)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_p3_large_cells_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(p3, "SAMPLE", 32)  # a first tree of two cells at most
    monkeypatch.setattr(p3, "CELL", 60)
    v = clustered(900, 21)
    df = vectors(spark, v)
    members, distinct = p3.distinct_vectors(p3.usable(df, "id", "embedding", None))
    w = p3.directions()

    def place(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = p3.unit(p3.matrix(b.column(1), 64)) @ w
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 8), pa.int32()), pa.array(x.ravel())), pa.array(np.zeros(len(x), np.int32))], names=["vid", "vec", "p", "cell"])

    one = distinct.mapInArrow(place, "vid long, vec array<float>, p array<double>, cell int")
    sizes = [r["count"] for r in p3.refined(one, 8, 60).groupBy("cell").count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 60
    got = {(r.id, r.neighbour_id) for r in p3.neighbours(df).collect()}
    want = brute_neighbours(np.array([f"v{i:04d}" for i in range(900)]), v)
    assert len(got & want) >= 0.99 * len(want) and len(got) <= len(want)


def test_p3_edges(spark):
    extra = [("n", None, None), ("z", [0.0] * 64, None), ("s", [1.0] * 63, None), ("v0000", [1.0] * 64, None), (None, [1.0] * 64, None), ("nan", [float("nan")] * 64, None)]
    same = np.tile(np.arange(1, 65, dtype=np.float32), (40, 1))
    got = [tuple(r) for r in p3.neighbours(vectors(spark, same, extra[:3] + extra[4:])).select("id", "neighbour_id").collect()]
    assert len(got) == 200 and {b for a, b in got if a == "v0020"} == {f"v{i:04d}" for i in range(5)}
    assert {b for a, b in got if a == "v0002"} == {f"v{i:04d}" for i in (0, 1, 3, 4, 5)}
    assert p3.neighbours(vectors(spark, np.zeros((0, 64)))).count() == 0


def test_p3_quantile():
    assert abs(p3.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3


# -- 4
def test_p4_scale_free_and_large_path(spark):
    r = np.random.default_rng(3)
    rows = [(q, f"i{j:03d}", float(r.random() * 10**q), float(r.integers(0, 9)), None if r.random() < 0.2 else float(r.random())) for q in range(3) for j in range(30)]
    df = spark.createDataFrame(rows + rows[:5], "q int, i string, a double, b double, c double")
    small = {(x.q, x.i): (x.weight, x.place) for x in p4.rank_walk(df, "q", "i", ["a", "b", "c"]).collect()}
    large = {(x.q, x.i): (x.weight, x.place) for x in p4.rank_walk(df, "q", "i", ["a", "b", "c"], small=10).collect()}
    assert len(small) == 90 and small.keys() == large.keys()
    assert max(abs(small[k][0] - large[k][0]) for k in small) < 1e-7
    assert {k: v[1] for k, v in small.items()} == {k: v[1] for k, v in large.items()}
    scaled = {(x.q, x.i): x.place for x in p4.rank_walk(df.withColumn("a", F.col("a") * 1000), "q", "i", ["a", "b", "c"]).collect()}
    assert scaled == {k: v[1] for k, v in small.items()}


@pytest.mark.parametrize("jump", ["any", "higher"])
def test_p4_dense_chain(jump):
    r = np.random.default_rng(8)
    group = np.repeat([0, 1, 2], [1, 12, 40])
    scores = [np.where(r.random(53) < 0.2, np.nan, r.integers(0, 9, 53)).astype(float) for _ in range(3)]
    got = p4.stationary(group, scores, jump=jump)
    for g in range(3):
        at = np.flatnonzero(group == g)
        n, m = len(at), np.zeros((len(at), len(at)))
        for s in scores:
            v = np.where(np.isnan(s[at]), -np.inf, s[at])
            up = (v[None] > v[:, None]).astype(float)
            deg = up.sum(axis=1, keepdims=True)
            m += np.where(deg > 0, up / np.maximum(deg, 1), 1 / n) if jump == "higher" else up / n + np.diag(1 - deg[:, 0] / n)
        p = np.full(n, 1 / n)
        for _ in range(400):
            p = 0.15 / n + 0.85 * p @ (m / 3)
        assert np.allclose(got[at], p, atol=1e-8)


def test_p4_edges(spark):
    df = spark.createDataFrame([(1, "a", None, None), (1, "b", 1.0, 1.0), (2, "x", None, None), (None, "y", 1.0, 1.0), (3, None, 1.0, 1.0)], "q int, i string, s double, t double")
    got = [(r.q, r.i) for r in p4.rank_walk(df, "q", "i", ["s", "t"], 1).collect()]
    assert sorted(got) == [(1, "b"), (2, "x")]
    assert p4.rank_walk(df.where("false"), "q", "i", ["s", "t"], 1).count() == 0


# -- 5
@pytest.mark.parametrize("block", [2, 64])
def test_p5_brute_force(spark, block):
    texts = near_texts(150, 9) + ["", None, "...", "the of", "the of"]
    rows = [(f"e{i % 140:03d}", t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, content string, sid string")
    got = {tuple(r) for r in p5.near_duplicates(df, block=block).collect()}
    want = set()
    for (a, x, _), (b, y, _) in itertools.combinations(rows, 2):
        if a != b and likeness(x, y) >= 0.7 - 1e-12:
            want.add((min(a, b), max(a, b)))
    assert got == want
    groups = {r.id: r.group_id for r in p5.near_duplicate_groups(df, block=block).collect()}
    assert all(groups[a] == groups[b] for a, b in want) and set(groups) == {x for p in want for x in p}


def test_p5_product_of_one_block():
    r = np.random.default_rng(12)
    sets = [np.sort(r.choice(40, r.integers(1, 30), replace=False)) for _ in range(50)]
    size = np.array(list(map(len, sets)))
    row, gram = np.repeat(np.arange(50), size), np.concatenate(sets)
    a, b = np.triu_indices(50, 1)
    for t in (0.3, 0.7):
        got = p5.accumulated(row, gram, size, a, b, t)
        for x, y, c in zip(a, b, got, strict=True):
            shared = len(np.intersect1d(sets[x], sets[y]))
            assert c == (shared if shared / (size[x] + size[y] - shared) >= t - 1e-12 else 0)


def test_p5_tiles_of_a_large_block(spark, monkeypatch):
    monkeypatch.setattr(p5, "TASK_ROWS", 8)
    texts = [f"w{i} a b c d e f g h" for i in range(30)]
    df = spark.createDataFrame([(f"i{i:02d}", t) for i, t in enumerate(texts)], "id string, content string")
    assert p5.near_duplicates(df, block=4).count() == 30 * 29 // 2


def test_p5_word_pairs(spark):
    texts = ["a b c d e f g h", "a b c d e f g x", "h g f e d c b a", "one", "one", None, ""]
    df = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(texts)], "id string, content string")
    assert {tuple(r) for r in p5.near_duplicates(df, gram=2).collect()} == {("i0", "i1"), ("i3", "i4")}
    assert {tuple(r) for r in p5.near_duplicates(df).collect()} == {("i0", "i1"), ("i0", "i2"), ("i1", "i2"), ("i3", "i4")}


def test_p5_empty(spark):
    assert p5.near_duplicates(spark.createDataFrame([], "id string, content string")).count() == 0


# -- 6
@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_p6_union_find(spark, pairs):
    df = spark.createDataFrame([(f"{a:02d}", f"{b:02d}") for a, b in pairs], "a string, b string")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {(r.id, r.group_id) for r in p6.components(df, "a", "b").collect()} == {(f"{a:02d}", f"{root(a):02d}") for a in parent}


def test_p6_hub_chain_and_dirt(spark, monkeypatch):
    monkeypatch.setattr(p6, "HOT", 20)
    rows = [(f" h{i} ", "hub", "Related_To") for i in range(100)] + [(f"c{i:03d}", f"c{i + 1:03d}", "related to") for i in range(60)]
    rows += [(None, "x", "relatedto"), ("x", "x", "relatedto"), ("", "x", "relatedto"), ("q", "hub", "Contradicts"), ("a", "b", None)]
    got = {r.id: r.group_id for r in p6.match_groups(spark.createDataFrame(rows, "source_id string, target_id string, rel_type string")).collect()}
    assert len(got) == 101 + 61 and got["h99"] == "h0" and got["c060"] == "c000"


# -- 7
def test_p7_flat_is_exact_and_hierarchy(spark):
    v = clustered(600, 4)
    df = vectors(spark, v, [("bad", None, None)])
    f = p7.Forest(df)
    got = {(r.cluster_id, r.id) for r in f.flat().collect()}
    u = p3.unit(v)
    ids = [f"v{i:04d}" for i in range(600)]
    near = u @ u.T >= 0.68
    label = -np.ones(600, int)
    for i in range(600):
        todo = [i] if label[i] < 0 else []
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = i
                todo += np.flatnonzero(near[j] & (label < 0)).tolist()
    want = {(ids[k], ids[j]) for k in set(label) for j in np.flatnonzero(label == k) if (label == k).sum() >= 6}
    assert got == want
    n = len({x for _, x in want})
    chosen = f.hierarchy().collect()
    assert 0 < len(chosen) <= n and len({r.id for r in chosen}) == len(chosen)
    # condensed in bands of short edges, as trees too large for a task are, the hierarchy is the same
    whole, bands = f.condensed(), f.condensed(bound=40)
    for a, b in zip(whole, bands, strict=True):
        key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(map(key, a.collect()), key=repr) == sorted(map(key, b.collect()), key=repr)


def test_p7_hierarchy_of_two_tight_parts_joined_late(spark):
    # two groups of eight on a line, joined by one long edge; one more member hangs on the second
    edges = [(i, i + 1, 0.01) for i in range(7)] + [(i, i + 1, 0.02) for i in range(10, 17)] + [(17, 18, 0.1), (7, 10, 0.3)]
    nodes, points = p7.condensed(spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame([(i, 1) for i in [*range(8), *range(10, 19), 30]], "vid long, ids long"), least=6)
    n = {r.node: r for r in nodes.collect()}
    roots = [r for r in n.values() if r.parent is None]
    assert len(roots) == 1 and roots[0].n == 17 and roots[0].tree == 0 and not roots[0].taken
    kids = sorted((r.n, round(r.stability, 6)) for r in n.values() if r.parent == roots[0].node and r.taken)
    # the sum of 1/distance at which members leave, less that at which the two part
    assert kids == [(8, round(8 / 0.01 - 8 / 0.3, 6)), (9, round(8 / 0.02 + 1 / 0.1 - 9 / 0.3, 6))]
    cluster = {r.node: r.cluster for r in p7.selected(nodes).collect()}
    assert {r.vid: cluster[r.node] for r in points.collect()}.keys() == {*range(8), *range(10, 19)}
    assert len(set(cluster.values())) == 2


def test_p7_empty(spark):
    assert p7.Forest(vectors(spark, np.zeros((0, 64)))).flat().count() == 0


# -- 8
@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n't", max_size=80), st.text("0123456789 .-", max_size=40)))
def test_p8_like_the_public_encoder(text):
    assert encoder().encode(text) == public().encode_ordinary(text)


_E: dict = {}


def encoder():
    if "e" not in _E:
        _E["e"] = p8.Encoder(p8.load_ranks(p8.vocabulary_path()), p8.split_pattern())
    return _E["e"]


def public():
    if "t" not in _E:
        import tiktoken

        _E["t"] = tiktoken.Encoding("own", pat_str=p8.split_pattern(), mergeable_ranks=p8.load_ranks(p8.vocabulary_path()), special_tokens={})
    return _E["t"]


def test_p8_rows_and_edges(spark):
    long = "abcdefghij" * 5000
    rows = [(1, "hello <|endoftext|> world"), (2, None), (3, ""), (4, "hello <|endoftext|> world"), (5, long), (6, "日本語 ééé 🙂")]
    got = {r.doc_id: r.ids for r in p8.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))).collect()}
    assert all(got[i] == (public().encode_ordinary(t) if t else []) for i, t in rows)
    assert p8.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- 9
def test_p9_brute_force_and_blocks(spark):
    r = random.Random(8)
    vocab = [f"word{i}" for i in range(50)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(8)] + [(8, "too short"), (9, None)]
    docs = []
    for i in range(60):
        w = [r.choice(vocab + ["other"]) for _ in range(40)]
        if i % 3 == 0:
            t = items[i % 8][1].split()
            s = r.randint(0, 15)
            w[10:10] = [x.upper() + ("," if r.random() < 0.3 else "") for x in t[s : s + r.randint(10, 14)]]
        docs.append((i, " ".join(w)))
    docs += [(60, None), (61, ""), (0, docs[0][1])]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    assert want
    for chars in (p9.BROADCAST_CHARS, 400):
        assert {tuple(x) for x in p9.leaked(ddf, idf, broadcast_chars=chars).collect()} == want
    clean = p9.without_leaks(ddf, idf, drop_share=1.0)
    assert p9.leaked(clean, idf).count() == 0 and clean.count() == len(docs)
    in_blocks = p9.without_leaks(ddf, idf, drop_share=1.0, broadcast_chars=400)  # far more items than one block holds
    assert sorted(map(tuple, in_blocks.collect()), key=repr) == sorted(map(tuple, clean.collect()), key=repr)


# -- 10
@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("404 - page not found\n\nHelp | Home | Contact\n\nThe link you followed may be broken, or the page may have been removed.", True),
        ("Bonjour ${owner}, la mémoire ${first_name} expire le ${due}.\nThe same text goes to every team.", True),
        ("Lorem ipsum nonum vela emin fero cras. Vela vela cras amen.", True),
        ("<html><body><p>Please enable JavaScript to view this page.</p></body></html>", True),
        ("TODO: write this section...\nContent coming soon.", True),
        ("Page not found errors fell after the link table was rebuilt.\nNobody had moved the map since Tuesday; eleven rows were left.", False),
        ("A template line such as `Dear {{first_name}}` is filled by the renderer before the memory is stored.\nThe planner dropped a table and wrote it again.", False),
        ("The word TODO in a note is indexed like any other token.\nThe scout merged eleven notes on tea auctions.", False),
        ("", False),
        ("   \n", False),
        (None, False),
        ("Dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.", True),
        ("Duis aute irure dolor in reprehenderit in voluptate velit esse cillum.", True),
        ("Excepteur sint occaecat cupidatat non proident.", True),
        ("Oops! We can't find that page.", True),
        ("Fatal error: Uncaught exception", True),
        ("Database connection error", True),
        ("Dear FIRSTNAME LASTNAME, your order ORDERNUMBER", True),
        ("Ceci est un texte provisoire", True),
        ("Die angeforderte Seite wurde nicht gefunden. Bitte versuchen Sie es später noch einmal.", True),
        ("503 Service Temporarily Unavailable\nPlease contact the administrator if the error persists.", True),
        ("This site requires JavaScript to work. Please switch on scripts in your browser.", True),
        ("We traced the 503 errors to a full disk on the second replica, moved the logs to the archive and restarted the writers.", False),
        ("Designers paste lorem ipsum into a draft so that nobody reads the words while they look at the columns.", False),
    ],
)
def test_p10_cases(text, want):
    assert p10.is_residue(text) is want


def test_p10_standing_sentences_are_learned(spark):
    told = "The kettle of the archive rests for now"
    rows = [(i, f"404 Not Found\nThe requested page does not exist.\n{told} ({i})", f"h{i}") for i in range(5)] + [(10, told, "h"), (11, "A long note on rivers, bridges and the towns beside them, written in spring.", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert not p10.is_residue(rows[0][1])
    assert {r.doc_id for r in p10.residue(df).collect()} == set(range(5))


def test_p10_boilerplate_and_edges(spark):
    rows = [(i, "Cookie notice of this site applies here.\n404 Not Found", "host/a") for i in range(8)] + [(100, None, "host/a"), (101, "", None), (102, "A real text about the map of the town and its rivers.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit("x"))
    assert {r.doc_id for r in p10.residue(df).collect()} == set(range(8))
    assert p10.residue(df.where("false")).count() == 0


def left_behind(spark):
    from graphloom.runtime import shared_dir

    d = f"{shared_dir(spark)}/tables".removeprefix("file:")
    return set(os.listdir(d)) if os.path.isdir(d) else set()


def test_p1_leaves_only_its_result(spark):
    texts = near_texts(40, 6)
    rows = [(i, texts[i * 10 : i * 10 + 10]) for i in range(4)]
    before = left_behind(spark)
    got = p1.repeated_items(batches(spark, rows), spark.createDataFrame([], "content string"))
    assert len(left_behind(spark) - before) == 2  # one for each group of batches
    assert got.count() > 0


def test_p3_rounds_of_few_visits(spark, monkeypatch):
    """Far more cells than one round visits; what is written while it runs is bounded."""
    from graphloom import runtime

    sizes = []

    def measured(df, *a, **k):
        out = runtime.written(df, *a, **k)
        sizes.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(p3, "CELL", 40)
    monkeypatch.setattr(p3, "VISITS", 2, raising=False)
    monkeypatch.setattr(p3, "checkpoint", measured)
    v = clustered(1200, 5)
    before = left_behind(spark)
    got = p3.neighbours(vectors(spark, v)).select("id", "neighbour_id")
    assert max(n for c, n in sizes if "worst" in c) <= 2 * 1200
    assert len(left_behind(spark) - before) == 2  # ids and lists
    got = {tuple(r) for r in got.collect()}
    want = brute_neighbours(np.array([f"v{i:04d}" for i in range(1200)]), v)
    assert len(got & want) >= 0.99 * len(want) and len(got) <= len(want)


def test_p5_blocks_are_not_written(spark, monkeypatch):
    """Rows of blocks that need no split, and rows beside their sets, stay out of the tables."""
    from graphloom import runtime

    sizes = []

    def measured(df, *a, **k):
        out = runtime.written(df, *a, **k)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(p5, "checkpoint", measured)
    r = random.Random(4)
    texts = [" ".join(f"w{x}" for x in r.sample(range(400), 40)) for _ in range(200)]
    df = spark.createDataFrame([(f"i{i:03d}", t) for i, t in enumerate([*texts, *texts[:5]])], "id string, content string")
    before = left_behind(spark)
    got = p5.near_duplicates(df)
    assert max(sizes) <= 205
    assert len(left_behind(spark) - before) <= 2  # ids and pairs
    assert got.count() == 5


def test_p7_completion_in_groups_of_cells(spark, monkeypatch):
    """Vectors travel to other cells in groups and are not written there; only what the result reads stays."""
    from graphloom import runtime

    sizes = []

    def measured(df, *a, **k):
        out = runtime.written(df, *a, **k)
        sizes.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(p7, "VISITS", 1, raising=False)
    monkeypatch.setattr(p7, "checkpoint", measured)
    v = clustered(600, 4)
    before = left_behind(spark)
    got = p7.Forest(vectors(spark, v)).flat()
    assert max(n for c, n in sizes if "vec" in c) <= 600
    assert len(left_behind(spark) - before) <= 5  # ids, core, edges, labels, nodes
    u = p3.unit(v)
    near = (u @ u.T >= 0.68).astype(np.float32)
    while not np.array_equal(near, more := (near @ near > 0).astype(np.float32)):
        near = more
    first = near.argmax(axis=1)
    want = {(f"v{first[i]:04d}", f"v{i:04d}") for i in range(600) if (first == first[i]).sum() >= 6}
    assert {tuple(r) for r in got.collect()} == want


def test_p1_cuts_each_text_once(spark, tmp_path, monkeypatch):
    """An append runs the rolling hash over a new text once, not again to lay out its files."""
    at, cut = str(tmp_path / "cut"), p1.with_chunks

    def counted(texts, *a):
        def run(batches, at=at):
            for b in batches:
                with open(at, "a") as f:
                    f.write("".join(f"{x}\n" for x in b.column(0).to_pylist()))
                yield b

        rows = texts.select("sid", "text")
        return cut(rows.mapInArrow(run, rows.schema), *a)

    monkeypatch.setattr(p1, "with_chunks", counted)
    store = p1.ChunkStore(spark, str(tmp_path / "store"))
    texts = [(f"text {i} of some words {i * 7} and others {i % 5}",) for i in range(50)]
    store.append(spark.createDataFrame(texts, "t string"), "t")
    store.append(spark.createDataFrame(texts[:10] + [("one more text that is new",)], "t string"), "t")
    with open(at) as f:
        sids = f.read().split()
    assert len(sids) == len(set(sids)) == 51
    assert store.chunks().count() == store.chunks().distinct().count()


def test_p7_visits_measure_only_the_cells_of_their_group(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "angles")

    class Counted:
        def __getattr__(self, name):
            import numpy

            return getattr(numpy, name)

        def degrees(self, x):
            import numpy

            with open(at, "a") as f:
                f.write(f"{x.size}\n")
            return numpy.degrees(x)

    v = p3.unit(clustered(300, 4))
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vid long, vec array<float>")
    labels = spark.createDataFrame([(i, i) for i in range(300)], "vid long, c long")
    monkeypatch.setattr(p7, "VISITS", 1)
    monkeypatch.setattr(p7, "np", Counted())
    got = p7.missing_links(rows, labels, centres=v[::10].copy())
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got.collect()} == {(j, i) for i in range(300) for j in range(i) if v[i] @ v[j] >= 0.68}
    with open(at) as f:
        total = sum(map(int, f.read().split()))
    assert total / 300 <= 1 + 5 * 30  # to place, to count and to visit; not 30 again for each group
