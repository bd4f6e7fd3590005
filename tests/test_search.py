"""Similar-item search against brute force at two sizes each."""

import random

import numpy as np
import pandas as pd
import pytest

from claimloom import registry
from claimloom.functions import text as T
from claimloom.operators import search

registry.load()
SIZES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def units(rows):
    m = np.array([r.embedding for r in rows], float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def recall_of(got, rows, k, every=50):
    ids, m = np.array([r.vec_id for r in rows]), units(rows)
    hits = wanted = 0
    for at in np.flatnonzero(ids % every == 0):
        sims = m @ m[at]
        sims[at] = -9
        best = {int(ids[j]) for j in np.lexsort((ids, -sims))[:k]}
        hits += len(best & got.get(int(ids[at]), set()))
        wanted += len(best)
    return hits / wanted


@pytest.mark.parametrize("folder", [*SIZES, "/root/testdata/sf0.1"])
def test_index_finds_nine_of_ten_neighbours(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    got = {}
    for r in registry.QUERIES["j18_indexed_neighbours"](spark, folder).collect():
        got.setdefault(r.a, set()).add(r.b)
    assert all(a % 50 == 0 for a in got) and recall_of(got, rows, 30) >= 0.9


def test_index_visits_few_cells_of_separated_vectors_and_ranks_exactly(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 60)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    m = centres[rng.integers(0, 40, 3000)] + 0.25 * rng.normal(size=(3000, 32))
    m[500:1500] = m[500]  # a third of all rows are one vector
    sample = m / np.linalg.norm(m, axis=1, keepdims=True)
    cells = search.fit_cells(sample, 27)
    assert search.probes_for(sample, cells, 10, 0.95) <= 6
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(4)
    found = search.indexed_neighbours(frame, "vec_id", 10).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.a, r.rank)):
        got.setdefault(r.a, []).append((r.b, r.sim))
    assert len(got) == 60 and all(len(x) == 10 and len({b for b, _ in x}) == 10 for x in got.values())
    for a, best in got.items():
        assert [s for _, s in best] == sorted((s for _, s in best), reverse=True)
        assert all(abs(sample[a] @ sample[b] - s) < 1e-8 for b, s in best)
    copies = [b for b, _ in got[500]]
    assert copies == [b for b in range(501, 511)]


def test_index_of_odd_rows(spark):
    shape = "vec_id long, embedding array<double>"
    odd = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [0.0, 1.0]), (6, [])]
    got = search.indexed_neighbours(spark.createDataFrame(odd, shape), "vec_id", 5).collect()
    assert [(r.a, r.b, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 5, 2)]
    assert search.indexed_neighbours(spark.createDataFrame([], shape), "vec_id").collect() == []


# strings --------------------------------------------------------------------------


def plain_strings(rows, k, every):
    texts = {i: (t or "").lower() for i, t in rows}
    turned = {i: " ".join(sorted(t.split())) for i, t in texts.items()}
    out = {}
    for a in texts:
        if a % every == 0:
            scores = sorted((-max(T._ratio(texts[a], texts[b]), T._ratio(turned[a], turned[b])), b) for b in texts if b != a)
            out[a] = [(b, -s) for s, b in scores[:k]]
    return out


def found_strings(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r.a, r["rank"])):
        got.setdefault(r.a, []).append((r.b, r.score))
    return got


@pytest.mark.parametrize("folder", SIZES)
def test_string_neighbours_are_exact(spark, folder):
    rows = [(r.p_partkey, r.p_name) for r in spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_name").collect()]
    got = found_strings(registry.QUERIES["j20_string_neighbours"](spark, folder))
    want = plain_strings(rows, 30, 50)
    assert {a: [(b, round(s, 9)) for b, s in x] for a, x in want.items()} == got


def test_string_neighbours_of_all_lengths_in_small_blocks(spark):
    rng = random.Random(5)
    words = ["ab", "abc", "cab", "xyz", "zz", "élan", "日本", "a"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 9, 40])))) for i in range(240)] + [(300, None), (301, "  "), (302, "b" * 400), (303, "AB  abc"), (304, "abc ab")]
    frame = spark.createDataFrame(rows, "id long, t string").repartition(3)
    assert found_strings(search.string_neighbours(frame, "id", "t", 4, every=3, block=16)) == plain_strings(rows, 4, 3)
    assert search.string_neighbours(frame.limit(0), "id", "t").collect() == []


def test_few_ratios_are_taken():
    rng = random.Random(6)
    names = [" ".join(rng.choice(["olive", "misty", "linen", "smoke", "almond", "puff", "navy", "rose"]) + str(rng.randrange(100)) for _ in range(4)) for _ in range(1500)]
    rows, asked = pd.DataFrame({"b": range(1500), "y": names}), pd.DataFrame({"a": range(20), "x": names[:20], "floor": 0.0})
    assert search.best_strings(asked, rows, 5)[1] < 0.5 * 20 * 1500


def test_bounds_are_never_under_the_ratio():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcde é日") for _ in range(rng.randrange(30))) for _ in range(120)] + ["", "a", "a" * 300]
    bounds = search.Bounds(texts)
    for k, t in enumerate(texts):
        assert all(b >= T._ratio(t, u) - 1e-9 for b, u in zip(bounds.against(bounds, k, np.arange(len(texts))), texts, strict=True))


# best pairs -----------------------------------------------------------------------


def plain_pairs(items, keep, blocked=()):
    forms = {i: sorted({" ".join(f.lower().split()) for f in fs if f is not None}) for i, fs, _ in items}
    vector = {i: np.array(v) / np.linalg.norm(v) for i, _, v in items}
    best = []
    for a in forms:
        for b in forms:
            if a < b and (a, b) not in blocked:
                cosine = round(float(vector[a] @ vector[b]), 9)
                lexical = max((plain_lexical(x, y) for x in forms[a] for y in forms[b]), default=None)
                if lexical is not None:
                    best.append((-round(0.5 * lexical + 0.5 * cosine, 9), a, b))
    return [(a, b, -s) for s, a, b in sorted(best)[:keep]]


def plain_lexical(x, y):
    p, q = x.split(), y.split()
    c, d = "".join(p), "".join(q)
    if c == d != "":
        return 1.0
    shared = sum(min(p.count(t), q.count(t)) for t in set(p))
    dice = 2 * shared / (len(p) + len(q)) if p and q else 0.0
    g, h = ({t[k : k + 3] for k in range(len(t) - 2)} for t in (c, d))
    grams = len(g & h) / len(g | h) if g and h else 0.0
    return 0.45 * T._ratio(x, y) / 100 + 0.30 * dice + 0.15 * grams + 0.10 * T._ratio(" ".join(sorted(p)), " ".join(sorted(q))) / 100


def same_pairs(got, want):
    assert [(r.a, r.b) for r in got] == [(a, b) for a, b, _ in want]
    assert all(abs(r.score - s) < 2e-9 for r, (_, _, s) in zip(got, want, strict=True))


@pytest.mark.parametrize("folder", SIZES)
def test_best_pairs_are_exact(spark, folder):
    parts = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{folder}/part.parquet").collect()}
    items = [(r.vec_id, [parts[r.vec_id], " ".join(parts[r.vec_id].split()[1:])], r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.vec_id in parts][:260]
    want = plain_pairs(items, 100)
    frame = spark.createDataFrame([(i, f, [float(x) for x in v]) for i, f, v in items], "item long, forms array<string>, embedding array<double>").repartition(3)
    same_pairs(search.best_pairs(frame, 100).collect(), want)
    same_pairs(search.best_pairs(frame, 100, block=40, cells=5).collect(), want)


def test_best_pairs_skip_blocked_ones_and_odd_items(spark):
    rng = random.Random(8)
    items = [(i, [rng.choice(["big red", "red  big", "blue", "a", "Big Red", "bigred", ""])], [rng.gauss(0, 1), rng.gauss(0, 1), 1.0]) for i in range(40)]
    shape = "item long, forms array<string>, embedding array<double>"
    odd = [(90, None, [1.0, 1.0, 1.0]), (91, ["x"], None), (None, ["x"], [1.0, 1.0, 1.0]), (92, [None], [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(items + odd, shape)
    first = plain_pairs(items, 5)
    blocked = {(a, b) for a, b, _ in first}
    denied = spark.createDataFrame([(b, a) for a, b in blocked], "a long, b long")
    same_pairs(search.best_pairs(frame, 5).collect(), first)
    same_pairs(search.best_pairs(frame, 5, denied, block=7, cells=3).collect(), plain_pairs(items, 5, blocked))
    same_pairs(search.best_pairs(frame, 5000, block=7, cells=3).collect(), plain_pairs(items, 5000))
    assert search.best_pairs(spark.createDataFrame([], shape)).collect() == []


def test_far_blocks_do_not_meet():
    one = search.Forms(pd.DataFrame({"i": [1, 2], "form": ["a b", "c d"], "v": [np.array([1.0, 0.0])] * 2, "denied": [None, None]}))
    two = search.Forms(pd.DataFrame({"i": [3, 4], "form": ["a b", "x"], "v": [np.array([0.0, 1.0])] * 2, "denied": [None, None]}))
    assert search.best_pairs_of(one, two, 5, 0.9, False) == ([], 0)
    assert search.best_pairs_of(one, two, 5, 0.4, False)[0] == [(0.5, 1, 3)]
