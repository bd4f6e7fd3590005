"""Packing round trip, duplicates against brute force, mixing's shares, and awkward rows for each."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from claimloom.llm import duplicates, mixing, packing

SHAPE = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, a column whose name an operator uses."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", None), (3, "  \n\t", "a"), (4, "one", "b"), (4, "one", "b"), (None, "one", "b"), (6, long, "b"), (7, long, None), (8, "x" * 50_000, "a")]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SHAPE).withColumn("size", F.lit("clash")).withColumn("band", F.lit(1))


def shingles(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_components(rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_corpus(seed):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 120]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(copy).lower() if rng.random() < 0.5 else " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rows = near_corpus(size)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in duplicates.near_duplicates(frame, size, 80).collect()}
    want = brute_components(rows, size)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_closing_links_find_what_stars_miss(spark):
    """A chain whose smallest id is linked with one text only, with all texts in one band."""
    words = [f"v{i}" for i in range(300)]
    rows = [(k, " ".join(words[10 * k : 10 * k + 120])) for k in range(18)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sketches = duplicates.sketch(frame, 4)
    bands = spark.range(18).selectExpr("1L as band", "id as doc_id")
    none = spark.createDataFrame([], "doc_id long, label long")
    found = {tuple(sorted(r)) for r in duplicates.closing_links(bands, none, sketches, frame, 4, 80).collect()}
    want = {(a, b) for (a, x), (b, y) in combinations(rows, 2) if 100 * len(shingles(x, 4) & shingles(y, 4)) >= 80 * len(shingles(x, 4) | shingles(y, 4))}
    assert want and found <= want and {n for e in found for n in e} == {n for e in want for n in e}


def test_hyperminhash_estimate_is_close():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        whole = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
        both, rest = whole[: int(4000 * share)], whole[int(4000 * share) :]
        a, b = np.sort(np.concatenate([both, rest[::2]])), np.sort(np.concatenate([both, rest[1::2]]))
        guess, error = duplicates.estimate(duplicates.registers(a), duplicates.registers(b)[None], len(a), np.array([len(b)]))
        assert abs(guess[0] - share) < 5 * error[0]


def test_near_duplicates_awkward_rows(spark):
    got = duplicates.near_duplicates(awkward(spark), 4, 80).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and by[7].component_id == 6 and not by[7].kept and by[6].kept
    assert next(r for r in got if r.doc_id is None).component_id is None
    assert duplicates.near_duplicates(awkward(spark).limit(0), 4, 80).collect() == []


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    frame = awkward(spark)
    got = packing.pack_documents(frame).collect()
    whole = Tokenizer.from_file(packing.vocabulary_path())
    want = sorted(((r.doc_id or -1), p, at, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for r in frame.collect() for ids in [[*whole.encode(r.text or "", add_special_tokens=False).ids, 0]] for p, at in enumerate(range(0, len(ids), 2048)) for x in [ids[at : at + 2048]])
    assert sorted(((r.doc_id or -1), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(frame.limit(0)).collect() == []


def test_encoder_keeps_the_tokenizers_ids():
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(packing.vocabulary_path()), packing.WordEncoder(packing.vocabulary_path())
    for text in ("It's <|endoftext|> 12\x1c3 é́ a b c", " ́x 'LL don't\x0bthe ΣΑΣ İx", "日本 語　x\u0085y", "ABC!! x|| <|ENDOFTEXT|>. a<|endoftext|>! 9%.. ..!! 's! it'S. A.B.,"):
        assert np.frombuffer(encoder(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_tree_of_nodes_packs_tightly(spark):
    rng = random.Random(5)
    sizes = [rng.choice([rng.randint(1, 300), rng.randint(300, 1500), 2048]) for _ in range(3000)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    placed = packing.pack_pieces(pieces, leaf_items=200, fan_in=3).collect()
    assert sorted(r.uid for r in placed) == list(range(3000))
    assert len({r.sequence_id for r in placed}) <= 1.01 * sum(sizes) / 2048 + 1
    spans = {}
    for r in placed:
        spans.setdefault(r.sequence_id, []).append((r.offset, sizes[r.uid]))
    for parts in spans.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [s for _, s in sorted(parts)])[:-1]) and sum(s for _, s in parts) <= 2048


def fill(sizes, weights=(5, 2, 1)):
    """Shares by weight, resharing the excess until none is above its limit."""
    w = {s: weights[k % 3] for k, s in enumerate(sorted(sizes))}
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while open_:
        unit = left / sum(w[s] for s in open_)
        above = {s for s in open_ if w[s] * unit > 2 * sizes[s]}
        if not above:
            return target | {s: w[s] * unit for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_mixing_targets_and_takes(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 30), f"s{min(rng.randint(0, 9), rng.randint(0, 9))}") for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SHAPE)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, by_id, taken = fill(sizes), {i: s for i, _, s in rows}, {}
    for r in got:
        assert r.target == pytest.approx(want[by_id[r.doc_id]]) and r.taken <= 2 * r.size
        taken[by_id[r.doc_id]] = taken.get(by_id[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) < 0.12 * sizes[s] for s in sizes)
    copies = mixing.emit_copies(spark.createDataFrame(rows, SHAPE)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {r.doc_id: r.copies for r in got if r.copies}


def test_mixing_awkward_rows(spark):
    got = mixing.mix_sources(awkward(spark)).collect()
    assert len(got) == 9 and all(r.taken <= 2 * r.size for r in got)
    assert {r.doc_id: r.size for r in got}[2] == 0
    assert mixing.mix_sources(awkward(spark).limit(0)).collect() == []
    assert mixing.emit_copies(awkward(spark)).columns == awkward(spark).columns
