"""Located quotations, grouped folds, the accepting limiter, chunk reassembly and centroid refinement against plain versions."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from claimloom import registry
from claimloom.operators import learning
from claimloom.operators.locate import located, place
from claimloom.streaming import windows

registry.load()
PAGE = "the cat sat\na red hat and a red coat\nThe  Dog ran\nthe cat sat again\nsplit over\nlines here ... end\n\nthe cat sat"


@pytest.mark.parametrize(
    "needle, hint, nth, want, mode",
    [
        ("the cat sat", 1, 1, ["the cat sat"], "line"),
        ("the cat sat", 3, 1, ["the cat sat"], "near"),  # line 4 is nearer than line 1
        ("a red", 2, 2, ["a red"], "line"),
        ("a red", 2, 3, None, None),
        ("the dog ran", 2, 1, ["The  Dog ran"], "normalized"),
        ("over\nlines", 1, 1, ["over\nlines"], "page"),
        ("split over lines", 2, 1, ["split over\nlines"], "normalized"),
        ("redcoat", 2, 1, ["red coat"], "compact"),
        ("a red hat … coat", 2, 1, ["a red hat", "coat"], "ellipsis"),
        ("the cat ... again", 4, 1, ["the cat", "again"], "ellipsis"),
        ("again ... hat", 4, 1, None, None),
        ("the cat sat", None, 3, ["the cat sat"], "page"),
        ("nowhere", 1, 1, None, None),
        (" ", 1, 1, None, None),
        (None, 1, 1, None, None),
    ],
)
def test_places(needle, hint, nth, want, mode):
    got = place(PAGE, needle, hint, nth)
    if want is None:
        assert got is None
    else:
        assert [PAGE[a:b] for a, b in got[0]] == want and got[1] == mode


def test_occurrences_count_from_the_hint():
    starts = [k for k in range(len(PAGE)) if PAGE.startswith("the cat sat", k)]
    assert place(PAGE, "the cat sat", 3, 1)[0][0][0] == starts[1]
    assert [place(PAGE, "cat sat", 5, n)[0][0][0] for n in (1,)] == [starts[1] + 4]
    assert place(PAGE, "cat sat", None, 2)[0][0][0] == starts[1] + 4
    assert [place("aXaXa xa", "AX", 1, n)[0] for n in (1, 2)] == [[(0, 2)], [(2, 4)]]


def test_every_text_is_located(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    missing = 0
    for r in registry.QUERIES["x13_located"](spark, folder).collect():
        line = texts[r.doc_id].split("\n")[len(texts[r.doc_id].split("\n")) // 2].strip(" ")
        if r.starts is None:
            missing += bool(line.strip()) and (r.doc_id % 4 < 3 or len(line) >= 24)  # shorter ends overlap
            continue
        found = ["".join(texts[r.doc_id][a:b].split()).lower() for a, b in zip(r.starts, r.ends, strict=True)]
        quote = line[:40] if r.doc_id % 4 < 3 else None
        assert found == ["".join(quote.split()).lower()] if quote else found[0] == "".join(line[:12].split()).lower()
    assert missing <= 0.02 * len(texts)
    nothing = spark.createDataFrame([(None, "a"), ("a", None), ("", "")], "t string, n string")
    assert all(r[0].spans is None for r in nothing.selectExpr("t", "n", "1 as h", "1 as o").select(located("t", "n", "h", "o")).collect())


# folds ------------------------------------------------------------------------------


def family_pairs(seed, families, size):
    rng, rows = random.Random(seed), []
    for f in range(families):
        items = [f * 100 + k for k in range(rng.randint(2, size))]
        yes = rng.random()
        rows += [(items[0], b, int(rng.random() < yes), rng.random()) for b in items[1:]]
    return rows


@pytest.mark.parametrize("largest", [1000, 5])
def test_folds_are_disjoint_and_even(spark, largest):
    rows = family_pairs(1, 160, 9) + [(90_000, 90_001 + k, k % 2, 0.5) for k in range(60)]
    frame = spark.createDataFrame(rows, "a long, b long, label int, x double")
    got = learning.disjoint_folds(frame, 5, 3, largest=largest).collect()
    assert len(got) == 3 * len(rows)
    families, folds_of = {}, {}
    for r in got:
        for item in (r.a, r.b):
            assert families.setdefault((r.repeat, item), r.fold) == r.fold
        folds_of.setdefault(r.family, {})[r.repeat] = r.fold
    assert len({tuple(sorted(x.items())) for x in folds_of.values()}) > 10  # repeats differ
    yes = sum(r[2] for r in rows)
    for repeat in range(3):
        for fold in range(5):
            part = [r for r in got if (r.repeat, r.fold) == (repeat, fold)]
            assert abs(len(part) - len(rows) / 5) <= 0.1 * len(rows) and abs(sum(r.label for r in part) - yes / 5) <= 0.1 * yes


def test_out_of_fold_scores_and_cross_validation(spark):
    rows = [(a, b, int(x > 0.5), x) for a, b, _, x in family_pairs(2, 60, 5)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, a long, b long, label int, x double")
    dealt = learning.disjoint_folds(frame, 3, 2)
    scores = {r.k: r.p for r in learning.out_of_fold(dealt, ["k"], ["x"]).collect()}
    assert len(scores) == len(rows) and np.mean([(scores[k] > 0.5) == (r[2] == 1) for k, r in enumerate(rows)]) > 0.9
    with pytest.raises(RuntimeError):
        learning.out_of_fold(dealt.where("fold <> 0 or repeat <> 0"), ["k"], ["x"])
    ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(dealt.where("repeat = 0"))
    cv = CrossValidator(estimator=LogisticRegression(), estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(), numFolds=3, foldCol="fold")
    assert cv.fit(ready).avgMetrics[0] > 0.9


def test_empty_pairs_have_no_folds(spark):
    assert learning.disjoint_folds(spark.createDataFrame([], "a long, b long, label int"), 5, 2).collect() == []


# limiter ----------------------------------------------------------------------------


def test_accepted_requests_are_the_walk_s(spark):
    folder, want, taken = "/root/testdata/sf0.01", {}, {}
    rows = spark.read.parquet(f"{folder}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) as t").collect()
    for r in sorted(rows, key=lambda r: (r.t, r.event_id)):
        kept = [t for t in taken.get(r.user_id, []) if t > r.t - 36_000_000_000]
        ok = len(kept) < 3
        taken[r.user_id] = kept + [r.t] * ok
        want[r.event_id] = (ok, 3 - len(taken[r.user_id]))
    assert {r.event_id: (r.allowed, r.remaining) for r in registry.QUERIES["v05_accepted"](spark, folder).collect()} == want


# chunks -----------------------------------------------------------------------------


def test_chunks_of_a_page_share_their_categories(spark):
    proposals = [(1, 0, "NE", 0, "NE01", "Big  City"), (1, 0, "NR", 0, "NR01", "lives in"), (1, 1, "NE", 0, "NE01", "River"), (1, 1, "NE", 1, "NE02", "big city"), (2, 0, "NE", 0, "NE01", "x"), (3, 0, "NE", 0, "NE01", "y")] + [(4, k // 50, "NE", k, f"NE{k}", f"c{k}") for k in range(100)]
    notes = [(1, 0, 0, "NE01", "NR01", "E5"), (1, 1, 0, "NE01", "R2", "NE02"), (2, 0, 0, "NE01", "R1", "E1"), (3, 0, 0, "NE07", "R1", "E1"), (5, 0, 0, "E1", "R1", "E2")]
    chunks = [(1, 0, "accepted"), (1, 1, "accepted"), (2, 0, "accepted"), (2, 1, "truncated"), (3, 0, "accepted"), (4, 0, "accepted"), (4, 1, "accepted"), (5, 0, "accepted")]
    made = windows.reassembled(
        spark.createDataFrame(proposals, "page long, chunk long, prefix string, place long, id string, label string"),
        spark.createDataFrame(notes, "page long, chunk long, place long, s string, r string, o string"),
        spark.createDataFrame(chunks, "page long, chunk long, kind string"),
    )
    categories, annotations, errors = (sorted(map(tuple, f.collect())) for f in made)
    assert categories == [(1, "NE01", "Big  City"), (1, "NE02", "River"), (1, "NR01", "lives in")]
    assert annotations == [(1, 0, 0, "NE01", "NR01", "E5"), (1, 1, 0, "NE02", "R2", "NE01"), (5, 0, 0, "E1", "R1", "E2")]
    assert errors == [(2, "chunk 1 truncated"), (3, "an id that was not proposed"), (4, "too many provisional categories")]


# refinement -------------------------------------------------------------------------


def plain_refinement(rows, near=15):
    units = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows}
    cluster, barred = {i: i for i in units}, set()
    while True:
        names = sorted(set(cluster.values()))
        m = np.array([np.mean([units[i] for i in cluster if cluster[i] == c], 0) for c in names])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        sims, pairs = m @ m.T, {}
        for k, c in enumerate(names):
            for j in [j for j in np.lexsort((names, -sims[k])) if j != k][:near]:
                pairs[min(c, names[j]), max(c, names[j])] = sims[k, j]
        used, merged, refused = set(), {}, set()
        for (a, b), s in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            if (a, b) in barred or a in used or b in used:
                continue
            used |= {a, b}
            if s >= 0.45 and (a + b) % 7:
                merged[b] = a
            else:
                refused.add((a, b))
        if not merged:
            return cluster
        cluster = {i: merged.get(c, c) for i, c in cluster.items()}
        barred = {tuple(sorted((merged.get(a, a), merged.get(b, b)))) for a, b in barred | refused}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_centroid_refinement_is_the_plain_loop(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = plain_refinement(rows)
    assert len(set(want.values())) < len(want)
    assert {r.item: r.cluster for r in registry.QUERIES["v06_centroid_refinement"](spark, folder).collect()} == want


# codes ------------------------------------------------------------------------------


def test_codes_are_kept_and_conflicts_refuse_the_batch(spark):
    from claimloom.operators.workflow import assign_codes

    shape = "tag string, place long, page long, wanted long"
    register = spark.createDataFrame([("a", 4, 2), ("b", 9, 1)], "tag string, code long, pages long")
    batch = [("c", 5, 1, None), ("a", 1, 7, None), ("a", 2, 7, 4), ("d", 3, 1, None), ("e", 9, 1, 20), ("c", 6, 2, None)]
    got = assign_codes(register, spark.createDataFrame(batch, shape)).collect()
    assert {r.tag: (r.code, r.pages) for r in got} == {"a": (4, 3), "b": (9, 1), "d": (21, 1), "c": (22, 2), "e": (20, 1)}
    for bad in ([("a", 1, 1, 5)], [("f", 1, 1, 30), ("f", 2, 1, 31)], [("f", 1, 1, 9)], [("f", 1, 1, 30), ("g", 1, 1, 30)]):
        with pytest.raises(ValueError):
            assign_codes(register, spark.createDataFrame(bad, shape))
    assert {(r.tag, r.code) for r in assign_codes(register, spark.createDataFrame([], shape)).collect()} == {("a", 4), ("b", 9)}
