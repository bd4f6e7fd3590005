"""Checked joins, constraints, waves, registers, communities and refinement against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import graph, workflow
from claimloom.plans import lineage


def test_missing_and_repeated_labels_raise(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "b", None)], "k long, s string, o string")
    labels = spark.createDataFrame([("a", 10), ("b", 20)], "tag string, id long")
    assert sorted((r.k, r.s_id, r.o_id) for r in workflow.labelled(rows.where("k = 1"), labels, ["s", "o"], "tag").collect()) == [(1, 10, 20)]
    with pytest.raises(KeyError, match="'o', 'b'"):
        workflow.labelled(rows, labels.where("tag = 'a'"), ["o"], "tag")
    with pytest.raises(ValueError, match="more than once"):
        workflow.labelled(rows, labels.union(labels), ["s"], "tag")


def test_constraints_count_what_breaks_them(spark):
    tables = {
        "categories": spark.createDataFrame([("E1", 3), ("E1", 0), ("x", 1)], "code string, uses long"),
        "assignments": spark.createDataFrame([("n1", "E1"), ("n2", "E7"), (None, "E1")], "tag string, code string"),
        "page_assignments": spark.createDataFrame([("v", 0, "n1"), ("v", 1, "n9")], "volume string, page int, tag string"),
        "page_runs": spark.createDataFrame([("v", 1, 2)], "volume string, page int, claims long"),
    }
    found = {(r["table"], r.rule): r.n for r in workflow.violations(tables).collect() if r.n}
    assert found == {("categories", "primary_key"): 1, ("categories", "code_shape"): 1, ("categories", "seen_positive"): 1, ("assignments", "key_not_null"): 1, ("assignments", "tag_given"): 1, ("assignments", "code_in_categories"): 1, ("page_assignments", "page_positive"): 1, ("page_assignments", "tag_in_assignments"): 1}


def test_structural_predicates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    t = lambda s: F.split(F.lit(s), " ")
    swaps = {("a and b", "b and a"): True, ("a and b forces", "b and a forces"): True, ("a and b forces", "b and a fleet"): False, ("a and b forces", "b forces and a"): True, ("a and b and c", "c and b and a"): False, ("a b", "b a"): False, ("and b", "b and"): False}
    for (a, b), want in swaps.items():
        assert one(workflow.swapped_conjuncts(t(a), t(b))) == want, (a, b)
    turns = {("king of pancala", "pancala king"): ["king", "pancala"], ("king of old pancala", "old pancala king"): ["king"], ("king ava", "king ava"): [], ("king", "king"): [], ("a b c", "b a c"): []}
    for (a, b), want in turns.items():
        assert one(workflow.rotated_roles(t(a), t(b))) == want, (a, b)
    spelled = {("hanthawadi town", "hanthawaddy town"): True, ("ava town", "ava city"): False, ("ava", "ava town"): False, ("shwe taung gyi", "shwetaung gyi"): True, ("a b c d e f g", "a b c d e f h"): False}
    for (a, b), want in spelled.items():
        assert one(workflow.spelling_variants(t(a), t(b))) == want, (a, b)


def test_waves_equal_a_walk(spark):
    rng = random.Random(3)
    roster = [(f"p{k}", k, sorted({f"p{rng.randrange(14)}" for _ in range(4)} - {f"p{k}"})) for k in range(14)]
    accept = lambda parent, member: (int(parent[1:]) + int(member[1:])) % 3 > 0
    left, want, wave = {p: (place, set(m)) for p, place, m in roster}, set(), 0
    while left:
        wave, used, taken = wave + 1, set(), []
        for parent, (_, members) in sorted(left.items(), key=lambda x: x[1][0]):
            if not ({parent} | members) & used:
                used |= {parent} | members
                taken.append(parent)
        rows = {(wave, p, m) for p in taken for m in left[p][1] if accept(p, m)}
        want |= rows
        gone = set(taken) | {m for *_, m in rows}
        left = {p: (place, members - gone) for p, (place, members) in left.items() if p not in gone}
    frame = spark.createDataFrame(roster, "parent string, place int, members array<string>")
    number = lambda c: F.expr(f"cast(substr({c}, 2) as int)")
    decide = lambda f: f.where((number("parent") + number("member")) % 3 > 0)
    assert {tuple(r) for r in workflow.continued_waves(frame, decide).collect()} == want and wave > 1
    with pytest.raises(RuntimeError):
        workflow.continued_waves(frame, decide, most=1)


def test_register_keeps_the_last_sound_decision(spark):
    mentions = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], "window int, tag string")
    decisions = spark.createDataFrame([(1, "x", "a"), (1, "x", "b"), (2, "y", "a"), (2, "z", "c"), (2, "w", "c"), (1, "q", "c")], "window int, name string, tag string")
    register, wrong = workflow.window_register(mentions, decisions)
    assert {(r.tag, r["name"], r.window) for r in register.collect()} == {("a", "y", 2), ("b", "x", 1)}
    assert {(r.window, r.tag, r.problem) for r in wrong.collect()} == {(2, "c", "duplicate"), (1, "c", "unknown")}


def test_communities_in_one_task_and_in_tables(spark, monkeypatch):
    rng, rows = random.Random(1), []
    for c in range(3):
        rows += [(f"n{c}{i}", f"n{c}{j}", 1.0) for i in range(7) for j in range(i) if rng.random() < 0.8]
    rows += [("n00", "n10", 1.0), ("n11", "n20", 1.0)]
    edges = spark.createDataFrame(rows, "a string, b string, weight double")
    found = {r.node: r.label for r in graph.communities(edges).collect()}
    assert {n: f"n{n[1]}0" for n in found} == found and len(found) == 21
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert {r.node: r.label for r in graph.communities(edges.where("a < 'n2' and b < 'n2'")).collect()} == {n: x for n, x in found.items() if n < "n2"}


def test_refinement_merges_bars_and_recomputes(spark):
    rng = np.random.default_rng(2)
    centre = np.eye(4)
    vectors = [(f"v{k}", (centre[k % 4] + 0.05 * rng.normal(size=4)).tolist()) for k in range(12)]
    frame = spark.createDataFrame(vectors, "item string, embedding array<double>")
    group = lambda c: F.expr(f"cast(substr({c}, 2) as int) % 4")
    asked = []

    def decide(pairs):
        asked.append({(r.a, r.b) for r in pairs.collect()})
        return pairs.withColumn("accept", group("a") == group("b"))

    clusters = {}
    for r in workflow.refine_by_centroids(frame, decide).collect():
        clusters.setdefault(r.cluster, set()).add(int(r.item[1:]) % 4)
    assert len(clusters) == 4 and all(len(v) == 1 for v in clusters.values()) and len(asked) > 1


def test_forest_weight_equals_kruskal(spark):
    rng = random.Random(5)
    rows = [(a, b, float(rng.randrange(40))) for a in range(16) for b in range(a) if rng.random() < 0.4]
    root, weight = list(range(16)), 0.0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, w in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if find(a) != find(b):
            root[find(a)], weight = find(b), weight + w
    assert graph.spanning_forest(spark.createDataFrame(rows, "a long, b long, weight double")).agg(F.sum("weight")).first()[0] == weight


def test_depths_and_parents(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y")], "a string, b string")
    found = {r.node: (r.depth, r.parent) for r in graph.bfs_depths(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert found == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "e": (3, "d")}


def test_names_and_copies(spark):
    assert lineage.fresh_name(["a", "_N", "_n_"], "_n") == "_n__" and lineage.fresh_name([], "x") == "x"
    frame = lineage.cut(spark.range(5))
    assert frame.count() == 5 and spark.sparkContext._jsc.sc().conf().get("spark.cleaner.referenceTracking.cleanCheckpoints") == "true"
