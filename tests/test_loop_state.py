"""State of loops: what Spark expects of it does not grow with the rounds, and what is spent is deleted."""

import os
import random

import pytest

from claimloom.operators import graph
from claimloom.plans.lineage import checkpoint_dir, settled


def edges(spark, n=60):
    draw = random.Random(5)
    rows = sorted({tuple(sorted(draw.sample(range(n), 2))) for _ in range(4 * n)})
    return spark.createDataFrame([(a, b, draw.randint(1, 99) / 100) for a, b in rows], "a long, b long, sim double")


def expected_bytes(frame):
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@pytest.mark.parametrize(
    "loop",
    [
        lambda e: graph.complete_linkage(e, 0.3),
        lambda e: graph.communities(e.withColumnRenamed("sim", "weight")),
        lambda e: graph.greedy_disjoint(e.withColumnRenamed("sim", "score")),
        lambda e: graph.spanning_forest(e.withColumnRenamed("sim", "weight")),
    ],
)
def test_expected_sizes_do_not_grow_with_rounds(spark, loop):
    assert expected_bytes(loop(edges(spark))) < 1e12


def test_spent_copies_are_deleted(spark):
    home = checkpoint_dir(spark).removeprefix("file:")
    first = settled(spark.range(5))
    there = set(os.listdir(home))
    second = settled(first.where("id > 2"), first)
    assert {r.id for r in second.collect()} == {3, 4} and len(there - set(os.listdir(home))) == 1


@pytest.mark.parametrize("most", [1, 3, 200])
def test_first_disjoint_pairs_are_those_of_the_walk(spark, most):
    """With one hub in nearly all of the best pairs, a short prefix does not hold enough of them."""
    rows = [(0, k, 1000.0 - k) for k in range(1, 80)] + [(100 + k, 200 + k % 7, float(k % 5)) for k in range(40)]
    used, want = set(), []
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if len(want) < most and not {a, b} & used:
            used |= {a, b}
            want.append((a, b, s))
    got = graph.greedy_disjoint(spark.createDataFrame(rows, "a long, b long, score double"), most)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_refinement_in_small_passes_and_its_expected_size(spark):
    from claimloom.operators.resolution import refine_until_empty

    rows = edges(spark, 30).limit(40).withColumnRenamed("sim", "score")
    found = refine_until_empty(rows, lambda f: f.withColumn("accept", f.score > 0.5), 5)
    assert expected_bytes(found) < 1e12
    plain = rows.collect()
    home = {x: x for r in plain for x in (r.a, r.b)}
    for r in plain:
        if r.score > 0.5:
            low, high = sorted((home[r.a], home[r.b]))
            home = {x: low if h == high else h for x, h in home.items()}
    assert {r["item"]: r.cluster for r in found.collect()} == home
