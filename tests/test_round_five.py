"""Queries that left out rows or candidates, and steps whose passes or copies grew with the table."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom import registry
from claimloom.operators import graph, resolution, workflow
from tests.test_locate_folds_chunks import plain_refinement

registry.load()


def test_visual_lines_of_whole_texts(spark, tmp_path):
    """Empty lines, line ends around a text, long and empty texts, ids that repeat or are null: rows of the SQL."""
    texts = ["a  \n\nb", "\nstart", "end\n", "", "\n\n", "x" * 25000 + " \ny", "r  \r", "é日😀 \nz", None]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, "again\n\nhere"), (None, "no id\n\n"), (None, "nor here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(duck.execute(registry.ORACLES["s12_visual_lines"]).fetchall(), key=key)
    got = sorted((tuple(r) for r in registry.QUERIES["s12_visual_lines"](spark, str(tmp_path)).collect()), key=key)
    assert len(want) == sum(t.count("\n") + 1 for _, t in rows if t is not None) and got == want


@pytest.mark.parametrize("walked", [1 << 18, 30])
def test_centroid_refinement_walks_all_pairs(spark, monkeypatch, walked):
    """Lists of three partners, many copies among the vectors: the pairs of the walk over all of them, and every cluster but one is in a pair."""
    monkeypatch.setattr(workflow, "WALKED", walked)
    monkeypatch.setattr(workflow, "FEW", 8)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(24, 6))
    rows = [(k, base[k if k < 24 else k % 9].tolist()) for k in range(41)]
    asked = []

    def decide(pairs):
        asked.append(pairs.collect())
        return pairs.withColumn("accept", (F.col("score") >= 0.45) & ((F.col("a") + F.col("b")) % 7 != 0))

    got = workflow.refine_by_centroids(spark.createDataFrame(rows, "item long, embedding array<double>"), decide, near=3)
    assert {r.item: r.cluster for r in got.collect()} == plain_refinement(rows, len(rows))
    assert len(asked) > 2 and len(asked[0]) == 20 and len({x for r in asked[0] for x in (r.a, r.b)}) == 40


@pytest.mark.parametrize("most", [2, None])
def test_refinement_by_a_score_equals_its_rounds(spark, most):
    """Decisions by the score alone need no rounds: the clusters are those of the loop, and the table is written once, not once a round."""
    rng = np.random.default_rng(6)
    rows = sorted({(int(min(p)), int(max(p))): float(rng.integers(0, 9)) for p in rng.integers(0, 24, (30, 2))}.items())
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in rows], "a long, b long, score double")
    asked = []
    decide = lambda f: asked.append(1) or f.withColumn("accept", F.col("score") > 4)
    want = {r.item: r.cluster for r in resolution.refine_until_empty(pairs, decide, most).collect()}
    rounds = len(asked)
    assert {r.item: r.cluster for r in resolution.refine_until_empty(pairs, decide, most, above=4).collect()} == want
    assert 1 < len(set(want.values())) < len(want) and rounds > 1 and len(asked) == rounds


def test_members_of_large_clusters_are_sent_to_few_tasks(spark):
    """A cluster of 3,000 in blocks of 50: nine copies of a member at most, and all its pairs."""
    from claimloom.operators.learning import deal_blocks, training_pairs

    members = spark.range(3000).selectExpr("id as item", "0 as cluster")
    pairs = training_pairs(members, "cluster", "item", 5, 50).where("label = 1")
    assert pairs.agg(F.count_distinct("a", "b"), F.count("*")).first()[:] == (3000 * 2999 // 2, 3000 * 2999 // 2)
    copies = deal_blocks(members, "cluster", "item", 50)
    assert all(side.count() <= 9 * 3000 for side in copies) and copies[0].groupBy("_l", "_r").count().count() == 36


def test_communities_in_groups_of_components(spark, monkeypatch):
    """Components in groups, with tables refused: the labels of one task."""
    rng, rows = np.random.default_rng(8), []
    for c in range(9):
        n = 4 + c
        rows += [(f"c{c}n{i}", f"c{c}n{j}", float(rng.integers(1, 4))) for i in range(n) for j in range(i) if rng.random() < 0.45 or i == j + 1]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in rows], "a string, b string, weight double")
    want = {r.node: r.label for r in graph.communities(edges, 3.0).collect()}
    monkeypatch.setattr(graph, "ONE_TASK", 150)
    monkeypatch.setattr(graph, "PACKED", 40)
    monkeypatch.setattr(graph, "_moved", None)
    assert len(rows) * 2 > 150 and {r.node: r.label for r in graph.communities(edges, 3.0).collect()} == want
    assert 9 < len(set(want.values())) < len(want)
