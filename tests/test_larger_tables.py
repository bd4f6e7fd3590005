"""Queries over tables larger, or with larger groups, than the smallest ones, against plain walks and their SQL."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimloom import registry

registry.load()


def rows(frame, places=6):
    numbered = lambda v: None if v is None or v is pd.NA or v != v else round(v, places) if isinstance(v, float) else str(v)
    return sorted((tuple(map(numbered, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def equals_sql(spark, folder, name, **tables):
    """Whether a query over ``tables`` of pandas frames gives what its SQL gives."""
    duck = duckdb.connect()
    for table, frame in tables.items():
        frame.to_parquet(f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    mine, theirs = registry.QUERIES[name](spark, str(folder)).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert rows(mine) == rows(theirs)
    return mine


def test_page_marks_of_five_digits(spark, tmp_path):
    ids = [9998, 9999, 10000, 10001, 123456]
    equals_sql(spark, tmp_path, "s08_marked_volume", documents=pd.DataFrame({"doc_id": ids, "text": [f" page {i}\n" for i in ids], "lang": "en", "source": "a"}))


def test_similar_tags_beyond_a_hundred(spark, tmp_path):
    n = 1200
    orders = pd.DataFrame({"o_orderkey": range(n), "o_custkey": [7 * k % 397 for k in range(n)], "o_orderpriority": "5-LOW", "o_orderstatus": "O", "o_totalprice": 1.0})
    vectors = pd.DataFrame({"vec_id": range(250), "embedding": [[1.0, k / 1000] for k in range(250)], "label": 0})
    assert len(equals_sql(spark, tmp_path, "t08_similar_tags", orders=orders, embeddings=vectors)) > 100


def test_every_vector_asks(spark, tmp_path):
    """Many equal scores among 700 rows: ties go to the smaller id, and all rows ask."""
    turn = [[float(k % 11), float(k % 7) - 3, 1.0 + k % 3] for k in range(700)]
    found = registry.QUERIES["j17_cosine_neighbours"]
    pd.DataFrame({"vec_id": range(3, 703), "embedding": turn, "label": 0}).to_parquet(f"{tmp_path}/embeddings.parquet")
    assert found(spark, str(tmp_path)).select("a").distinct().count() == 700


def test_nearest_rows_with_ties():
    import numpy as np

    from claimloom.operators.joins import nearest_in_block

    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (900, 3)).astype(float)  # products are exact, many are equal
    vectors[5] = np.nan
    a, b = pd.DataFrame({"i": range(900), "v": list(vectors)}), pd.DataFrame({"j": range(899, -1, -1), "w": list(vectors[::-1])})
    mine = nearest_in_block(a, b, 15)
    for i in (0, 17, 512, 899):
        score = vectors @ vectors[i]
        wanted = sorted((j for j in range(900) if j != i and score[j] == score[j]), key=lambda j: (-score[j], j))[:15]
        assert mine[mine["a"] == i]["b"].tolist() == wanted
    assert 5 not in set(mine["b"]) and 5 not in set(mine["a"])


def _fast(spark, frame, seconds):
    """The rows of ``frame``, which must come within ``seconds``."""
    import time

    began = time.monotonic()
    found = frame.toPandas()
    assert time.monotonic() - began < seconds
    return found


def test_gaps_of_a_long_key(spark):
    """One key of 300,000 rows, the last of them known: each row looks forward to it."""
    from claimloom.operators.joins import fill_gaps

    n = 300_000
    one = spark.range(n).select(F.lit(0).alias("grp"), "id", F.when(F.col("id") == n - 1, 7 * n).alias("printed"))
    assert _fast(spark, fill_gaps(one, "grp", "id", "printed").where(f"filled <> {6 * n} + id + 1").select("id"), 60).empty


def test_assignment_equals_the_walk(spark):
    from claimloom.operators.resolution import nearest_assignment

    lines = pd.DataFrame([(p, k, (k * 37 + p) % 90) for p in range(3) for k in range(160)], columns=["page", "line", "y"])
    entries = pd.DataFrame([(p, k, (k * 53) % 70 * (1 + p)) for p in range(3) for k in range(120)], columns=["page", "entry", "y"])
    wanted = []
    for p in range(3):
        free = dict(entries[entries["page"] == p][["entry", "y"]].itertuples(index=False))
        for line, y in lines[lines["page"] == p].sort_values(["y", "line"])[["line", "y"]].itertuples(index=False):
            best = min(((abs(free[e] - y), e) for e in free if abs(free[e] - y) <= 9), default=None)
            if best:
                del free[best[1]]
                wanted.append((p, line, best[1], best[0]))
    mine = nearest_assignment(spark.createDataFrame(lines), spark.createDataFrame(entries), "page", 9).toPandas()
    assert sorted(mine.itertuples(index=False, name=None)) == sorted(wanted)


def test_assignment_of_a_large_page(spark):
    from claimloom.operators.resolution import nearest_assignment

    rows = spark.range(60_000).selectExpr("0L as page", "id", "id * 37 % 900 as y")
    assert len(_fast(spark, nearest_assignment(rows.toDF("page", "line", "y"), rows.toDF("page", "entry", "y"), "page"), 60)) == 60_000


@pytest.mark.parametrize("name", ["x17_lexical_score", "x21_pair_features"])
def test_label_pairs_meet_by_equality(spark, tmp_path, name):
    pd.DataFrame({"p_partkey": [1, 2, 3, 5, 9], "p_name": ["red steel", "blue steel", "red", "x", "y"]}).to_parquet(f"{tmp_path}/part.parquet")
    frame = registry.QUERIES[name](spark, str(tmp_path))
    assert "NestedLoop" not in frame._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, frame.select("a", "b").collect())) == [(1, 2), (1, 3), (2, 3), (2, 5), (3, 5)]


def test_best_titles_of_one_page(spark):
    """6,000 titles and as many headings on one page, against plain sets for some of them."""
    from claimloom.operators.resolution import best_title

    text = lambda i: f"title {i * 7919 % 6007} of {i % 13}" if i % 500 else None
    titles = spark.createDataFrame([(i, 1, text(i)) for i in range(6000)], "title_id long, page int, title string")
    headings = spark.createDataFrame([(i, 2, text(3 * i)) for i in range(6000)], "heading_id long, page int, heading string")
    found = _fast(spark, best_title(titles, headings, 2500), 60).set_index("title_id")
    grams = lambda t: {t[k : k + 3] for k in range(len(t) - 2)} if t else set()
    other = [grams(text(3 * i)) for i in range(6000)]
    assert len(found) == 6000
    for i in range(0, 6000, 250):
        g = grams(text(i))
        sim = [len(g & h) / len(g | h) if g | h else 0.0 for h in other]
        best = max(sim)
        assert (found.at[i, "heading_id"], found.at[i, "sim"]) == (sim.index(best), best)


def test_word_budget_of_a_long_key(spark):
    """60,000 segments of one key, against a walk; a fold that copies its list at each step takes minutes."""
    from claimloom.operators.labels import word_budget

    n, budget = 60_000, 100
    rows_ = spark.range(n).selectExpr("id % 2 as volume", "id as sid", "cast(id * 37 % 61 as int) as words")
    found = {(r.volume, r.sid): r.block for r in _fast(spark, word_budget(rows_, "volume", "sid", "words", budget), 40).itertuples()}
    for volume in (0, 1):
        block = total = 0
        for sid in range(volume, n, 2):
            words = sid * 37 % 61
            if total > 0 and total + words > budget:
                block, total = block + 1, 0
            total += words
            assert found[volume, sid] == block
    assert len(found) == n


def test_recall_makes_no_pairs_of_a_label(spark, tmp_path):
    """30,000 vectors of one label have 90 million eligible pairs."""
    from claimloom.operators.pages import label_recall

    e = spark.range(30_000).selectExpr("id as vec_id", "0 as label")
    got = label_recall(e, spark.range(100).selectExpr("id as a", "id + 1 as b"), "vec_id", "label", 10).first()
    assert (got.eligible, got.found) == (3000 * 29_999, 10)


def test_density_groups_equal_the_walk(spark):
    """Groups of 200 rows, against a plain walk over all distances."""
    import numpy as np

    from claimloom.operators.learning import dense_groups

    turn = np.random.default_rng(5).uniform(0, 6.28, 400)
    vectors = np.stack([np.cos(turn), np.sin(turn), np.where(np.arange(400) % 3, 0.0, 0.4)], 1)
    rows_ = spark.createDataFrame([(k % 2, k, vectors[k].tolist()) for k in range(400)], "g int, i long, embedding array<double>")
    mine = dict(dense_groups(rows_, "g", "i", 3, 0.0005).select("i", "cluster").toPandas().itertuples(index=False))
    for g in (0, 1):
        ids = list(range(g, 400, 2))
        v = vectors[ids] / np.linalg.norm(vectors[ids], axis=1, keepdims=True)
        near = 1 - v @ v.T <= 0.0005
        core, label = near.sum(1) >= 3, np.full(len(v), -1)
        for k in np.flatnonzero(core):
            if label[k] < 0:
                todo, label[k] = [k], k
                while todo:
                    x = todo.pop()
                    for y in np.flatnonzero(near[x] & (label < 0)):
                        label[y] = k
                        todo += [y] if core[y] else []
        assert [mine[i] for i in ids] == label.tolist()


def planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_large_clusters_are_not_broadcast(spark):
    """copies of members looked small to the plan and went through the driver."""
    from claimloom.operators.learning import training_pairs

    plan = planned(training_pairs(spark.range(400).selectExpr("id as item", "id % 3 as cluster"), "cluster", "item", 5, 20))
    assert "SortMergeJoin [cluster" in plan and not [line for line in plan.split("\n") if "BroadcastHashJoin" in line and "_l#" in line]


def test_matching_blocks_are_those_of_difflib(monkeypatch):
    """each block was searched for anew; the last text took hours so."""
    import random
    from difflib import SequenceMatcher

    from claimloom.operators import resolution

    rng = random.Random(4)
    hits = lambda blocks: {i + k: j + k for i, j, n in blocks for k in range(n)}
    for turn in range(600):
        monkeypatch.setattr(resolution, "PAIRS", (1, 7, 1 << 20)[turn % 3])
        a = [rng.randrange(1 + turn % 5) for _ in range(rng.randrange(40))]
        b = [x for k, x in enumerate(a) if k % 4 != 1] if turn % 2 else [rng.randrange(1 + turn % 4) for _ in range(rng.randrange(40))]
        assert hits(resolution.matching_blocks(a, b)) == hits(SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    monkeypatch.setattr(resolution, "PAIRS", 1 << 20)
    a = [rng.randrange(300) for _ in range(16_000)]
    assert len(hits(resolution.matching_blocks(a, [x for k, x in enumerate(a) if k % 4 != 1]))) > 8_000


def test_equal_texts_are_searched_for_once(spark, monkeypatch):
    """every row with one text met every row with another."""
    from claimloom.operators import search

    met, own = [], search._text_neighbours
    monkeypatch.setattr(search, "_text_neighbours", lambda texts, *rest: met.append(texts.count()) or own(texts, *rest))
    texts = ["ring", "large ring", "hot bolt", "", "bolt hot"]
    rows = [(k, texts[k * k % 5 if k % 3 else k % 5]) for k in range(200)]
    got = {(r.a, r.rank): (r.b, round(r.score, 6)) for r in search.string_neighbours(spark.createDataFrame(rows, "id long, t string"), "id", "t", 7, 10).collect()}
    turned = lambda t: " ".join(sorted(t.split()))
    for a, x in rows[::10]:
        best = sorted((-max(search.T._ratio(x, y), search.T._ratio(turned(x), turned(y))), b) for b, y in rows if b != a)[:7]
        assert [got[a, k + 1] for k in range(7)] == [(b, round(-s, 6)) for s, b in best]
    assert met == [5] and len(got) == 20 * 7


def test_pairs_are_merged_after_they_are_dealt(spark, tmp_path):
    """the task that read a file merged all its pairs in memory first."""
    pd.DataFrame({"c_custkey": range(300)}).to_parquet(f"{tmp_path}/customer.parquet")
    plan = planned(registry.QUERIES["j21_fused_candidates"](spark, str(tmp_path)))
    assert "Exchange hashpartitioning(a#" in plan and not [line for line in plan.split("\n") if "Exchange hashpartitioning(a#" in line and ", b#" in line]
    equals_sql(spark, tmp_path, "j21_fused_candidates", customer=pd.DataFrame({"c_custkey": range(300)}))


def test_trees_grow_over_rows_of_one_file_in_parts(spark, monkeypatch):
    """one task read all rows of a file again in each round."""
    from claimloom.operators import learning

    seen = []

    class Fitted:
        def __init__(self, stages):
            pass

        def fit(self, train):
            seen.append((train.rdd.getNumPartitions(), train.count()))

    monkeypatch.setattr(learning, "Pipeline", Fitted)
    monkeypatch.setattr(learning, "TREE_ROWS", 50)
    rows = spark.range(500).coalesce(1).selectExpr("cast(id as double) as x", "cast(id % 2 as double) as label")
    learning.boosted(rows, ["x"])
    learning.boosted(rows.where("x < 50"), ["x"])
    assert seen == [(10, 500), (1, 50)]
