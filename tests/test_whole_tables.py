"""Registered queries without SQL read every row: small tables against plain walks."""

import datetime

import pytest

from claimloom import registry
from tests.test_graph_and_text import find_roots

registry.load()
LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """48 orders, few of them in any of the residues that the queries once read, and a vector for each name."""
    folder, day = str(tmp_path_factory.mktemp("whole")), datetime.datetime(2024, 1, 1)
    rows = [(k, k * 5 % 83 + 1, "FOP"[k % 3], 1e5 + k * 37 % 53 * 1e4, day, LEVELS[k % 3]) for k in range(1, 48)] + [(54, 28, "F", 2e5, day, "1-URGENT")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    vectors = [(k, [float((k * 7 + j * j) % 11 - 5) for j in range(8)], k % 10) for k in [*range(223), *range(1000, 1016)]]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    names = lambda k, c: (c % 211, k * 7 % 223) if c % 4 == 0 else (1000 + k // 64 * 16 + c % 16, 1000 + k // 64 * 16 + k * 7 % 16)
    return folder, [(k, *(f"n{x}" for x in names(k, c)), p, price) for k, c, _, price, _, p in rows]


def edges_of(claims):
    return sorted({(min(s, o), max(s, o)) for _, s, o, _, _ in claims if s != o})


def run(spark, name, folder):
    return registry.QUERIES[name](spark, folder).collect()


def test_graph_queries_read_every_claim(spark, orders):
    folder, claims = orders
    roots = find_roots(edges_of(claims))
    nodes = set(roots)
    seeded = {r.node: r.cluster for r in run(spark, "g04_seeded_union", folder)}
    assert set(seeded) == nodes and len({seeded[s] for s in ("n0", "n1", "n7") if s in nodes}) == len({"n0", "n1", "n7"} & nodes)
    assert {r.node for r in run(spark, "g05_communities", folder)} == nodes == {r.node for r in run(spark, "g07_complete_linkage", folder)}
    chunks = run(spark, "g09_chunks", folder)
    assert {r.node: r.component for r in chunks} == roots and len(chunks) == len(nodes)
    folds = [r for r in run(spark, "l05_disjoint_folds", folder) if r.repeat == 1]
    whole = find_roots([(s, o) for _, s, o, _, _ in claims])
    assert sorted((r.a, r.b) for r in folds) == sorted((s, o) for _, s, o, _, _ in claims) and all(r.family == whole[r.a] for r in folds)


def test_waves_and_refinement_equal_the_walk_over_every_claim(spark, orders):
    folder, claims = orders
    members = {}
    for _, s, o, _, _ in claims:
        members.setdefault(s, []).append(o)
    taken, want = set(), []
    for parent in sorted(members, key=lambda p: (-len(members[p]), p)):
        if not taken & {parent, *members[parent]}:
            taken |= {parent, *members[parent]}
            want.append(parent)
    assert sorted(r.parent for r in run(spark, "w08_disjoint_wave", folder)) == sorted(want)

    scores = {}
    for _, s, o, _, price in claims:
        if s != o:
            scores[min(s, o), max(s, o)] = max(price, scores.get((min(s, o), max(s, o)), 0))
    cluster = {x: x for pair in scores for x in pair}
    while True:
        used, judged = set(), []
        for a, b in sorted(scores, key=lambda p: (-scores[p], p)):
            if not used & {a, b} and len(judged) < 100:
                used |= {a, b}
                judged.append((a, b))
        to = {b: a for a, b in judged if scores[a, b] > 300000}
        if not to:
            break
        cluster = {x: to.get(c, c) for x, c in cluster.items()}
        fresh = {}
        for (a, b), score in scores.items():
            x, y = sorted((to.get(a, a), to.get(b, b)))
            if (a, b) not in judged and x != y:
                fresh[x, y] = max(score, fresh.get((x, y), 0))
        scores = fresh
    assert {r.item: r.cluster for r in run(spark, "v06_refinement", folder)} == cluster


def test_similar_patterns_read_every_claim(spark, orders):
    folder, claims = orders
    category = lambda n: f"E{int(n[1:]) % 9}"
    patterns = {(category(s), f"R{p[0]}", category(o)) for _, s, o, p, _ in claims}
    assert ("E1", "R1", "E2") in patterns and len(patterns) < 50
    assert {(r.s_cat, r.r_cat, r.o_cat) for r in run(spark, "t09_similar_patterns", folder)} <= patterns - {("E1", "R1", "E2")}
    assert any(k % 5 for k, *_ in claims) and len(run(spark, "t09_similar_patterns", folder)) == len(patterns) - 1


def test_refinement_goes_on_until_a_round_accepts_nothing(spark):
    from pyspark.sql import functions as F

    from claimloom.operators.resolution import refine_until_empty

    star = spark.createDataFrame([("a", x, float(k)) for k, x in enumerate("bcdefgh")], "a string, b string, score double")
    assert {r.cluster for r in refine_until_empty(star, lambda f: f.withColumn("accept", F.lit(True))).collect()} == {"a"}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_document_queries_read_all_ids_and_whole_texts(spark, tmp_path):
    head, tail = "abcdefghijkl", "mnopqrstuvwx"
    far = "z" * 29 + head + "-" + tail + " " * 446 + head + "#" + tail
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(300, "the same title here", "en", "s", 0), (301, "the same title here", "en", "s", 0), (500, far, "en", "s", 0), (502, words, "en", "s", 0)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spans = {r.doc_id: (r.start, r.ratio) for r in run(spark, "x14_best_span", str(tmp_path))}
    assert set(spans) == {300, 301, 500, 502} and spans[500] == (500, 1.0)
    assert {(r.title_id, r.heading_id) for r in run(spark, "j13_best_title", str(tmp_path))} == {(300, 301)}
    glosses = {r.pos: r.gloss for r in run(spark, "v12_token_alignment", str(tmp_path)) if r.doc_id == 502}
    assert glosses == {k: None if k % 4 == 1 else f"W{k}" for k in range(30)}


def test_queries_by_id_read_beyond_their_former_bounds(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    orders = [(k, k, "F", 1.0, day, LEVELS[k % 3]) for k in range(5000, 5004)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, f"part number {k}") for k in range(1500, 1505)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted((r.sid, r.ordinal, r.old_ordinal) for r in run(spark, "j25_subsequence_merge", str(tmp_path))) == [(1250, 0, 0), (1250, 2, 2)]
    assert {r.claim_id for r in run(spark, "x15_joint_choice", str(tmp_path))} == {5000, 5001, 5002, 5003}
    near = {(a, b) for a in range(1500, 1505) for b in range(a + 1, min(a + 4, 1505))}
    assert {(r.a, r.b) for r in run(spark, "x17_lexical_score", str(tmp_path))} == near == {(r.a, r.b) for r in run(spark, "x21_pair_features", str(tmp_path))}
    assert {(r.a, r.b) for r in run(spark, "j20_string_neighbours", str(tmp_path))} == {(1500, b) for b in range(1501, 1505)}


def test_assignment_gives_every_event_a_side(spark, tmp_path):
    events = [(k, k // 2 % 4) for k in range(60)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    want = set()
    for page in range(4):
        free = {k: k * 53 % 900 for k, u in events if u == page and k % 2}
        for line in sorted((k for k, u in events if u == page and not k % 2), key=lambda k: (k * 37 % 900, k)):
            best = min(((abs(y - (line * 37 % 900)), e) for e, y in free.items()), default=(141, 0))
            if best[0] <= 140:
                del free[best[1]]
                want.add((page, line, best[1], best[0]))
    assert want and {(r.page, r.line, r.entry, r.dy) for r in run(spark, "j11_nearest_assignment", str(tmp_path))} == want


@pytest.mark.parametrize("options", [{}, {"block": 50}])
def test_large_clusters_keep_all_their_pairs(spark, options):
    from claimloom.operators.learning import training_pairs

    rows = [(k, 0) for k in range(450)] + [(k, 1) for k in range(450, 460)]
    got = training_pairs(spark.createDataFrame(rows, "item long, cluster long"), "cluster", "item", 20, **options).where("label = 1").collect()
    assert len(got) == 450 * 449 // 2 + 45 and {(r.a, r.b) for r in got} == {(a, b) for a, c in rows for b, e in rows if a < b and c == e}


def test_loops_raise_when_rounds_run_out(spark):
    from claimloom.operators.graph import disjoint_wave, greedy_disjoint

    chain = spark.createDataFrame([(k, k + 1, float(-k)) for k in range(8)], "a long, b long, score double")
    with pytest.raises(RuntimeError):
        greedy_disjoint(chain, rounds=2)
    assert sorted(r.a for r in greedy_disjoint(chain, rounds=4).collect()) == [0, 2, 4, 6]
    steps = spark.createDataFrame([(k, k, [k + 1]) for k in range(8)], "parent long, place long, members array<long>")
    with pytest.raises(RuntimeError):
        disjoint_wave(steps, rounds=2)
    assert sorted(r.parent for r in disjoint_wave(steps).collect()) == [0, 2, 4, 6]
