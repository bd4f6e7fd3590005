"""Graph loops against plain walks, and text functions on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import aggregates, graph, joins, labels
from claimloom.operators.components import connected_components


def find_roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


def random_edges(seed, nodes=120, count=100):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    edges = random_edges(seed) + [(k, k + 1) for k in range(200, 260)] + [(500, 500)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == find_roots(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def scored(seed):
    rng = random.Random(seed)
    seen = {(min(e), max(e)) for e in random_edges(seed, 40, 150) if e[0] != e[1]}
    return [(a, b, float(rng.randrange(30))) for a, b in sorted(seen)]


def test_greedy_disjoint_equals_the_walk(spark):
    pairs, used, want = scored(3), set(), []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if not used & {a, b}:
            used |= {a, b}
            want.append((a, b, s))
    got = graph.greedy_disjoint(spark.createDataFrame(pairs, "a long, b long, score double")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_disjoint_wave_equals_the_walk(spark):
    rng, want, taken = random.Random(4), [], set()
    rows = [(k, k, [rng.randrange(100, 160) for _ in range(rng.randint(0, 6))]) for k in range(40)]
    for parent, _, members in rows:
        if not taken & {parent, *members}:
            taken |= {parent, *members}
            want.append(parent)
    got = graph.disjoint_wave(spark.createDataFrame(rows, "parent long, place long, members array<long>")).collect()
    assert sorted(r.parent for r in got) == want


def test_spanning_forest_weighs_most(spark):
    pairs = scored(5)
    root, total = {}, 0.0
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        trial = find_roots([*root, (a, b)])
        if find_roots(list(root)).get(a, a) != find_roots(list(root)).get(b, b):
            root[(a, b)] = s
            total += s
        assert trial
    got = graph.spanning_forest(spark.createDataFrame(pairs, "a long, b long, weight double")).agg(F.sum("weight"), F.count("*")).first()
    assert tuple(got) == (total, len(root))


def test_seeds_never_meet(spark):
    edges = [(1, 2, True, 0.9), (2, 3, False, 0.8), (3, 4, False, 0.7), (5, 6, True, 0.5)]
    got = graph.seeded_union(spark.createDataFrame(edges, "a long, b long, exact boolean, confidence double"), spark.createDataFrame([(1, "x"), (4, "y")], "node long, seed string"))
    assert {r.node: r.cluster for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_complete_linkage_splits_chains(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("x", "y", 0.2)], "a string, b string, sim double")
    assert {r.node: r.cluster for r in graph.complete_linkage(edges, 0.5).collect()} == {"a": "a", "b": "a", "c": "c", "x": "x", "y": "y"}


def test_spans_and_ladder(spark):
    rows = spark.createDataFrame([("alpha beta\ngamma beta", "beta gamma"), ("king and king", "king"), ("x", None), (None, "x")], "t string, n string")
    got = [[(s.start, s.end) for s in r[0]] for r in rows.select(labels.spans_ignoring_space("t", "n")).collect()]
    assert got == [[(6, 16)], [(0, 4), (9, 13)], [], []]
    modes = [r.m.mode for r in rows.select(labels.match_ladder("t", "n").alias("m")).collect()]
    assert modes == ["normalized", None, None, None]


def test_utf16_offsets(spark):
    row = spark.sql("SELECT 'က😀ခ' AS t").select(T.utf16_offset(F.col("t"), F.lit(1)).alias("a"), T.utf16_offset(F.col("t"), F.lit(2)).alias("b")).first()
    assert tuple(row) == (1, 3)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.search_key(F.lit("  The_Big-  Cat "))) == "the big cat"
    assert one(T.tag_key(F.lit("Co-op/Town's"))) == "co op towns"
    assert one(T.loose_number(F.lit("၁O2"))) == 102 and one(T.loose_number(F.lit("1a"))) is None
    assert one(T.without_marks(F.lit("Ávó"))) == "Avo" and one(T.nfkc(F.lit("ﬁ²"))) == "fi2"
    assert one(T.repaired_mojibake(F.lit("Ã©"))) == "é" and one(T.repaired_mojibake(F.lit("ကa"))) == "ကa"
    assert one(T.indel_ratio(F.lit("abcd"), F.lit("abed"))) == 75.0
    assert one(T.token_sort_ratio(F.lit("b a"), F.lit("a b"))) == 100.0 and one(T.token_set_ratio(F.lit("a b"), F.lit("a b c"))) == 100.0
    assert one(T.script(F.lit("xက"))) == "my" and one(T.naive_singular(F.lit("cities"))) == "city"


def test_vetoes_types_and_reasons(spark):
    t = lambda s: F.split(F.lit(s), " ")
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    cases = {
        ("nga htun tha", "nga tha htun"): "personal_name_token_order_conflict", ("year 12", "year 13"): "conflicting_numeric_values", ("first army", "second army"): "conflicting_number_or_ordinal_words",
        ("north gate", "south gate"): "opposed_direction_side_or_relation", ("northeast gate", "western gate"): "opposed_direction_side_or_relation", ("son of x", "daughter of x"): "conflicting_kinship_roles",
        ("ava regiment", "ava"): "individual_or_entity_vs_explicit_group_or_unit", ("battle of y", "siege of y"): "entity_vs_event_or_action", ("battle of y", "death of y"): None, ("city of z", "king of z"): "place_vs_person_or_office", ("a b", "a c"): None,
    }
    for (a, b), want in cases.items():
        assert one(labels.contradiction(t(a), t(b))) == want
    assert one(labels.types_of(t("the king of ava"))) == ["person"] and one(labels.types_of(t("xyz"))) == ["other"] and one(labels.types_of(t("two court horses"))) == ["object", "institution", "quantity"]
    reasons = {
        ("ava town", "ava city"): "named_city_town_wording_variant", ("royal town", "royal city"): None, ("the ava", "ava"): "same_tokens_after_removing_of_the", ("b a", "a b"): None, ("b and a", "a and b"): "same_normalized_tokens_in_different_order",
        ("avatown", "ava town"): "exact_after_word_boundary_normalization", ("min hla myoza", "minhla myosa"): "exact_after_curated_transliteration_normalization", ("ava campaign", "ava expedition"): "named_campaign_expedition_wording_variant", ("a", "b"): None,
        ("palace thadoe", "thado palace"): "same_tokens_after_curated_transliteration_normalization", ("nga palace x", "nga x palace"): None,
    }
    for (a, b), want in reasons.items():
        assert one(labels.merge_reason(t(a), t(b))) == want


def test_intervals(spark):
    rows = spark.createDataFrame([("p", 2, 5), ("p", 5, 8), ("p", 10, 12), ("q", None, None)], "k string, start int, end int").withColumn("len", F.lit(15))
    assert sorted(map(tuple, aggregates.merged_intervals(rows.where("start is not null").drop("len"), ["k"]).collect())) == [("p", 2, 8), ("p", 10, 12)]
    assert sorted(map(tuple, aggregates.uncovered(rows, ["k"], "len").collect())) == [("p", 0, 2), ("p", 8, 10), ("p", 12, 15), ("q", 0, 15)]


def test_gap_fill_before_and_after(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 10), (1, 3, None), (2, 1, None)], "k int, o int, v int")
    assert sorted((r.k, r.o, r.filled) for r in joins.fill_gaps(rows, "k", "o", "v").collect() if r.k == 1) == [(1, 1, 9), (1, 2, 10), (1, 3, 11)]


def test_word_budget_resets(spark):
    rows = spark.createDataFrame([("v", k, w) for k, w in enumerate([5, 5, 5, 12, 1, 1])], "key string, place int, words int")
    assert [r.block for r in labels.word_budget(rows, "key", "place", "words", 10).orderBy("place").collect()] == [0, 0, 1, 2, 3, 3]
