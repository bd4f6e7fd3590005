"""Subgraphs, their budgets and their evidence on small graphs."""

import pytest

from claimloom.operators import topology as t

CLAIMS = [(1, 1, 0, "vol1", 1, "a", "r", "b"), (2, 1, 1, "vol1", 1, "a", "r", "b"), (3, 2, 0, "vol1", 2, "b", "q", "c"), (4, 3, 0, "vol1", 3, "c", "r", "d"), (5, 9, 0, "vol2", 1, "e", "r", "e"), (6, 4, 0, "vol1", 4, "d", "r", "f")]


@pytest.fixture(scope="module")
def claims(spark):
    return spark.createDataFrame(CLAIMS, "claim_id long, sid long, ordinal int, volume string, page int, subject string, relation string, object string").selectExpr("*", "'E' as s_cat", "upper(relation) as r_cat", "'E' as o_cat")


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([(x, k) for k, x in enumerate("abcdef")], "tag string, frequency long")


def edges(found):
    return {(r.subject, r.relation, r.object): (r.claims, r.claim_id) for r in found.edges.collect()}


def test_scopes(claims, tags):
    of = lambda scope, **more: t.topology(claims, tags, scope, **more)
    page = of(t.Scope("page", "vol1", 1))
    assert edges(page) == {("a", "r", "b"): (2, 1)} and tuple(page.counts.first()) == (2, 2, False)
    assert {(r.tag, r.frequency, r.degree, r.anchor) for r in page.nodes.collect()} == {("a", 0, 1, False), ("b", 1, 1, False)}
    assert set(edges(of(t.Scope("range", "vol1", 2, 3)))) == {("b", "q", "c"), ("c", "r", "d")}
    assert set(edges(of(t.Scope("relation", values=("q",))))) == {("b", "q", "c")}
    assert set(edges(of(t.Scope("claim", sid=3, ordinal=0)))) == {("c", "r", "d")}
    loop = of(t.Scope("entity", values=("e",)))
    assert edges(loop) == {("e", "r", "e"): (1, 5)} and [tuple(r) for r in loop.nodes.collect()] == [("e", 4, 0, True)]
    none = of(t.Scope("page", "vol3", 7))
    assert edges(none) == {} and none.nodes.collect() == [] and tuple(none.counts.first()) == (0, 0, False)


def test_budgets_and_second_hop(claims, tags):
    few = t.topology(claims, tags, t.Scope(), limit=3)
    assert edges(few) == {("a", "r", "b"): (2, 1), ("b", "q", "c"): (1, 3)} and tuple(few.counts.first()) == (6, 3, True)
    narrow = t.topology(claims, tags, t.Scope("range", "vol1", 1, 4), nodes=3)
    assert {r.tag for r in narrow.nodes.collect()} == {"a", "b", "c"} and tuple(narrow.counts.first()) == (5, 3, True)
    hops = t.topology(claims, tags, t.Scope("entity", values=("a",)), depth=2)
    assert set(edges(hops)) == {("a", "r", "b"), ("b", "q", "c")} and tuple(hops.counts.first()) == (2, 3, False)


@pytest.mark.parametrize("bad", [{"kind": "x"}, {"kind": "page", "volume": "vol9", "start_page": 1}, {"kind": "page", "volume": "vol1"}, {"kind": "range", "volume": "vol1", "start_page": 3, "end_page": 2}, {"kind": "tags"}, {"kind": "tags", "values": tuple(map(str, range(101)))}, {"kind": "claim", "sid": 1}])
def test_refused_scopes(bad):
    with pytest.raises(ValueError):
        t.Scope(**bad)


def test_evidence_pages(spark, claims):
    sentences = spark.createDataFrame([(1, "en", "one"), (2, "en", "two")], "sid long, lang string, text string")
    both = t.evidence(claims, sentences, t.triple("a", "r", "b")).collect()
    assert [(r.total, r.claim_id, r.text) for r in sorted(both, key=lambda r: r.claim_id)] == [(2, 1, "one"), (2, 2, "one")]
    assert [r.claim_id for r in t.evidence(claims, sentences, t.triple("a", "r", "b"), 1, 1).collect()] == [2]
    assert [r.claim_id for r in t.evidence(claims, sentences, t.triple("a", "r", "b", 1, 1)).collect()] == [2]
    lost = t.evidence(claims, sentences, t.bundle("E", "E", ("R",), scope=t.Scope("page", "vol1", 3))).collect()
    assert [(r.claim_id, r.text) for r in lost] == [(4, None)]
    bundles = t.category_topology(claims, t.Scope("range", "vol1", 1, 3), direction="either").collect()
    assert {(r.relation, r.claims, r.sentences, r.pairs) for r in bundles} == {("R", 3, 2, 2), ("Q", 1, 1, 1)}
