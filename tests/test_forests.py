"""Forests, seeded unions and complete linkage in rounds against plain walks."""

import random

import pytest

from claimloom import registry
from claimloom.operators import graph

registry.load()


def random_edges(rng, n, m):
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def finder(root):
    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    return find


def plain_union(edges, seeds):
    """The ordered walk, with undecided nodes refused first."""
    options = {}
    for a, b, _, c in edges:
        for x, y in ((a, b), (b, a)):
            if x not in seeds and y in seeds:
                of = options.setdefault(x, {})
                of[seeds[y]] = max(of.get(seeds[y], 0.0), c)
    unsure = {x for x, of in options.items() if len(of) > 1 and sorted(of.values())[-1] - sorted(of.values())[-2] < 0.05}
    root = {x: x for a, b, _, _ in edges for x in (a, b)} | {x: x for x in seeds}
    find, seed = finder(root), dict(seeds)
    for s in set(seeds.values()):
        members = sorted(x for x in seeds if seeds[x] == s)
        for x in members[1:]:
            root[find(x)] = members[0]
    reasons = {}
    for a, b, _, _ in sorted(edges, key=lambda e: (not e[2], -e[3], e[0], e[1])):
        if (a in unsure and b in seeds) or (b in unsure and a in seeds):
            reasons[a, b] = "ambiguous_manual_seed"
            continue
        p, q = find(a), find(b)
        if p == q:
            continue
        if p in seed and q in seed and seed[p] != seed[q]:
            reasons[a, b] = "different_manual_seeds"
            continue
        root[q] = p
        if q in seed:
            seed[p] = seed[q]
    least = {}
    for x in sorted(root):
        least.setdefault(find(x), x)
    return {x: least[find(x)] for x in root}, reasons


@pytest.mark.parametrize("seed", range(4))
def test_seeded_union_is_the_ordered_walk(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, rng.random() < 0.3, rng.randrange(20) / 20) for a, b in random_edges(rng, 40, 70)]
    seeds = {x: rng.choice("pqr") for x in rng.sample(range(44), 9)}
    frame, marks = spark.createDataFrame(edges, "a long, b long, exact boolean, confidence double"), spark.createDataFrame(sorted(seeds.items()), "node long, seed string")
    want, reasons = plain_union(edges, seeds)
    clusters = graph.seeded_union(frame, marks)
    assert {r.node: r.cluster for r in clusters.collect()} == want
    assert {(r.a, r.b): r.reason for r in graph.refused_edges(frame, marks, clusters).collect()} == reasons


def test_seeded_union_without_seeds_or_edges(spark):
    shape, kind = "a long, b long, exact boolean, confidence double", "node long, seed string"
    frame = spark.createDataFrame([(1, 2, True, 0.5), (3, 3, True, 0.5)], shape)
    assert {r.node: r.cluster for r in graph.seeded_union(frame, spark.createDataFrame([], kind)).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.node: r.cluster for r in graph.seeded_union(spark.createDataFrame([], shape), spark.createDataFrame([(5, "s"), (6, "s"), (7, "t")], kind)).collect()} == {5: 5, 6: 5, 7: 7}


def plain_linkage(edges, floor):
    sim = {(a, b): s for a, b, s in edges}
    clusters = [[x] for x in sorted({x for a, b, _ in edges for x in (a, b)})]
    link = lambda p, q: min(sim.get((min(x, y), max(x, y)), 0.0) for x in p for y in q)
    while True:
        options = [(-link(p, q), min(p), min(q), p, q) for i, p in enumerate(clusters) for q in clusters[i + 1 :]]
        best = min(options, key=lambda o: (o[0], min(o[1:3]), max(o[1:3])), default=None)
        if best is None or -best[0] < floor:
            return {x: min(c) for c in clusters for x in c}
        clusters.remove(best[3])
        clusters.remove(best[4])
        clusters.append(best[3] + best[4])


@pytest.mark.parametrize("seed, levels", [(0, 10), (1, 3), (2, 100)])
def test_complete_linkage_is_the_greedy_walk(spark, seed, levels):
    rng = random.Random(seed)
    edges = [(a, b, rng.randrange(1, levels + 1) / levels) for a, b in random_edges(rng, 24, 150)]
    got = graph.complete_linkage(spark.createDataFrame(edges, "a long, b long, sim double"), 0.34)
    assert {r.node: r.cluster for r in got.collect()} == plain_linkage(edges, 0.34)


def plain_forest(edges, frequency):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    nodes = {x for e in edges for x in e} | set(frequency)
    order = sorted(nodes, key=lambda x: (-len(near.get(x, ())), -frequency.get(x, 0), x))
    rank = {x: k for k, x in enumerate(order, 1)}
    out, roots = {}, {}
    for root in order:
        if root in out:
            continue
        out[root], queue = [None, 0], [root]
        for x in queue:
            roots[x] = root
            for y in sorted(near.get(x, ()), key=rank.get):
                if y not in out:
                    out[y] = [x, out[x][1] + 1]
                    queue.append(y)
    size, level, n = dict.fromkeys(nodes, 1), {}, len(nodes)
    for x in sorted(nodes, key=lambda x: -out[x][1]):
        if out[x][0] is not None:
            size[out[x][0]] += size[x]
    for k, most in enumerate((min(20, n), -int(-n * 0.01 // 1), -int(-n * 0.1 // 1))):
        for x in order[:most]:
            while x is not None:
                level[x] = min(level.get(x, 9), k)
                x = out[x][0]
    return {x: (roots[x], out[x][0], out[x][1], size[x], rank[x], level.get(x, 3)) for x in nodes}


@pytest.mark.parametrize("seed, n, m", [(0, 60, 70), (1, 150, 90), (2, 30, 120)])
def test_ranked_forest_is_the_plain_one(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [*random_edges(rng, n, m), *((x, x + 1) for x in range(n, n + 15)), (n + 30, n + 30)]
    frequency = {x: rng.randrange(3) for x in range(0, n + 40, 2)}
    frame = spark.createDataFrame(edges + edges[:5], "a long, b long").repartition(3)
    got = graph.ranked_forest(frame, spark.createDataFrame(sorted(frequency.items()), "node long, frequency long")).collect()
    assert {r.node: (r.root, r.parent, r.depth, r.subtree, r["rank"], r.level) for r in got} == plain_forest(edges, frequency)
    assert len({r.component for r in got}) == len({r.root for r in got})


def test_numbering_of_ties_and_nothing(spark):
    rows = spark.createDataFrame([(x % 3, x) for x in range(50)], "a int, b int").repartition(7)
    got = graph.numbered(rows, [rows.a.desc(), rows.b], "n").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(((x % 3, x) for x in range(50)), key=lambda t: (-t[0], t[1])) and sorted(r.n for r in got) == list(range(1, 51))
    assert graph.numbered(rows.limit(0), [rows.a], "n").collect() == []
