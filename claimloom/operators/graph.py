"""Graph operators over edge DataFrames and workflow loops over their results."""

from __future__ import annotations

import pickle
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.model import oracle, table, view
from claimloom.operators.components import connected_components
from claimloom.operators.joins import cosine_neighbours
from claimloom.plans.lineage import cut, forget, settled
from claimloom.registry import query


def weighted_graph(edges: DataFrame, src: str = "subject", dst: str = "object") -> DataFrame:
    """Undirected ``a < b`` edges without loops; parallel relations add up 1 + log2(n + 1) each."""
    each = edges.where(F.col(src) != F.col(dst)).groupBy(src, "relation", dst).agg(F.count("*").alias("n"))
    return each.groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).agg(F.sum(1 + F.log2(F.col("n") + 1)).alias("weight"))


def similarity_graph(neighbours: DataFrame, floor: float, exact: DataFrame | None = None) -> DataFrame:
    """Undirected edges of ``neighbours(a, b, sim)`` at or over ``floor``, weighing (sim - floor) / (1 - floor), 1e-6 at least, the larger direction.

    Items of ``exact(item, key)`` with one key are tied to the smallest of them by edges of
    weight 1: a star, so a key of many items makes no more edges than items.
    """
    kept = neighbours.where(F.col("sim") >= floor).select("a", "b", F.greatest(F.lit(1e-6), (F.col("sim") - floor) / (1 - floor)).alias("w"))
    if exact is not None:
        known = exact.where("key is not null and item is not null")
        stars = known.join(known.groupBy("key").agg(F.min("item").alias("a")), "key").where("a <> item")
        kept = kept.union(stars.select("a", "item", F.lit(1.0)))
    return kept.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("weight"))


def component_sizes(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``component, size, place``: largest first, then smallest member."""
    sizes = connected_components(edges, src, dst).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), "component")


def degrees(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    both = edges.select(F.col(src).alias("node"), F.col(dst).alias("other")).union(edges.select(dst, src))
    return both.where("node <> other").groupBy("node").agg(F.count_distinct("other").alias("degree"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their places from 1 in a total ``order``, by a range sort: no task holds more than its range."""
    ordered = settled(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_low")).collect()  # a row a partition
    before, offsets = 0, []
    for r in sorted(counts, key=lambda r: r._p):
        offsets.append((r._p, before - r._low))
        before += r._n
    if not offsets:
        return rows.withColumn(name, F.lit(0).cast("long"))
    shift = rows.sparkSession.createDataFrame(offsets, "_p int, _s long")
    return ordered.join(F.broadcast(shift), "_p").withColumn(name, F.col("_m") + F.col("_s") + 1).drop("_p", "_m", "_s")


#: Modularity that a round of moves must gain to count, and rounds in a row without it that end the moves.
LEAST_GAIN, PATIENCE = 1e-3, 3
#: Edges up to this many are moved over in one task; the rounds are the same either way.
ONE_TASK = 500_000


def _moved(both: DataFrame, resolution: float) -> DataFrame:
    """``node, label`` after local moves over ``both(a, b, w)``, a symmetric matrix with loops.

    In each round a hashed half of the nodes goes, all at once, to the neighbouring community
    with the largest gain; a round counts only if it raises the modularity by ``LEAST_GAIN``,
    and ``PATIENCE`` in a row that do not end the moves.
    """
    if both.count() <= ONE_TASK:
        kind = both.schema["a"].dataType.simpleString()
        rows = both.select("a", "b", "w", F.xxhash64("a").alias("h"))
        return settled(rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda f: _moved_here(f, resolution), f"node {kind}, label {kind}"))
    degree = settled(both.groupBy("a").agg(F.sum("w").alias("k")))
    whole = degree.agg(F.sum("k")).first()[0] or 1.0
    labels = settled(degree.select(F.col("a").alias("node"), F.col("a").alias("label")))

    def quality(found: DataFrame) -> float:
        met = both.join(found.toDF("a", "la"), "a").join(found.toDF("b", "lb"), "b")
        parts = met.groupBy("la").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inside"))
        return parts.agg(F.sum(F.col("inside") / whole - resolution * (F.col("k") / whole) ** 2)).first()[0] or 0.0

    best, failed = quality(labels), 0
    for turn in count():
        own = labels.join(degree.toDF("node", "k"), "node")
        sizes = own.groupBy("label").agg(F.sum("k").alias("size"))
        links = both.where("a <> b").join(labels.toDF("b", "label"), "b").select(F.col("a").alias("node"), "label", "w").union(own.select("node", "label", F.lit(0.0)))
        seen = links.groupBy("node", "label").agg(F.sum("w").alias("w")).join(sizes, "label").join(own.select("node", "k", F.col("label").alias("own")), "node")
        at_home = F.col("label") == F.col("own")
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("size") - F.when(at_home, F.col("k")).otherwise(0.0)) / whole, 6)
        goal = seen.groupBy("node", "own").agg(F.min_by("label", F.struct(-gain, ~at_home, F.col("label"))).alias("goal"))
        turns = F.shiftright(F.xxhash64("node"), turn % 60).bitwiseAND(1) == 1
        fresh = settled(goal.select("node", F.when(turns, F.col("goal")).otherwise(F.col("own")).alias("label")))
        reached = quality(fresh)
        if reached > best + LEAST_GAIN:
            forget(labels)
            labels, best, failed = fresh, reached, 0
            continue
        forget(fresh)
        if (failed := failed + 1) == PATIENCE:
            forget(degree)
            return labels


def _moved_here(rows: pd.DataFrame, resolution: float) -> pd.DataFrame:
    """The rounds of ``_moved`` over ``a, b, w`` and the hash ``h`` of ``a``, in arrays; nodes are numbered in order."""
    names, a, b, w, hashes = _coded(rows)
    n, labels, failed = len(names), np.arange(len(names)), 0
    degree = np.bincount(a, w, n)
    whole = degree.sum() or 1.0
    best = _quality(a, b, w, labels, whole, resolution)
    for turn in count():
        fresh = _turned(a, b, w, hashes, labels, whole, resolution, turn)
        reached = _quality(a, b, w, fresh, whole, resolution)
        if reached > best + LEAST_GAIN:
            labels, best, failed = fresh, reached, 0
        elif (failed := failed + 1) == PATIENCE:
            return pd.DataFrame({"node": names, "label": names[labels]})


def _coded(rows: pd.DataFrame) -> tuple:
    """Node names in order, the ends ``a`` and ``b`` as places among them, ``w`` and each node's hash."""
    names, a = np.unique(rows["a"].to_numpy(), return_inverse=True)
    hashes = np.zeros(len(names), np.int64)
    hashes[a] = rows["h"].to_numpy()
    return names, a, np.searchsorted(names, rows["b"].to_numpy()), rows["w"].to_numpy(), hashes


def _quality(a, b, w, labels, whole: float, resolution: float) -> float:
    degree = np.bincount(a, w, len(labels))
    return float((w[labels[a] == labels[b]].sum() / whole) - resolution * ((np.bincount(labels, degree, len(labels)) / whole) ** 2).sum())


def _turned(a, b, w, hashes, labels, whole: float, resolution: float, turn: int) -> np.ndarray:
    """Labels after one round of moves."""
    n, apart = len(labels), a != b
    degree = np.bincount(a, w, n)
    size = np.bincount(labels, degree, n)
    node, label = np.concatenate([a[apart], np.arange(n)]), np.concatenate([labels[b[apart]], labels])
    key, back = np.unique(node * n + label, return_inverse=True)
    weight = np.bincount(back, np.concatenate([w[apart], np.zeros(n)]))
    node, label = key // n, key % n
    home = label == labels[node]
    gain = np.round(weight - resolution * degree[node] * (size[label] - np.where(home, degree[node], 0.0)) / whole, 6)
    order = np.lexsort((label, ~home, -gain, node))
    first = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])]
    return np.where((hashes >> (turn % 60)) & 1 == 1, label[first], labels)


#: Edges that a group of whole components holds, about, and rounds that groups go ahead before their sum is looked at.
PACKED, AHEAD_OF_SUM = 100_000, 4


def _packed(both: DataFrame) -> DataFrame | None:
    """``g, state``: ``both(a, b, w)`` in groups of whole components, as arrays; None if one component has over ``ONE_TASK`` edges."""
    component = settled(connected_components(both, "a", "b"))
    of = both.join(component.toDF("a", "component"), "a")
    sizes = of.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if sizes[0] > ONE_TASK:
        forget(component)
        return None
    groups = -(-sizes[1] // PACKED)

    def pack(key, rows):
        names, a, b, w, hashes = _coded(rows)
        return pd.DataFrame({"g": [key[0]], "state": [pickle.dumps((names, np.arange(len(names)), a, b, w, hashes, np.arange(len(names)), []))]})

    rows = of.select("a", "b", "w", F.xxhash64("a").alias("h"), F.pmod(F.xxhash64("component"), F.lit(groups)).cast("int").alias("g"))
    return settled(rows.groupBy("g").applyInPandas(pack, "g int, state binary"), component)


def _went(state: bytes, taken: int, closes: bool, turns: list[int], whole: float, resolution: float) -> tuple[list[float], bool, bytes]:
    """A group's modularity before and after each of ``turns``, whether its last level joined any nodes, and its state.

    ``taken`` says how many of the tries that the state holds count; if the level ``closes``, communities become nodes first.
    """
    names, place, a, b, w, hashes, labels, tries = pickle.loads(state)
    labels, moved = tries[taken - 1] if taken else labels, False
    if closes:
        moved = bool((labels != np.arange(len(labels))).any())
        left, fresh = np.unique(labels, return_inverse=True)
        key, back = np.unique(fresh[a] * len(left) + fresh[b], return_inverse=True)
        place, hashes, w = fresh[place], hashes[left], np.bincount(back, w)
        a, b, labels = key // len(left), key % len(left), np.arange(len(left))
    tries, reached = [], [_quality(a, b, w, labels, whole, resolution)]
    for turn in turns:
        tries.append(_turned(a, b, w, hashes, tries[-1] if tries else labels, whole, resolution, turn))
        reached.append(_quality(a, b, w, tries[-1], whole, resolution))
    return reached, moved, pickle.dumps((names, place, a, b, w, hashes, labels, tries))


def _communities_of_groups(groups: DataFrame, kind: str, whole: float, resolution: float) -> DataFrame:
    """``communities`` over ``groups(g, state)``: tasks move and join nodes within their groups, the sum over all groups says which rounds count."""

    def job(taken: int, closes: bool, turns: list[int]) -> DataFrame:
        def run(frames):
            for f in frames:
                for g, state in zip(f["g"], f["state"], strict=True):
                    reached, moved, after = _went(state, taken, closes, turns, whole, resolution)
                    yield pd.DataFrame({"g": [g], "reached": [reached], "moved": [moved], "state": [after]})

        return settled(groups.select("g", "state").mapInPandas(run, "g int, reached array<double>, moved boolean, state binary"), groups)

    closes, taken = False, 0
    while True:
        best, failed, turn = None, 0, 0
        while failed < PATIENCE:
            turns = list(range(turn, turn + (1 if failed else AHEAD_OF_SUM)))
            groups, opens = job(taken, closes, turns), closes
            sums = groups.agg(F.max("moved"), *(F.sum(F.col("reached")[k]) for k in range(len(turns) + 1))).first()
            if opens and not sums[0]:
                break
            best, closes, taken = sums[1] if best is None else best, False, 0
            for k, reached in enumerate(sums[2:], 1):
                turn += 1
                if reached > best + LEAST_GAIN:
                    best, failed, taken = reached, 0, k
                else:
                    failed += 1
                    break
        else:
            closes = True
            continue
        break

    def named(frames):
        for f in frames:
            for state in f["state"]:
                names, place = pickle.loads(state)[:2]
                _, first, back = np.unique(place, return_index=True, return_inverse=True)
                yield pd.DataFrame({"node": names, "label": names[first[back]]})

    return groups.mapInPandas(named, f"node {kind}, label {kind}")


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Louvain communities of ``edges(a, b, weight)`` as ``node, label``, the label being the smallest member.

    Local moves, then communities become nodes, level after level until nothing joins; hashes
    take the place of a random order, so reruns agree. Moves stay within a component: where
    none has over ``ONE_TASK`` edges, tasks keep whole components as arrays and only sums meet.
    Otherwise state is tables throughout.
    """
    both = settled(edges.select("a", "b", F.col("weight").cast("double").alias("w")).union(edges.select("b", "a", F.col("weight").cast("double"))).groupBy("a", "b").agg(F.sum("w").alias("w")))
    if both.count() > ONE_TASK and (groups := _packed(both)) is not None:
        whole = both.agg(F.sum("w")).first()[0] or 1.0
        forget(both)
        return _communities_of_groups(groups, both.schema["a"].dataType.simpleString(), whole, resolution)
    found = settled(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    while True:
        labels = _moved(both, resolution)
        if labels.where("node <> label").isEmpty():
            break
        found = settled(found.join(labels.toDF("label", "next"), "label").select("node", F.col("next").alias("label")), found)
        both = settled(both.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").groupBy("la", "lb").agg(F.sum("w").alias("w")).toDF("a", "b", "w"), both, labels)
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    return found.join(least, "label").select("node", F.col("least").alias("label"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: Σ over communities of inside / m - resolution (degree / 2m)²."""
    a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    met = edges.join(a, "a").join(b, "b")
    inside = met.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("weight").alias("inside"))
    degree = met.select(F.col("la").alias("label"), "weight").union(met.select("lb", "weight")).groupBy("label").agg(F.sum("weight").alias("degree"))
    m = edges.agg(F.sum("weight").alias("m"))
    rows = degree.join(inside, "label", "left").join(F.broadcast(m))
    return rows.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - resolution * (F.col("degree") / (2 * F.col("m"))) ** 2).alias("modularity"))


def adjusted_rand(one: DataFrame, two: DataFrame) -> DataFrame:
    """Adjusted Rand index of two ``(node, label)`` partitions from their contingency counts."""
    pairs = lambda c: c * (c - 1) / 2
    cells = cut(one.toDF("node", "x").join(two.toDF("node", "y"), "node").groupBy("x", "y").agg(F.count("*").alias("n")))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), pairs(F.sum("n")).alias("all"))
    rows = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("rows"))
    columns = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("columns"))
    chance = F.col("rows") * F.col("columns") / F.col("all")
    return both.join(rows).join(columns).select(((F.col("both") - chance) / ((F.col("rows") + F.col("columns")) / 2 - chance)).alias("adjusted_rand"))


def forest_keys(edges: DataFrame) -> DataFrame:
    """The ``key`` of each edge of the forest that a walk over ``edges(a, b, key)`` in the order of their unique keys grows, by Borůvka rounds.

    Each round at least halves the trees that have an edge between them, until none has; trees
    become nodes, and edges within one go.
    """
    open_, forest = settled(edges.select("a", "b", "key").where("a <> b")), None
    while True:
        ends = open_.select(F.col("a").alias("tree"), "a", "b", "key").union(open_.select("b", "a", "b", "key"))
        best = settled(ends.groupBy("tree").agg(F.min(F.struct("key", "a", "b")).alias("e")).select("e.*").distinct())
        if best.isEmpty():
            break
        forest = best.select("key") if forest is None else forest.union(best.select("key"))
        trees = connected_components(best, "a", "b")
        met = open_.join(trees.toDF("a", "ta"), "a").join(trees.toDF("b", "tb"), "b").where("ta <> tb")
        open_ = settled(met.select(F.col("ta").alias("a"), F.col("tb").alias("b"), "key"), open_)
    return forest if forest is not None else edges.select("key").limit(0)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Maximum spanning forest of ``edges(a, b, weight)``; ties by the smaller ends, so the forest is unique."""
    key = F.struct((-F.col("weight")).alias("w"), F.col("a").alias("a"), F.col("b").alias("b"))
    return forest_keys(edges.select("a", "b", key.alias("key")).distinct()).select("key.a", "key.b", (F.lit(0) - F.col("key.w")).alias("weight"))


def bfs_depths(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """``node, depth, parent`` from ``roots(node)`` over undirected edges; parents are the smallest of the level before.

    Goes on until no node is reached any more, or to depth ``most`` where one is asked for.
    """
    both = settled(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct())
    level = settled(roots.select("node", F.lit(0).alias("depth"), F.lit(None).cast(roots.schema["node"].dataType).alias("parent")))
    levels, last = [level], level.select("node")
    for depth in count(1):
        if most is not None and depth > most:
            break
        # neighbours of a level lie in it or beside it
        reached = both.join(level.select(F.col("node").alias("x")), "x").groupBy(F.col("y").alias("node")).agg(F.min("x").alias("parent"))
        fresh = settled(reached.join(last, "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        level, last = fresh, level.select("node").union(fresh.select("node"))
    return reduce(DataFrame.union, levels)


#: What a forest shows at once: so many of the best nodes, then these shares of all (fixed values).
DISCLOSED, SHARES = 20, (0.01, 0.1)


def ranked_forest(edges: DataFrame, frequency: DataFrame) -> DataFrame:
    """``node, component, root, parent, depth, subtree, rank, level`` for each node of ``edges(a, b)`` and ``frequency(node, frequency)``.

    Nodes rank by degree, frequency (0 where none is known) and id. A component's root is its
    best node. The forest is breadth first, neighbours in the order of their rank: a node's
    parent is the one visited first. ``subtree`` counts a node and all below it. ``level``
    says when it is shown: 0 for the ``DISCLOSED`` best nodes and their ancestors, then 1 and 2
    for those of ``SHARES`` of all nodes, 3 for the rest.

    Levels are joins of the frontier, all components side by side; the order of visits is a
    sorted numbering, not a window over a component. Sizes add up from the deepest level, and
    a node is shown no later than any node below it.
    """
    plain = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = settled(plain.select(F.col("a").alias("x"), F.col("b").alias("y")).union(plain.select("b", "a")))
    plain = both.where("x < y").toDF("a", "b")
    degree = both.groupBy(F.col("x").alias("node")).agg(F.count("*").alias("degree"))
    single = edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node is not null").union(frequency.select("node")).distinct()
    rows = single.join(degree, "node", "left").join(frequency.groupBy("node").agg(F.max("frequency").alias("frequency")), "node", "left").na.fill(0, ["degree", "frequency"])
    ranked = numbered(rows, [F.desc("degree"), F.desc("frequency"), F.col("node")], "rank").select("node", "rank")
    component = connected_components(plain, "a", "b")
    at_home = settled(ranked.join(component, "node", "left").withColumn("component", F.coalesce("component", "node")))
    roots = at_home.groupBy("component").agg(F.min_by("node", "rank").alias("root"))
    known = settled(at_home.join(roots, "component"), at_home)
    n = known.count()
    bounds = [min(DISCLOSED, n), *(-int(-n * share // 1) for share in SHARES)]
    own = F.coalesce(*(F.when(F.col("rank") <= most, k) for k, most in enumerate(bounds)), F.lit(len(bounds)))
    ordered = lambda frame, *order: settled(frame.orderBy(*order).withColumn("place", F.monotonically_increasing_id()).select("node", "parent", "place", "rank"))
    level = ordered(known.where("node = root").select("node", F.lit(None).cast(known.schema["node"].dataType).alias("parent"), "rank"), "rank")
    levels, last = [level], level.select("node")
    while True:
        met = both.join(level.select(F.col("node").alias("x"), "place"), "x").groupBy(F.col("y").alias("node")).agg(F.min(F.struct("place", "x")).alias("first"))
        fresh = met.join(last, "node", "left_anti").join(known.select("node", "rank"), "node").select("node", F.col("first.x").alias("parent"), F.col("first.place").alias("above"), "rank")
        fresh = ordered(fresh, "above", "rank")
        if fresh.isEmpty():
            break
        levels.append(fresh)
        level, last = fresh, level.select("node").union(fresh.select("node"))
    done, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth].select("node", "parent", F.lit(depth).alias("depth"), own.alias("level"))
        here = here.withColumns({"below": F.lit(0).cast("long"), "soonest": F.lit(len(bounds))}) if below is None else here.join(below, "node", "left")
        here = settled(here.select("node", "parent", "depth", (F.coalesce("below", F.lit(0)) + 1).alias("subtree"), F.least("level", "soonest").alias("level")), levels[depth])
        below = here.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.sum("subtree").alias("below"), F.min("level").alias("soonest"))
        done.append(here)
    return reduce(DataFrame.union, done).join(known, "node").select("node", "component", "root", "parent", "depth", "subtree", "rank", "level")


#: Best pairs for each wanted one that are walked at first, and the most that one task walks.
AHEAD, WALKED = 8, 1 << 18


def _first_disjoint(pairs: DataFrame, most: int) -> DataFrame | None:
    """The first ``most`` pairs that the walk takes, from a prefix of its order that one task holds; None if that is too short."""
    rows, size = pairs.select("a", "b", "score").where("a <> b"), AHEAD * most

    def walk(frames):
        used = set()
        for f in frames:
            kept = []
            for a, b in zip(f["a"], f["b"], strict=True):
                free = len(used) < 2 * most and a not in used and b not in used
                used |= {a, b} if free else set()
                kept.append(free)
            yield f[kept]

    kind = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    while size <= WALKED:
        first = rows.orderBy(F.desc("score"), "a", "b").limit(size)
        taken = settled(first.mapInPandas(walk, kind))
        if taken.count() == most or first.count() < size:
            return taken
        forget(taken)
        size *= 8
    return None


def greedy_disjoint(pairs: DataFrame, most: int | None = None, rounds: int | None = None) -> DataFrame:
    """Pairs ``(a, b, score)`` as a walk in score order takes them, skipping any that touches a taken item.

    Under a total order that walk equals taking, round after round, every pair that is best
    at both its ends; each round is two combining aggregates and no driver-side walk. It goes
    on until no pair is left and raises when ``rounds``, if given, run out before. Where only
    the first ``most`` are wanted, a short prefix of the order is walked instead.
    """
    if most and rounds is None and (first := _first_disjoint(pairs, most)) is not None:
        return first
    key = F.struct(-F.col("score"), F.col("a"), F.col("b"))
    left, taken = settled(pairs.select("a", "b", "score").where("a <> b")), None
    for done in count():
        if left.isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"pairs are left after {rounds} rounds")
        ends = left.select(F.col("a").alias("x"), key.alias("k")).union(left.select("b", key))
        best = ends.groupBy("x").agg(F.min("k").alias("k"))
        now = settled(left.withColumn("k", key).join(best.toDF("a", "ka"), "a").join(best.toDF("b", "kb"), "b").where("k = ka and k = kb").select("a", "b", "score"))
        taken = now if taken is None else settled(taken.union(now), taken) if most else taken.union(now)
        used = now.select(F.col("a").alias("x")).union(now.select("b"))
        was, left = left, left.join(used.toDF("a"), "a", "left_anti").join(used.toDF("b"), "b", "left_anti").select("a", "b", "score")
        if most:  # pairs under the last wanted one so far cannot be among the wanted
            best = taken.orderBy(F.desc("score"), "a", "b").limit(most).agg(F.count("*"), F.min("score")).first()
            left = left.where(F.col("score") >= best[1]) if best[0] == most else left
        left = settled(left, was)
    taken = left if taken is None else taken
    return taken.orderBy(F.desc("score"), "a", "b").limit(most) if most else taken


def disjoint_wave(footprints: DataFrame, rounds: int | None = None) -> DataFrame:
    """Parents ``(parent, place, members)`` that a walk by ``place`` admits while members stay disjoint.

    A parent is decided once no undecided parent with a smaller place shares a member: it is
    admitted if no admitted one does. Each round decides all such parents at once, until none
    is left; raises when ``rounds``, if given, run out before.
    """
    incidence = settled(footprints.select("parent", "place", F.explode(F.array_distinct(F.array_append("members", F.col("parent")))).alias("m")))
    admitted = None
    for done in count():
        if incidence.isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"parents are left after {rounds} rounds")
        first = incidence.groupBy("m").agg(F.min("place").alias("least"))
        ready = settled(incidence.join(first, "m").groupBy("parent", "place").agg(F.max(F.col("place") > F.col("least")).alias("waits")).where("not waits").select("parent", "place"))
        admitted = ready if admitted is None else admitted.union(ready)
        taken = incidence.join(ready.select("parent"), "parent", "left_semi").select("m").distinct()
        gone = incidence.join(taken, "m", "left_semi").select("parent").distinct()
        incidence = settled(incidence.join(gone, "parent", "left_anti"), incidence)
    return admitted if admitted is not None else footprints.select("parent", "place")


#: Two seeds nearer to a node than this in confidence leave it undecided (fixed value).
UNDECIDED = 0.05


def undecided(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Unseeded nodes whose best two seeds, by their edges to seeded nodes, are less than ``UNDECIDED`` apart."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("s"), "confidence").union(edges.select("b", "a", "confidence"))
    options = both.join(seeds.toDF("s", "seed"), "s").join(seeds.select("node"), "node", "left_anti").groupBy("node", "seed").agg(F.max("confidence").alias("c"))
    # a node's own seeds are as many as it has edges to seeded nodes: the two best by two combining aggregates
    best = options.groupBy("node").agg(F.max(F.struct("c", "seed")).alias("one"))
    second = options.join(best, "node").where(F.col("seed") != F.col("one.seed")).groupBy("node").agg((F.max("one.c") - F.max("c")).alias("lead"))
    return second.where(F.col("lead") < UNDECIDED).select("node")


def seeded_union(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node, cluster``: components in which two different seeds never meet, named by their smallest node.

    ``edges(a, b, exact, confidence)`` count in order (exact first, then confidence, then
    ends) and nodes of one seed belong together from the start; an edge that would join two
    seeds is refused, and so is an edge of an ``undecided`` node to a seeded one. That walk
    is a spanning forest: were all seeds one node, an edge between two trees that hold a seed
    would close a circle. So the seeds are taken as one node, the forest grows in rounds
    (``forest_keys``), and its edges with their own ends give the clusters. No component is
    walked in one task. Nodes are those of edges and seeds; a node has one seed.
    """
    # a left join each: hot nodes are the skew join's business
    marked = edges.where("a is not null and b is not null").join(seeds.toDF("a", "sa"), "a", "left").join(seeds.toDF("b", "sb"), "b", "left")
    no = undecided(edges, seeds)
    marked = marked.join(no.select(F.col("node").alias("a"), F.lit(True).alias("ua")), "a", "left").join(no.select(F.col("node").alias("b"), F.lit(True).alias("ub")), "b", "left")
    kept = marked.where("not (ua is not null and sb is not null) and not (ub is not null and sa is not null)")
    one = seeds.agg(F.min("node")).first()[0]
    key = F.struct((~F.col("exact")).alias("late"), (-F.col("confidence")).alias("c"), F.col("a").alias("a"), F.col("b").alias("b"))
    merged = lambda name, seed: F.when(F.col(seed).isNotNull(), F.lit(one)).otherwise(F.col(name)).alias(name) if one is not None else F.col(name)
    grown = forest_keys(kept.select(merged("a", "sa"), merged("b", "sb"), key.alias("key"))).select("key.a", "key.b")
    anchors = seeds.groupBy("seed").agg(F.min("node").alias("anchor"))
    alike = seeds.join(anchors, "seed").select("anchor", "node")
    loops = edges.select("a", "a").union(edges.select("b", "b"))
    return connected_components(grown.union(alike).union(loops), "a", "b").toDF("node", "cluster")


def refused_edges(edges: DataFrame, seeds: DataFrame, clusters: DataFrame) -> DataFrame:
    """``a, b, reason`` for each edge that ``seeded_union`` refused: ``ambiguous_manual_seed`` or ``different_manual_seeds``."""
    no = undecided(edges, seeds).withColumn("u", F.lit(True))
    met = edges.join(clusters.toDF("a", "ca"), "a").join(clusters.toDF("b", "cb"), "b").join(seeds.toDF("a", "sa"), "a", "left").join(seeds.toDF("b", "sb"), "b", "left")
    met = met.join(no.toDF("a", "ua"), "a", "left").join(no.toDF("b", "ub"), "b", "left")
    unclear = (F.col("ua").isNotNull() & F.col("sb").isNotNull()) | (F.col("ub").isNotNull() & F.col("sa").isNotNull())
    return met.where(unclear | (F.col("ca") != F.col("cb"))).select("a", "b", F.when(unclear, "ambiguous_manual_seed").otherwise("different_manual_seeds").alias("reason"))


def complete_linkage(edges: DataFrame, floor: float) -> DataFrame:
    """``node, cluster``: components of ``edges(a, b, sim)`` split so that every pair in a cluster reaches ``floor``; missing pairs count 0.

    The walk that always joins the two clusters whose farthest pair is nearest (ties to the
    smallest members) equals joining, round after round, all clusters that are each other's
    best: what joins elsewhere never brings a cluster nearer. State is a sparse table of
    cluster pairs all of whose pairs reach ``floor``; a joined cluster keeps a neighbour only
    if all its parts had it. No component is held in one task.
    """
    if floor <= 0:
        raise ValueError("floor must be above 0: missing pairs count 0")
    plain = edges.where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("sim").alias("sim"))
    pairs = settled(plain.where(F.col("sim") >= floor))
    found = settled(edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node is not null").distinct().withColumn("cluster", F.col("node")))
    key = F.struct((-F.col("sim")).alias("s"), F.col("x").alias("x"), F.col("y").alias("y"))
    while not pairs.isEmpty():
        best = pairs.select(F.col("x").alias("c"), key.alias("k")).union(pairs.select("y", key)).groupBy("c").agg(F.min("k").alias("k"))
        mutual = best.groupBy("k").agg(F.count("*").alias("n")).where("n = 2")
        moved = settled(mutual.select(F.col("k.y").alias("c"), F.col("k.x").alias("into")))
        parts = moved.select(F.col("into").alias("c"), F.lit(2).alias("parts"))
        found = settled(found.join(moved.toDF("cluster", "into"), "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster")), found)
        named = pairs.join(moved.toDF("x", "nx"), "x", "left").join(moved.toDF("y", "ny"), "y", "left").select(F.coalesce("nx", "x").alias("p"), F.coalesce("ny", "y").alias("q"), "sim").where("p <> q")
        met = named.groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.min("sim").alias("sim"), F.count("*").alias("n"))
        whole = met.join(parts.toDF("x", "px"), "x", "left").join(parts.toDF("y", "py"), "y", "left").where(F.col("n") == F.coalesce("px", F.lit(1)) * F.coalesce("py", F.lit(1)))
        pairs = settled(whole.select("x", "y", "sim"), pairs, moved)
    return found


def balanced_chunks(edges: DataFrame, size: int = 180) -> DataFrame:
    """``node, chunk``: nodes by (depth from their component's hub, degree, id) in runs of ``size`` within a component."""
    comp, degree = connected_components(edges, "a", "b"), degrees(edges)
    rows = settled(comp.join(degree, "node", "left").select("node", "component", F.coalesce("degree", F.lit(0)).alias("degree")))
    hubs = rows.groupBy("component").agg(F.min_by("node", F.struct(-F.col("degree"), "node")).alias("node")).select("node")
    ranked = rows.join(bfs_depths(edges, hubs).select("node", "depth"), "node")
    place = F.row_number().over(Window.partitionBy("component").orderBy("depth", F.desc("degree"), "node")) - 1
    return ranked.select("node", "component", F.floor(place / size).alias("chunk"))


EDGES = "SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b FROM claims WHERE subject <> object"


def _edges(spark, d):
    """The edges that ``EDGES`` states."""
    return view(spark, d, "claims").where("subject <> object").select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct()


_CLOSURE = ", e AS (" + EDGES + "), both_ AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), reach AS (WITH RECURSIVE r(x, y) AS (SELECT x, x FROM both_ UNION SELECT r.x, k.y FROM r JOIN both_ k ON r.y = k.x) SELECT * FROM r), comp AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY x)"


@query("g01_weighted_graph", oracle("SELECT a, b, round(sum(1 + log2(n + 1)), 6) AS weight FROM (SELECT least(subject, object) AS a, greatest(subject, object) AS b, subject, relation, object, count(*) AS n FROM claims WHERE subject <> object GROUP BY ALL) x GROUP BY a, b", "claims"))
def g01(spark, d):
    return weighted_graph(view(spark, d, "claims")).select("a", "b", F.round("weight", 6).alias("weight"))


@query("g02_similarity_graph", "SELECT a, b, round(max(greatest(1e-6, (sim - 0.3) / 0.7)), 5) AS weight FROM (SELECT least(x.vec_id, y.vec_id) AS a, greatest(x.vec_id, y.vec_id) AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS sim, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, y.vec_id) AS k FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id) z WHERE k <= 15 AND sim >= 0.3 GROUP BY a, b")
def g02(spark, d):
    return similarity_graph(cosine_neighbours(table(spark, d, "embeddings"), "vec_id", 15).select("a", "b", "sim"), 0.3).select("a", "b", F.round("weight", 5).alias("weight"))


_ALIKE = """WITH n AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS sim,
      row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, y.vec_id) AS k FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id AND x.vec_id % 50 = 0),
    p AS (SELECT p_partkey AS item, substr(p_name, 1, 12) AS key FROM part), m AS (SELECT key, min(item) AS least_item FROM p GROUP BY key),
    e AS (SELECT a, b, greatest(1e-6, (sim - 0.3) / 0.7) AS w FROM n WHERE k <= 15 AND sim >= 0.3 UNION ALL SELECT least_item, item, 1.0 FROM p JOIN m USING (key) WHERE item <> least_item)
    SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(w), 5) AS weight FROM e GROUP BY 1, 2"""


@query("g02_exact_and_similar", _ALIKE)
def g02b(spark, d):
    """Vectors whose id is divisible by 50 ask; parts of those numbers whose names begin alike are tied, too."""
    near = cosine_neighbours(table(spark, d, "embeddings"), "vec_id", 15, every=50).select("a", "b", "sim")
    names = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("item"), F.substring("p_name", 1, 12).alias("key"))
    return similarity_graph(near, 0.3, names).select("a", "b", F.round("weight", 5).alias("weight"))


@query("g03_components", oracle(_CLOSURE + " SELECT component, count(*) AS size FROM comp GROUP BY component", "claims"))
def g03(spark, d):
    return component_sizes(_edges(spark, d))


@query("g04_seeded_union")
def g04(spark, d):
    edges = _edges(spark, d).withColumns({"exact": F.length("a") == F.length("b"), "confidence": F.pmod(F.crc32(F.concat("a", "b")), F.lit(1000)) / 1000})
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return seeded_union(edges, nodes.where("node in ('n0', 'n1', 'n7')").select("node", F.col("node").alias("seed")))


@query("g05_communities")
def g05(spark, d):
    return communities(weighted_graph(view(spark, d, "claims")), 1.2)


@query("g06_modularity", oracle(", e AS (" + EDGES + "), l AS (SELECT tag AS node, substr(tag, 2, 1) AS label FROM tags), x AS (SELECT p.label AS la, q.label AS lb FROM e JOIN l p ON p.node = e.a JOIN l q ON q.node = e.b), m AS (SELECT count(*) AS m FROM x), g AS (SELECT label, sum(n) AS degree, sum(i) AS inside FROM (SELECT la AS label, 1 AS n, CASE WHEN la = lb THEN 1 ELSE 0 END AS i FROM x UNION ALL SELECT lb, 1, 0 FROM x) z GROUP BY label) SELECT round(sum(inside / m - (degree / (2.0 * m)) * (degree / (2.0 * m))), 6) AS modularity FROM g, m", "claims", "tags"))
def g06(spark, d):
    labels = view(spark, d, "tags").select(F.col("tag").alias("node"), F.substring("tag", 2, 1).alias("label"))
    return modularity(_edges(spark, d).withColumn("weight", F.lit(1.0)), labels).select(F.round("modularity", 6).alias("modularity"))


@query("g06_adjusted_rand", oracle(", n AS (SELECT s_cat AS x, o_cat AS y, count(*) AS n FROM claims GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS b, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM n GROUP BY x) u) AS r, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM n GROUP BY y) v) AS c, (SELECT sum(n) * (sum(n) - 1) / 2 FROM n) AS t) SELECT round((b - r * c / t) / ((r + c) / 2 - r * c / t), 6) AS adjusted_rand FROM s", "claims"))
def g06b(spark, d):
    c = view(spark, d, "claims")
    return adjusted_rand(c.select("claim_id", "s_cat"), c.select("claim_id", "o_cat")).select(F.round("adjusted_rand", 6).alias("adjusted_rand"))


@query("g07_complete_linkage")
def g07(spark, d):
    return complete_linkage(_edges(spark, d).withColumn("sim", F.pmod(F.crc32(F.concat("a", "b")), F.lit(100)) / 100), 0.5)


_WEIGHED = ", e AS (SELECT a, b, CAST((length(a) * 31 + ascii(substr(a, -1, 1)) * 17 + ascii(substr(b, -1, 1)) * 7 + length(b)) % 100 AS DOUBLE) AS weight FROM (" + EDGES + ") x)"


def _weighed(spark, d):
    last = lambda c: F.ascii(F.substring(c, -1, 1))
    return _edges(spark, d).withColumn("weight", ((F.length("a") * 31 + last("a") * 17 + last("b") * 7 + F.length("b")) % 100).cast("double"))


# an edge is in the maximum forest unless its ends are joined by edges that come before it: at the weight of each edge, walks over earlier ones
_FOREST = _WEIGHED + """, k AS (SELECT a, b, weight, row_number() OVER (ORDER BY weight DESC, a, b) AS place FROM e), both_ AS (SELECT a AS x, b AS y, place FROM k UNION ALL SELECT b, a, place FROM k),
  w AS (WITH RECURSIVE r(place, target, node) AS (SELECT place, b, a FROM k UNION SELECT r.place, r.target, t.y FROM r JOIN both_ t ON r.node = t.x AND t.place < r.place WHERE r.node <> r.target) SELECT * FROM r)
  SELECT a, b, weight FROM k WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.place = k.place AND w.node = k.b)"""


@query("g08_spanning_forest", oracle(_FOREST, "claims"))
def g08(spark, d):
    return spanning_forest(_weighed(spark, d))


@query("g09_chunks")
def g09(spark, d):
    return balanced_chunks(_edges(spark, d), 20)


@query("g10_bfs_depths", oracle(", e AS (" + EDGES + "), k AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (WITH RECURSIVE w(node, depth) USING KEY (node) AS (SELECT 'n0', 0 UNION SELECT y, depth FROM (SELECT k.y, min(w.depth + 1) AS depth FROM w JOIN k ON w.node = k.x GROUP BY k.y) s WHERE NOT EXISTS (SELECT 1 FROM recurring.w o WHERE o.node = s.y AND o.depth <= s.depth)) SELECT * FROM w) SELECT node, depth FROM r", "claims"))
def g10(spark, d):
    return bfs_depths(_edges(spark, d), spark.createDataFrame([("n0",)], "node string")).select("node", "depth")


@query("g10_ranked_forest")
def g10b(spark, d):
    return ranked_forest(_edges(spark, d), view(spark, d, "tags").select(F.col("tag").alias("node"), "frequency"))


@query("g11_degrees", oracle(", e AS (" + EDGES + ") SELECT node, count(DISTINCT other) AS degree FROM (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e) x GROUP BY node", "claims"))
def g11(spark, d):
    return degrees(_edges(spark, d))


@query("w07_greedy_disjoint")
def w07(spark, d):
    pairs = view(spark, d, "claims").where("subject <> object").select(F.col("subject").alias("a"), F.col("object").alias("b"), "score")
    return greedy_disjoint(pairs.groupBy("a", "b").agg(F.max("score").alias("score")), 100)


@query("w08_disjoint_wave")
def w08(spark, d):
    c = view(spark, d, "claims").groupBy(F.col("subject").alias("parent")).agg(F.count("*").alias("n"), F.collect_set("object").alias("members"))
    return disjoint_wave(numbered(c, [F.desc("n"), F.col("parent")], "place").select("parent", "place", "members"))
