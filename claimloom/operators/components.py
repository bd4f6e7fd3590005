"""Connected components over edge DataFrames (no GraphFrames, no driver-side graph)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from claimloom.plans.lineage import settled

#: Edges that a task joins up at a time before the rounds.
AT_ONCE = 1 << 19


def _stars(u: pd.Series, v: pd.Series) -> pd.DataFrame:
    """``u, v``: each node of some edges, but one of each component, with that one: as connected as the edges, and fewer."""
    codes, names = pd.factorize(pd.concat([u, v], ignore_index=True))
    a, b, label = codes[: len(u)], codes[len(u) :], np.arange(len(names))
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    moved = np.flatnonzero(label != np.arange(len(names)))
    names = np.asarray(names)
    return pd.DataFrame({"u": names[moved], "v": names[label[moved]]})


def joined_up(pairs: DataFrame) -> DataFrame:
    """``pairs(u, v)`` with the same components and nodes, after tasks have joined up the edges they hold, ``AT_ONCE`` at a time.

    Edges are sorted into tasks by their larger end, so neighbours by name meet early; any
    dealing gives the same components.
    """
    kind = pairs.schema["u"].dataType
    if not isinstance(kind, IntegralType | StringType):
        return pairs

    def run(frames):
        held, n = [], 0
        for f in frames:
            held.append(f)
            n += len(f)
            if n >= AT_ONCE:
                rows = pd.concat(held)
                yield _stars(rows["u"], rows["v"])
                held, n = [], 0
        if n:
            rows = pd.concat(held)
            yield _stars(rows["u"], rows["v"])

    stars = pairs.repartitionByRange("u").mapInPandas(run, f"u {kind.simpleString()}, v {kind.simpleString()}")
    return stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node of an edge; component = smallest reachable node.

    Tasks first join up the edges they hold (``joined_up``), which leaves few rounds. Then
    alternates large-star and small-star contraction: each round is a map-side-combined
    ``min`` per node and an equi-join back, so a hub with a third of all edges is split by
    the skew join instead of landing in one task. Self loops and null ends are allowed:
    a self loop keeps its node, a row with a null end contributes its other end.
    """
    ends = edges.select(F.col(src).alias("s"), F.col(dst).alias("d"))
    nodes = ends.select(F.col("s").alias("node")).union(ends.select("d")).where("node is not null").distinct()
    pairs = settled(ends.where("s <> d").select(F.greatest("s", "d").alias("u"), F.least("s", "d").alias("v")).distinct())
    pairs = settled(joined_up(pairs), pairs)
    for _ in range(max_rounds):
        # done once all are stars: each larger end has one smaller end, which is no larger end itself
        ends_of = pairs.select(F.col("u").alias("n"), "v").union(pairs.select("v", F.lit(None).cast(pairs.schema["v"].dataType)))
        of = ends_of.groupBy("n").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max(F.col("v").isNull()).alias("centre"))
        if of.where("least <> most or (centre and least is not null)").isEmpty():
            break
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).where("v <> m")
        pairs = settled(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(), pairs)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("u").alias("child"), F.col("v").alias("root"))
    return nodes.join(roots, F.col("node") == F.col("child"), "left").select("node", F.coalesce("root", "node").alias("component"))
