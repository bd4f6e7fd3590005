"""Operator 10: exact top-k inner products by no-random-access aggregation.

Each dimension is a list of the rows sorted by their value, which a query reads from the top
where its own component is positive and from the bottom where it is negative. All lists are
read in blocks to one depth. What a query has read of a row adds up; what it has not read
lies between the list's frontier and its far end, so every row has an upper and a lower
bound. Rows whose upper bound is under the k-th best lower bound, or under the k-th best
score of rows read before, cannot qualify. Reading stops when no more than ``POOL * k`` rows
are left, and only their scores are resolved.

Both bounds are sums over the two ends of the lists, with unread values held at the frontier
or the far end, so the bounds of many queries at one depth are one matrix product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
#: Parts of each list, and after how many of them the bounds are taken.
READS = 64
LEVELS = (1, 2, 4, 8, 16, 32, 40, 48, 56, 64)
#: Rows for each wanted one that may be left when reading stops.
POOL = 2
#: Rows of a query block and of a candidate block; a task holds one of each.
QUERY_ROWS, CANDIDATE_ROWS = 32768, 32768
#: Components of a block at most, so that wide vectors make shorter blocks.
CELLS = 1 << 22
#: Candidate blocks that rows enough for it are dealt into at least, and the least rows of such a block.
SPREAD, LEAST_ROWS = 12, 1024
#: Rows of the first lists of a block, which have no scores to go by, and of the others.
FIRST_LISTS, LISTS = 1024, 4096
#: Queries that take their bounds together, and those that go first to tell the others how deep to start.
BATCH, PILOT = 512, 16


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: floor(64 x) of each component; rows without a finite whole vector or an id go, repeated ids keep their smallest vector."""
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x))
    values = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    return vectors.where(usable).select(F.col("vec_id").cast("long"), values.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


class Lists:
    """Rows as one sorted list for each dimension, read from both ends."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.n = rows, len(rows)
        self.values = np.sort(rows, 0)
        self.alike = self.values[0] == self.values[-1]  # such a list says nothing, and is not read
        self.known: dict = {}

    def read(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The most and the least that each row may have in each list, from the top and from the bottom, and the entries read; equal entries are read together."""
        if level not in self.known:
            depth = -(-self.n * level // READS)
            top, bottom = self.values[self.n - depth], self.values[depth - 1]
            above, below = self.rows >= top, self.rows <= bottom
            most = np.hstack([np.maximum(self.rows, top), np.minimum(self.rows, bottom)])
            least = np.hstack([np.where(above, self.rows, self.values[0]), np.where(below, self.rows, self.values[-1])])
            entries = np.where(np.tile(self.alike, 2), 0, np.concatenate([above.sum(0), below.sum(0)]))
            self.known[level] = most, least, entries
        return self.known[level]


class Best:
    """The ``k`` best rows of each query so far, by score and then id; places not yet taken score ``LOWEST``."""

    def __init__(self, n: int, k: int, kind):
        self.lowest = -np.inf if np.issubdtype(kind, np.floating) else np.iinfo(kind).min + 1
        self.scores, self.ids = np.full((n, k), self.lowest, kind), np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        better = scores > self.scores[at, -1]  # ids come in rising order, so an equal score comes too late
        if not better.any():
            return
        touched, at = np.unique(at[better], return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        scores, ids = np.concatenate([self.scores[touched].ravel(), scores[better]]), np.concatenate([self.ids[touched].ravel(), ids[better]])
        order = np.lexsort((ids, -scores, owner))
        take = order[np.searchsorted(owner[order], np.arange(len(touched)))[:, None] + np.arange(self.k)]
        self.scores[touched], self.ids[touched] = scores[take], ids[take]


def _bounded(lists: Lists, queries: np.ndarray, ends: np.ndarray, own: np.ndarray, level: int, best: Best, at: np.ndarray):
    """Of queries ``at``: places and rows that may still qualify at this depth, and their scores where all is read."""
    if level == READS:
        upper = lower = queries[at] @ lists.rows.T
    else:
        most, least, _ = lists.read(level)
        upper = lower = ends[at] @ most.T
    mine = np.flatnonzero((own[at] >= 0) & (own[at] < lists.n))
    upper[mine, own[at][mine]] = best.lowest
    floor = best.scores[at, -1]
    alive = upper > floor[:, None]
    if (floor == best.lowest).any() and lists.n > best.k:
        if level < READS:
            lower = ends[at] @ least.T
            lower[mine, own[at][mine]] = best.lowest
        alive &= upper >= np.partition(lower, lists.n - best.k, 1)[:, [lists.n - best.k]]
    place, row = np.divmod(np.flatnonzero(alive), lists.n)
    return place, row, upper[place, row] if level == READS else None


def _read_lists(lists: Lists, ids: np.ndarray, queries: np.ndarray, ends: np.ndarray, own: np.ndarray, best: Best, read: np.ndarray) -> None:
    """All queries against one set of lists, each as deep as it must; ``best`` and ``read`` are brought up to date."""
    start, stopped = 0, []
    for first in [0, *range(PILOT, len(queries), BATCH)]:
        at = np.arange(first, min(len(queries), first + BATCH if first else PILOT))
        for step in range(start, len(LEVELS)):
            level = LEVELS[step]
            place, row, scores = _bounded(lists, queries, ends, own, level, best, at)
            left = np.bincount(place, minlength=len(at))
            done = (left <= POOL * best.k) | (level == READS)
            keep = done[place]
            place, row = at[place[keep]], row[keep]
            scores = np.einsum("ij,ij->i", queries[place], lists.rows[row]) if scores is None else scores[keep]
            best.add(place, scores, ids[row])
            read[at[done]] += (ends[at[done]] != 0) @ (np.where(np.tile(lists.alike, 2), 0, lists.n) if level == READS else lists.read(level)[2])
            if not first:
                stopped += [step] * int(done.sum())
            at = at[~done]
            if not len(at):
                break
        if not first:
            start = sorted(stopped)[len(stopped) * 9 // 10]


def best_rows(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[Best, np.ndarray]:
    """Each query's ``k`` best rows but its own, and how many list entries it read.

    Rows are taken in lists of bounded length in the order of their ids: the scores found in
    one are what rows of the next have to exceed. Sums stay exact: 32-bit floats hold them
    under 2^24, 64-bit ones under 2^51, whole numbers beyond.
    """
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 51 else np.int64
    by_id = np.argsort(row_ids, kind="stable")
    rows, row_ids, queries = rows[by_id].astype(kind), row_ids[by_id], queries.astype(kind)
    ends = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
    own = np.searchsorted(row_ids, query_ids)
    own[(own == len(row_ids)) | (row_ids[np.minimum(own, len(row_ids) - 1)] != query_ids)] = -1 - len(row_ids)
    best, read = Best(len(queries), k, kind), np.zeros(len(queries), np.int64)
    first = max(FIRST_LISTS, 2 * k)
    edges = [0, *range(first, len(rows), LISTS), len(rows)] if len(rows) > max(first, LISTS) else [0, len(rows)]
    for at, stop in zip(edges, edges[1:], strict=False):
        _read_lists(Lists(rows[at:stop]), row_ids[at:stop], queries, ends, own - at, best, read)
    return best, read


def nra(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """For each query the ids and scores of its ``k`` best rows, ties to the smaller id, and the list entries read."""
    best, read = best_rows(queries, query_ids, rows, row_ids, k)
    taken = best.scores > best.lowest
    return [(ids[t], scores[t].astype(np.int64), int(r)) for ids, scores, t, r in zip(best.ids, best.scores, taken, read, strict=True)]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS, report: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other rows by integer inner product.

    Queries are the rows whose ``vec_id`` is divisible by ``every``. Queries and candidates
    are dealt into blocks by hash and every pair of blocks meets in one task of bounded
    size, which returns its own ``k`` best; those few are ranked again for each query.
    Shorter vectors count as padded with zeros. Ids name rows: repeats of an id are one row.
    Fewer candidates than ``k`` give all of them; no queries or an empty table give no rows.
    ``report`` adds ``read``, the share of all list entries that the query has read.
    """
    from claimloom.plans.lineage import cut

    rows = cut(whole_numbers(vectors))
    is_query = F.col("vec_id") % every == 0
    n, n_queries, width = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    candidate_rows, query_rows = (max(1, min(most, CELLS // width)) for most in (candidate_rows, query_rows))
    blocks, query_blocks = max(1, -(-n // candidate_rows), min(SPREAD, n // LEAST_ROWS)), max(1, -(-n_queries // query_rows))
    parts = min(4 * blocks * query_blocks, 1024)  # given, since a small block is much work
    deal = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.select(F.col("vec_id").alias("row_id"), F.col("v").alias("w"), deal(blocks, 1).alias("cb"), spread(query_blocks).alias("qb")).repartition(parts, "qb", "cb")
    queries = rows.where(is_query).select("vec_id", "v", spread(blocks).alias("cb"), deal(query_blocks, 2).alias("qb")).repartition(parts, "qb", "cb")
    names = ["query_id", "vec_id", "score", *(["entries"] if report else [])]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(np.zeros((0, len(names)), np.int64), columns=names)
        ids = left["vec_id"].to_numpy()
        best, read = best_rows(_matrix(left["v"], width), ids, _matrix(right["w"], width), right["row_id"].to_numpy(), k)
        taken = best.scores > best.lowest
        query = np.nonzero(taken)[0]
        found = [ids[query], best.ids[taken], best.scores[taken].astype(np.int64), read[query]]
        return pd.DataFrame(dict(zip(names, found, strict=False)))

    met = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(meet, ", ".join(f"{name} long" for name in names))
    if report:
        by_block = cut(met.withColumn("cb", deal(blocks, 1)))
        reads = by_block.groupBy("query_id", "cb").agg(F.max("entries").alias("e")).groupBy("query_id").agg((F.sum("e") / F.lit(float(n * width))).alias("read"))
        met = by_block.join(reads, "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", *(["read"] if report else []))


OP10_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
