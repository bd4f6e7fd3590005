"""Similar-item search: an index of cells for vectors, string neighbours behind exact bounds, and the best pairs of a table."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from claimloom.functions import text as T
from claimloom.functions.vectors import unit
from claimloom.model import table
from claimloom.operators.joins import nearest_in_block
from claimloom.plans.lineage import cut
from claimloom.registry import query

#: Rows of the sample that an index is fitted on, and queries of it that its number of probes is measured with.
SAMPLE, TRIALS = 20_000, 500
#: Rows and queries that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 4096


# J18: cells ---------------------------------------------------------------------


def fit_cells(sample: np.ndarray, cells: int, seed: int = 20260724, rounds: int = 10) -> np.ndarray:
    """Unit centres of ``cells`` groups of unit vectors, by rounds of means from rows drawn with ``seed``; cells may be fewer than asked for."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(np.round(sample, 9), axis=0)
    centres = distinct[rng.permutation(len(distinct))[:cells]]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many cells, nearest first, ``TRIALS`` rows of the sample must visit to find that share of their ``k`` nearest others in it."""
    trials = sample[:TRIALS]
    sims = trials @ sample.T
    sims[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    best = np.argpartition(-sims, k - 1, 1)[:, :k]
    own = (sample @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(trials @ centres.T), 1, kind="stable"), 1)
    depth = np.take_along_axis(place, own[best], 1).ravel()
    return int(np.quantile(depth, recall, method="higher")) + 1


def nearest_cells(vector, centres, most: int):
    """A column: numbers of the ``most`` nearest cells of a unit vector, nearest first; ``centres`` is a broadcast matrix."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def near(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        m = centres.value
        out = []
        for at in range(0, len(vectors), 1024):
            sims = np.stack(vectors[at : at + 1024].to_list()) @ m.T
            out += list(np.argsort(-sims, 1, kind="stable")[:, :most].astype(np.int32))
        return pd.Series(out)

    return near(vector)


def _usable(vectors: DataFrame, item: str) -> DataFrame:
    """``i, v``: unit vectors of rows with an id and a whole finite vector; equal ids keep one."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(F.col(item).isNotNull() & F.col("embedding").isNotNull() & F.coalesce(whole, F.lit(False)) & (F.size("embedding") > 0))
    return kept.groupBy(F.col(item).alias("i")).agg(F.min("embedding").alias("e")).select("i", unit(F.col("e")).alias("v"))


def indexed_neighbours(vectors: DataFrame, item: str, k: int = 30, every: int = 50, recall: float = 0.95, cells: int | None = None) -> DataFrame:
    """``a, b, sim, rank``: about the ``k`` nearest other rows of each row whose id is divisible by ``every``.

    Every row belongs to the cell whose centre is nearest; a query looks through the nearest
    cells, and what they hold is ranked by exact cosine. Centres, and the number of cells to
    look through for the wanted ``recall``, come from a sample of ``SAMPLE`` rows (by hash of
    the id): well-separated vectors need few cells, vectors without structure most of them.
    Cells are dealt into blocks of bounded size on both sides, so neither a cell that many
    rows share nor one that many queries visit is one task. Rows without an id or a whole
    finite vector take no part; an empty table gives no rows. All vectors have one width.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, item)
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("i", F.lit(7)), "i").limit(SAMPLE).select("v").collect()
    sample = np.array([r.v for r in drawn]) if n else np.zeros((1, 1))
    centres = fit_cells(sample, cells or int(min(4096, max(1, n**0.5 / 2))))
    probes = probes_for(sample, centres, k, recall)
    held = spark.sparkContext.broadcast(centres)
    homes = cut(rows.select("i", "v", nearest_cells(F.col("v"), held, 1)[0].alias("cell")))
    asked = homes.where(F.col("i") % every == 0)
    visits = cut(asked.select("i", "v", F.explode(nearest_cells(F.col("v"), held, probes)).alias("cell")))
    blocks = lambda frame, most, name: frame.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))
    sizes = F.broadcast(cut(blocks(homes, BLOCK_ROWS, "rb").join(blocks(visits, BLOCK_QUERIES, "qb"), "cell")))  # a row a cell
    deal = lambda count, salt: F.pmod(F.xxhash64("i", F.lit(salt)), F.col(count)).cast("int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = visits.join(sizes, "cell").select("i", "v", "cell", deal("qb", 1).alias("q"), spread("rb").alias("r"))
    right = homes.join(sizes, "cell").select(F.col("i").alias("j"), F.col("v").alias("w"), "cell", spread("qb").alias("q"), deal("rb", 2).alias("r"))
    kind = rows.schema["i"].dataType.simpleString()
    keys = ["cell", "q", "r"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: nearest_in_block(a, b, k), f"a {kind}, b {kind}, sim double")
    ranked = met.withColumn("sim", F.round("sim", 9)).withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    return ranked.where(F.col("rank") <= k)


# J20: strings -------------------------------------------------------------------

#: Buckets that two-character runs are counted in; runs that share one only raise a bound.
PAIR_BUCKETS = 512


def _counts(texts: list[str], size: int, buckets: int) -> np.ndarray:
    """How often each text has a run of ``size`` characters of each bucket, up to 255."""
    out = np.zeros((len(texts), buckets), np.int64)
    for k, t in enumerate(texts):
        codes = np.fromiter(map(ord, t), np.int64, len(t))
        runs = codes if size == 1 else codes[:-1] * 31 + codes[1:] if len(t) > 1 else codes[:0]
        np.add.at(out[k], runs * 2654435761 % 4294967296 % buckets, 1)
    return out


class Bounds:
    """Upper bounds of the insertion-deletion ratio between one text and many.

    A common subsequence of length L keeps L characters in common; and since a deletion takes
    at most two runs of two characters and an insertion one, the texts of lengths m and n
    share at least 3L - m - n - 1 such runs.
    """

    def __init__(self, texts: list[str]):
        self.lengths = np.array(list(map(len, texts)), np.int64)
        self.singles, self.pairs = (np.minimum(_counts(texts, size, n), 65535).astype(np.uint16) for size, n in ((1, 128), (2, PAIR_BUCKETS)))

    def against(self, other: Bounds, k: int, rows: np.ndarray) -> np.ndarray:
        """Bounds between ``rows`` of this and text ``k`` of ``other``."""
        m, n = self.lengths[rows], other.lengths[k]
        common = np.minimum(self.singles[rows], other.singles[k]).sum(1, dtype=np.int64)
        few = common >= 65535
        shared = np.minimum(self.pairs[rows], other.pairs[k]).sum(1, dtype=np.int64)
        longest = np.minimum(np.minimum(common, (shared + m + n + 1) // 3), np.minimum(m, n))
        longest = np.where(few | (m >= 65535) | (n >= 65535), np.minimum(m, n), longest)  # counts end there
        return np.where(m + n > 0, 200.0 * longest / np.maximum(1, m + n), 100.0)


def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def best_strings(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> tuple[pd.DataFrame, int]:
    """``a, b, score`` of each asked ``(a, x, floor)``'s ``k`` best other ``(b, y)`` that reach its floor, and how many ratios were taken.

    Rows come in falling order of their bound and stop where it is under the k-th best score.
    """
    rows = rows.sort_values("b")
    ids, texts = rows["b"].to_numpy(), rows["y"].to_list()
    turned, out, taken = list(map(_sorted_tokens, texts)), [], 0
    plain, by_token = Bounds(texts), Bounds(turned)
    wanted = asked["x"].to_list()
    turned_wanted = list(map(_sorted_tokens, wanted))
    of_plain, of_token = Bounds(wanted), Bounds(turned_wanted)
    everything = np.arange(len(ids))
    for at, (a, x, floor) in enumerate(zip(asked["a"].to_numpy(), wanted, asked["floor"].to_numpy(), strict=True)):
        bound = np.maximum(plain.against(of_plain, at, everything), by_token.against(of_token, at, everything))
        heap: list = []  # (score, -place), the worst first
        for place in np.argsort(-bound, kind="stable").tolist():
            if bound[place] < floor or (len(heap) == k and bound[place] < heap[0][0]):
                break
            if ids[place] == a:
                continue
            taken += 1
            score = max(T._ratio(x, texts[place]), T._ratio(turned_wanted[at], turned[place]))
            if score >= floor:
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -place))
        out += [(a, ids[-place], score) for score, place in heap]
    return pd.DataFrame(out, columns=["a", "b", "score"]).astype({"a": asked["a"].dtype, "b": rows["b"].dtype, "score": "float64"}), taken


def _text_neighbours(own: DataFrame, k: int, block: int) -> DataFrame:
    """``a, b, score``: the ``k`` most alike other texts of each asked row of ``own(i, t, asked)``, whose texts differ; see ``string_neighbours``."""
    own = cut(own.withColumn("band", F.floor(F.log2(F.length("t") + 1) * 8).cast("int")))
    # token-sorted texts may be shorter by their blanks, so a band knows both lengths
    turned = F.length(F.array_join(F.array_remove(F.split("t", r"\s+"), ""), " "))
    bands = cut(own.groupBy("band").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), F.min(F.least(F.length("t"), turned)).alias("low"), F.max(F.length("t")).alias("high")))
    salt = F.pmod(F.xxhash64("i", F.lit(3)), F.col("blocks")).cast("int")
    right = own.join(F.broadcast(bands), "band").select(F.col("i").alias("b"), F.col("t").alias("y"), "band", salt.alias("salt"))  # some 200 bands
    asked = own.where("asked").select(F.col("i").alias("a"), F.col("t").alias("x"), F.col("band").alias("own"), F.length("t").alias("long"), turned.alias("long2"))
    kind = own.schema["i"].dataType.simpleString()
    shape, keys = f"a {kind}, b {kind}, score double", ["band", "salt", "part"]
    #: Queries of one block go in parts of bounded size; its rows go to each.
    n_asked = asked.count()
    parts = max(1, -(-n_asked // block))
    part = F.pmod(F.xxhash64("a", F.lit(5)), F.lit(parts)).cast("int")
    each = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(queries: DataFrame) -> DataFrame:
        return queries.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(lambda q, r: best_strings(q, r, k)[0] if len(q) and len(r) else pd.DataFrame({"a": q["a"][:0], "b": r["b"][:0], "score": np.zeros(0)}), shape)

    home = asked.join(F.broadcast(bands), asked["own"] == bands["band"]).select("a", "x", "own", "long", "long2", "band", F.pmod(F.xxhash64("a", F.lit(3)), F.col("blocks")).cast("int").alias("salt"), part.alias("part"), F.lit(0.0).alias("floor"))
    first = cut(meet(home))
    floors = first.groupBy("a").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("floor"))
    lengths = [F.least(F.col(n), F.col("high")) * 200.0 / F.greatest(F.col(n) + F.when(F.col("high") < F.col(n), F.col("high")).otherwise(F.greatest(F.col(n), F.col("low"))), F.lit(1)) for n in ("long", "long2")]
    most = F.when(F.least("long", "long2") == 0, 100.0).otherwise(F.greatest(*lengths))
    far = home.drop("floor", "band", "salt").join(floors, "a", "left").na.fill(0.0, ["floor"]).join(F.broadcast(bands)).where(most >= F.col("floor") - 1e-9)
    far = far.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(home.select("a", F.col("band").alias("hb"), F.col("salt").alias("hs")), "a").where("band <> hb or salt <> hs")
    found = first.unionByName(meet(far.select("a", "x", "band", "salt", "part", "floor")))
    return _ranked(found, "a", k)


def _ranked(frame: DataFrame, key: str, k: int) -> DataFrame:
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "b"))).where(F.col("rank") <= k)


def string_neighbours(rows: DataFrame, item: str, text: str, k: int = 30, every: int = 50, block: int = 2048) -> DataFrame:
    """``a, b, score, rank``: the ``k`` most alike other texts of each row whose id is divisible by ``every``.

    The score is the larger of the ratio and the token-sorted ratio in lower case; ties go to
    the smaller id. Equal texts are searched for once, under their smallest id: whatever
    is not in one of the ``k`` best other texts by score and that id comes behind ``k`` ids.
    A text then stands for its ``k + 1`` smallest ids, one more for the row that asks.

    Texts are dealt into blocks by length. A query first meets one block of
    its own length; the k-th best score there is its floor, and it then meets only blocks
    whose lengths allow that score. Within a block a ratio is taken only where common
    characters and runs of two allow a place among the ``k``, so the result is exact. Null
    texts are empty, equal ids are one row with the smaller text, null ids take no part.
    """
    own = rows.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("i")).agg(F.min(F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("t"))
    own = cut(own)
    texts = cut(own.groupBy("t").agg(F.min("i").alias("i"), F.max(F.col("i") % every == 0).alias("asked")))
    of = texts.select("t", F.col("i").alias("text"))
    held = own.withColumn("n", F.row_number().over(Window.partitionBy("t").orderBy("i"))).where(F.col("n") <= k + 1).join(of, "t").select("text", F.col("i").alias("b"))
    met = _text_neighbours(texts, k, block).select(F.col("a").alias("asking"), F.col("b").alias("text"), "score")
    same = texts.where("asked").select(F.col("i").alias("asking"), F.col("i").alias("text"), F.lit(100.0))
    best = cut(_ranked(met.union(same).join(held, "text").select("asking", "b", "score"), "asking", k + 1).drop("rank"))
    asked = own.where(F.col("i") % every == 0).join(of, "t").select(F.col("text").alias("asking"), F.col("i").alias("a"))
    return _ranked(asked.join(best, "asking").where("a <> b").select("a", "b", "score"), "a", k)


# J19: best pairs ----------------------------------------------------------------

#: Weights of the lexical score: characters, tokens, trigrams, token order (fixed values).
WEIGHTS = (0.45, 0.30, 0.15, 0.10)
TOKEN_BUCKETS, GRAM_BUCKETS = 256, 1024
#: Slack for rounding in bounds.
EPS = 1e-9


class Forms:
    """The forms of one block's items, with what bounds need."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["i", "form"], kind="stable")
        self.ids, self.texts = rows["i"].to_numpy(), rows["form"].to_list()
        self.items, first, self.item_of = np.unique(self.ids, return_index=True, return_inverse=True)
        self.vectors = np.stack(rows["v"].iloc[first].to_list())
        self.denied = {i: set(no) for i, no in zip(self.ids, rows["denied"], strict=True) if no is not None and len(no)}
        # forms that many items share are cut into parts once
        self.kinds, self.kind_of = np.unique(np.array(self.texts, dtype=object), return_inverse=True)
        self.at = np.searchsorted(self.item_of, np.arange(len(self.items) + 1))
        self.tokens = [t.split() for t in self.kinds]
        self.compact = ["".join(t) for t in self.tokens]
        self.grams = [{c[k : k + 3] for k in range(len(c) - 2)} for c in self.compact]
        self.n_tokens, self.n_grams = (np.array(list(map(len, x)), np.float32) for x in (self.tokens, self.grams))
        self._counts: np.ndarray | None = None

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed tokens and trigrams of each kind, made when they are first asked for."""
        if self._counts is None:
            self._counts = self._hashed(self.tokens, TOKEN_BUCKETS), self._hashed(self.grams, GRAM_BUCKETS)
        return self._counts

    @staticmethod
    def _hashed(sets, buckets: int) -> np.ndarray:
        import zlib

        out = np.zeros((len(sets), buckets), np.float32)
        for k, s in enumerate(sets):
            for x in s:
                out[k, zlib.crc32(x.encode()) % buckets] += 1
        return out

    def bounds(self, other: Forms, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        """What the lexical score of each kind ``f`` of this and kind ``g`` of the other cannot exceed."""
        if 16 * len(f) > len(self.kinds) * len(other.kinds):
            tokens, grams = ((x @ y.T)[f, g] for x, y in zip(self.counts(), other.counts(), strict=True))
        else:
            parts = [[np.einsum("ij,ij->i", x[f[k : k + 4096]], y[g[k : k + 4096]]) for k in range(0, len(f), 4096)] for x, y in zip(self.counts(), other.counts(), strict=True)]
            tokens, grams = (np.concatenate(p) if p else np.zeros(0, np.float32) for p in parts)
        t, u, n, m = self.n_tokens[f], other.n_tokens[g], self.n_grams[f], other.n_grams[g]
        tokens = 2 * np.minimum(tokens, np.minimum(t, u)) / np.maximum(1, t + u)
        grams = np.minimum(grams, np.minimum(n, m))
        grams = grams / np.maximum(1, n + m - grams)
        grams[(n == 0) | (m == 0)] = 1.0  # texts under three characters may be equal
        most = np.minimum(1.0, WEIGHTS[0] + WEIGHTS[3] + WEIGHTS[1] * tokens + WEIGHTS[2] * grams)
        most[grams > 1 - 1e-6] = 1.0  # texts that are equal without blanks have equal trigrams
        return most + 1e-6


def _cheap(one: Forms, i: int, two: Forms, j: int) -> tuple[float, float]:
    """Token dice (as multisets) and trigram Jaccard of two kinds."""
    rest, shared = list(two.tokens[j]), 0
    for t in one.tokens[i]:
        if t in rest:
            rest.remove(t)
            shared += 1
    tokens = 2 * shared / (len(one.tokens[i]) + len(two.tokens[j])) if one.tokens[i] and two.tokens[j] else 0.0
    g, h = one.grams[i], two.grams[j]
    grams = len(g & h) / len(g | h) if g and h else float(one.compact[i] == two.compact[j] != "")
    return tokens, grams


def lexical(one: Forms, i: int, two: Forms, j: int, least: float = -1.0) -> float | None:
    """The lexical score of two kinds of forms, 1 if they are equal without blanks; None once it cannot reach ``least``."""
    if one.compact[i] == two.compact[j] != "":
        return 1.0
    tokens, grams = _cheap(one, i, two, j)
    if WEIGHTS[0] + WEIGHTS[3] + WEIGHTS[1] * tokens + WEIGHTS[2] * grams < least - EPS:
        return None
    ratio, order = T._ratio(one.kinds[i], two.kinds[j]) / 100, T._ratio(" ".join(sorted(one.tokens[i])), " ".join(sorted(two.tokens[j]))) / 100
    return WEIGHTS[0] * ratio + WEIGHTS[1] * tokens + WEIGHTS[2] * grams + WEIGHTS[3] * order


#: Items of one side whose cosines are taken at once, and pairs that are looked at before the floor is raised again.
TILE, TURN = 2048, 1 << 16


def _forms_of_pairs(one: Forms, p: np.ndarray, two: Forms, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every form of ``p`` with every form of ``q``: number of the pair, and both forms' numbers."""
    n, m = one.at[p + 1] - one.at[p], two.at[q + 1] - two.at[q]
    pair = np.repeat(np.arange(len(p)), n * m)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    return pair, one.at[p][pair] + k // m[pair], two.at[q][pair] + k % m[pair]


def best_pairs_of(one: Forms, two: Forms, keep: int, floor: float, alone: bool) -> tuple[list[tuple], int]:
    """The ``keep`` best pairs ``(score, a, b)`` of items that reach ``floor``, best first, and how many pairs of forms were scored.

    ``alone`` says that both are one block. The floor rises with the pairs found. As no
    lexical score exceeds 1, a pair is looked at only if its cosine reaches twice the floor
    less 1; lexical bounds and scores are taken once for each two kinds of forms.
    """
    names = np.unique(np.concatenate([one.items, two.items]))
    number = [np.searchsorted(names, x.items) for x in (one, two)]
    short = [x.vectors.astype(np.float32) for x in (one, two)]
    known: dict[tuple[int, int], float] = {}
    key, s, scored, denied = np.zeros(0, np.int64), np.zeros(0), 0, one.denied | two.denied

    def look(i: np.ndarray, j: np.ndarray) -> None:
        """Take pairs of items whose cosine is near enough."""
        nonlocal key, s, floor, scored
        if denied:
            pairs = ((min(x, y), max(x, y)) for x, y in zip(one.items[i], two.items[j], strict=True))
            free = np.array([y not in denied.get(x, ()) for x, y in pairs], bool)
            i, j = i[free], j[free]
        cosine = np.round(np.einsum("ij,ij->i", one.vectors[i], two.vectors[j]), 9)
        i, j, cosine = (x[0.5 + 0.5 * cosine >= floor - EPS] for x in (i, j, cosine))
        pair, f, g = _forms_of_pairs(one, i, two, j)
        both, kind = np.unique(one.kind_of[f] * len(two.kinds) + two.kind_of[g], return_inverse=True)
        first, second = both // len(two.kinds), both % len(two.kinds)
        bound = 0.5 * one.bounds(two, first, second)[kind] + 0.5 * cosine[pair]
        order = np.argsort(-bound, kind="stable")
        at, step = 0, 256
        while at < len(order):
            some = order[at : at + step]
            some = some[bound[some] >= floor - EPS]
            if not len(some):
                break
            kinds, of = np.unique(kind[some], return_inverse=True)
            for k in kinds.tolist():
                two_kinds = (int(first[k]), int(second[k]))
                if two_kinds not in known:
                    known[two_kinds] = lexical(one, two_kinds[0], two, two_kinds[1])
            share = np.array([known[int(first[k]), int(second[k])] for k in kinds.tolist()])[of]
            scored += len(some)
            x, y = number[0][i[pair[some]]], number[1][j[pair[some]]]
            key = np.concatenate([key, np.minimum(x, y) * len(names) + np.maximum(x, y)])
            s = np.concatenate([s, np.round(0.5 * share + 0.5 * cosine[pair[some]], 9)])
            best = np.lexsort((-s, key))
            best = best[np.concatenate([[True], key[best][1:] != key[best][:-1]])]  # of a pair's scores the best
            best = best[s[best] >= floor - EPS]
            best = best[np.lexsort((key[best], -s[best]))[:keep]]
            key, s = key[best], s[best]
            if len(s) == keep:
                floor = max(floor, float(s[-1]))
            at, step = at + step, min(TURN, 4 * step)

    for top in range(0, len(one.items), TILE):
        for left in range(top if alone else 0, len(two.items), TILE):
            # products of 32 bits are off by less than this slack
            i, j = np.nonzero(short[0][top : top + TILE] @ short[1][left : left + TILE].T >= 2 * floor - 1 - 1e-4)
            i, j = i + top, j + left
            ok = i < j if alone else one.items[i] != two.items[j]
            i, j = i[ok], j[ok]
            for turn in range(0, len(i), TURN):
                look(i[turn : turn + TURN], j[turn : turn + TURN])
    return list(zip(s.tolist(), names[key // len(names)].tolist(), names[key % len(names)].tolist(), strict=True)), scored


def best_pairs(items: DataFrame, keep: int = 100, blocked: DataFrame | None = None, block: int = 32_768, cells: int | None = None) -> DataFrame:
    """``a, b, score``: the ``keep`` best pairs of different ``items(item, forms, embedding)``, ``a < b``, best first, ties by ids.

    The score is half the lexical score of the two forms most alike and half the cosine;
    pairs of ``blocked(a, b)`` do not count. Items are dealt by the nearest centre into blocks
    that know how far from it they reach. Each block is searched alone, which gives a floor:
    the ``keep``-th best score so far. Then only blocks near enough to hold such a pair meet,
    and within them a pair is scored in full only while bounds from hashed tokens, trigrams
    and its cosine reach the floor, which rises as pairs are found. The result is exact.
    Items without an id, a form or a whole finite vector take no part.
    """
    spark = items.sparkSession
    usable = _usable(items.withColumnRenamed("item", "i_"), "i_")
    forms = items.where("item is not null and forms is not null").select(F.col("item").alias("i"), F.explode("forms").alias("f")).where("f is not null")
    forms = forms.groupBy("i").agg(F.collect_set(F.trim(F.regexp_replace(F.lower("f"), r"\s+", " "))).alias("forms"))
    drawn = usable.orderBy(F.xxhash64("i", F.lit(7)), "i").limit(SAMPLE).select("v").collect()
    kind = items.schema["item"].dataType.simpleString()
    if not drawn:
        return spark.createDataFrame([], f"a {kind}, b {kind}, score double")
    n = forms.agg(F.sum(F.size("forms"))).first()[0] or 0
    centres = fit_cells(np.array([r.v for r in drawn]), cells or int(min(1024, max(1, n // (2 * block)))))
    held = spark.sparkContext.broadcast(centres)
    homes = usable.select("i", "v", nearest_cells(F.col("v"), held, 1)[0].alias("cell")).join(forms, "i")
    if blocked is None:
        homes = homes.withColumn("denied", F.array().cast(f"array<{kind}>"))
    else:  # the smaller item of a pair knows the larger
        denied = blocked.groupBy(F.least("a", "b").alias("i")).agg(F.collect_set(F.greatest("a", "b")).alias("denied"))
        homes = homes.join(denied, "i", "left")
    homes = cut(homes)
    of_cell = cut(homes.groupBy("cell").agg(F.ceil(F.sum(F.size("forms")) / F.lit(block)).cast("int").alias("blocks")))
    rows = homes.join(F.broadcast(of_cell), "cell").withColumn("k", F.pmod(F.xxhash64("i", F.lit(2)), F.col("blocks")).cast("int"))

    @F.pandas_udf("double")
    def away(vectors: pd.Series, cell: pd.Series) -> pd.Series:
        sims = (np.stack(vectors.to_list()) * held.value[cell.to_numpy()]).sum(1) if len(vectors) else np.zeros(0)
        return pd.Series(np.arccos(np.clip(sims, -1, 1)))

    rows = cut(rows.withColumn("away", away("v", "cell")).select("i", "v", "forms", "denied", "cell", "k", "away"))
    reach = cut(rows.groupBy("cell", "k").agg(F.max("away").alias("reach"), F.count("*").alias("n")))
    shape = f"a {kind}, b {kind}, score double"
    of_block = lambda rows: Forms(rows.explode("forms").rename(columns={"forms": "form"}))

    def search(left: pd.DataFrame, right: pd.DataFrame | None, floor: float) -> pd.DataFrame:
        if not len(left) or (right is not None and not len(right)):
            return pd.DataFrame({"a": left["i"][:0], "b": left["i"][:0], "score": np.zeros(0)})
        one = of_block(left)
        found, _ = best_pairs_of(one, one if right is None else of_block(right), keep, floor, right is None)
        return pd.DataFrame([(a, b, s) for s, a, b in found], columns=["a", "b", "score"]).astype({"a": left["i"].dtype, "b": left["i"].dtype, "score": "float64"})

    alone = cut(rows.groupBy("cell", "k").applyInPandas(lambda block: search(block, None, -2.0), shape))
    top = lambda frame: frame.groupBy("a", "b").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "a", "b").limit(keep)
    so_far = top(alone).agg(F.count("*"), F.min("score")).first()
    floor = so_far[1] if so_far[0] == keep else -2.0

    @F.pandas_udf("double")
    def gap(one: pd.Series, two: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series(np.arccos(np.clip((m[one.to_numpy()] * m[two.to_numpy()]).sum(1), -1, 1)))

    pairs = reach.toDF("lc", "lk", "lr", "ln").join(F.broadcast(reach.toDF("rc", "rk", "rr", "rn")), (F.col("lc") < F.col("rc")) | ((F.col("lc") == F.col("rc")) & (F.col("lk") < F.col("rk"))))
    nearest = F.greatest(F.lit(0.0), gap("lc", "rc") - F.col("lr") - F.col("rr"))
    pairs = cut(pairs.where(0.5 + 0.5 * F.cos(nearest) >= floor - EPS).select("lc", "lk", "rc", "rk"))
    keys = ["lc", "lk", "rc", "rk"]
    left = rows.toDF("i", "v", "forms", "denied", "lc", "lk", "away").join(pairs, ["lc", "lk"])
    right = rows.toDF("i", "v", "forms", "denied", "rc", "rk", "away").join(pairs, ["rc", "rk"])
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda one, two: search(one, two, floor), shape)
    return top(alone.unionByName(met))


@query("j18_indexed_neighbours")
def j18(spark, d):
    return indexed_neighbours(table(spark, d, "embeddings"), "vec_id").select("a", "b", F.round("sim", 6).alias("sim"), "rank")


@query("j19_best_pairs")
def j19(spark, d):
    """Parts that have a vector of their number: names and what is left of them without the first word are their forms."""
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("item"), F.array("p_name", F.regexp_replace("p_name", r"^\S+\s+", "")).alias("forms"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    return best_pairs(parts.join(vectors, "item"), 100).withColumn("score", F.round("score", 6))


@query("j20_string_neighbours")
def j20(spark, d):
    return string_neighbours(table(spark, d, "part"), "p_partkey", "p_name", 30).withColumn("score", F.round("score", 9))
