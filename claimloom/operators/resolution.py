"""Resolution and similarity operators: bounded search, alignment, patterns, overlays and refinement loops."""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from claimloom.functions import text as T
from claimloom.functions.vectors import centroids, dot, norm, unit
from claimloom.model import oracle, table, view
from claimloom.operators.components import connected_components
from claimloom.operators.graph import greedy_disjoint
from claimloom.plans.lineage import cut, settled
from claimloom.registry import query


def nearest_assignment(lines: DataFrame, entries: DataFrame, page: str, reach: int = 140) -> DataFrame:
    """Each line takes the nearest entry of its page not taken yet, within ``reach``; lines in order of height.

    The walk is sequential within a page; pages run apart. Entries stand in order of height, and
    heights without a free entry are skipped by links to the next one on either side, so a page
    takes about as many steps as it has lines and entries. Ties go to the smaller entry.
    """

    def assign(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("entry", keep="last").sort_values(["y", "entry"])
        entries = b["entry"].tolist()
        levels, first = np.unique(b["y"].to_numpy(), return_index=True)
        levels, next_, end = levels.tolist(), first.tolist(), [*first[1:].tolist(), len(b)]
        # the nearest level downwards (level k stands at k + 1, 0 is none) and upwards that has free entries
        down, up = list(range(len(levels) + 1)), list(range(len(levels) + 1))

        def link(to: list, k: int) -> int:
            root = k
            while to[root] != root:
                root = to[root]
            while to[k] != root:
                to[k], k = root, to[k]
            return root

        out = []
        a = a.sort_values(["y", "line"])
        at = np.searchsorted(np.array(levels), a["y"].to_numpy(), "right").tolist() if levels else []
        for line, y, k in zip(a["line"].tolist(), a["y"].tolist(), at, strict=False):
            below, above = link(down, k) - 1, link(up, k)
            options = [(abs(levels[x] - y), entries[next_[x]], x) for x in (below, above) if 0 <= x < len(levels)]
            best = min(options, default=None)
            if best and best[0] <= reach:
                x = best[2]
                next_[x] += 1
                if next_[x] == end[x]:
                    down[x + 1], up[x] = x, x + 1
                out.append((line, best[1], best[0]))
        found = pd.DataFrame(out, columns=["line", "entry", "dy"])
        found.insert(0, page, a[page].iloc[0] if len(a) else 0)
        return found

    return lines.groupBy(page).cogroup(entries.groupBy(page)).applyInPandas(assign, f"{page} long, line long, entry long, dy long")


def best_gram_match(titles: pd.DataFrame, headings: pd.DataFrame) -> pd.DataFrame:
    """``title_id, heading_id, sim``: each title's best ``(heading_id, h)`` by Jaccard of gram sets ``g`` and ``h``, ties to the smaller id.

    A gram lists the headings that hold it, so a title counts shared grams from its own lists alone.
    """
    found = titles[["title_id"]].assign(heading_id=headings["heading_id"].iloc[0] if len(headings) else 0, sim=0.0)
    if not len(titles) or not len(headings):
        return found[:0]
    headings = headings.sort_values("heading_id", kind="stable")
    ids, listed = headings["heading_id"].to_numpy(), {}
    sizes = np.array([0 if h is None else len(h) for h in headings["h"]])
    for place, held in enumerate(headings["h"]):
        for gram in () if held is None else held:
            listed.setdefault(gram, []).append(place)
    listed = {gram: np.array(places) for gram, places in listed.items()}
    best, sims = [], []
    for own in titles["g"]:
        own = () if own is None else own
        lists = [listed[gram] for gram in own if gram in listed]
        shared = np.bincount(np.concatenate(lists), minlength=len(ids)) if lists else np.zeros(len(ids), np.int64)
        sim = shared / np.maximum(1, len(own) + sizes - shared)
        best.append(int(sim.argmax()))
        sims.append(float(sim[best[-1]]))
    return found.assign(heading_id=ids[best], sim=sims)


def best_title(titles: DataFrame, headings: DataFrame, block: int = 4096) -> DataFrame:
    """For each ``(title_id, page, title)`` the heading within a page with the most similar 3-grams; a row's grams are made once.

    A page's titles and its headings are dealt into blocks of about ``block``, and a task holds one of each.
    """
    grams = lambda c: T.char_grams(F.lower(c))
    own = cut(titles.where("page is not null").select("title_id", F.col("page").alias("at"), grams("title").alias("g")))
    other = headings.select("heading_id", grams("heading").alias("h"), F.explode(F.array(*[F.col("page") + k for k in (-1, 0, 1)])).alias("at"))
    other = cut(other.where("at is not null"))
    blocks = lambda frame, name: frame.groupBy("at").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = cut(blocks(own, "tb").join(blocks(other, "hb"), "at"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = own.join(sizes, "at").select("at", "title_id", "g", deal("title_id", "tb").alias("t"), spread("hb").alias("k"))
    right = other.join(sizes, "at").select("at", "heading_id", "h", spread("tb").alias("t"), deal("heading_id", "hb").alias("k"))
    kind = lambda frame, c: frame.schema[c].dataType.simpleString()
    shape = f"title_id {kind(own, 'title_id')}, heading_id {kind(other, 'heading_id')}, sim double"
    met = left.groupBy("at", "t", "k").cogroup(right.groupBy("at", "t", "k")).applyInPandas(best_gram_match, shape)
    return met.groupBy("title_id").agg(F.max_by(F.struct("heading_id", "sim"), F.struct("sim", -F.col("heading_id"))).alias("b")).select("title_id", "b.*")


def theta_top(pairs: DataFrame, keep: int) -> DataFrame:
    """Of pairs whose parts are known (``search.best_pairs`` finds pairs): the best ``keep`` of ``(a, b, tok, tri, cos, char)`` by .5 lexical + .5 cosine; rows whose bound cannot reach the k-th are left out first."""
    lexical = 0.45 * F.col("char") + 0.30 * F.col("tok") + 0.15 * F.col("tri") + 0.10 * F.col("tok")
    bound = 0.5 * (0.55 + 0.30 * F.col("tok") + 0.15 * F.col("tri")) + 0.5 * F.col("cos")
    scored = pairs.withColumns({"score": 0.5 * lexical + 0.5 * F.col("cos"), "bound": bound})
    floor = scored.orderBy(F.desc("score"), "a", "b").limit(keep).agg(F.min("score").alias("floor"))
    return scored.join(F.broadcast(floor)).where("bound >= floor").orderBy(F.desc("score"), "a", "b").limit(keep).select("a", "b", "score")


def subsequence_merge(canonical: DataFrame, older: DataFrame, key: str) -> DataFrame:
    """``ordinal, old_ordinal``: each canonical text's place in the key's older list, matched forward; absent ones are null."""
    pool = older.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("pool"))
    wanted = canonical.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("want"))

    @F.pandas_udf(ArrayType(StructType([StructField("ordinal", IntegerType()), StructField("old_ordinal", IntegerType())])))
    def walk(want: pd.Series, pool_: pd.Series) -> pd.Series:
        out = []
        for items, have in zip(want, pool_, strict=True):
            at, found = 0, []
            for item in items:
                spot = next((k for k in range(at, len(have) if have is not None else 0) if have[k]["text"] == item["text"]), None)
                found.append({"ordinal": item["ordinal"], "old_ordinal": None if spot is None else have[spot]["ordinal"]})
                at = at if spot is None else spot + 1
            out.append(found)
        return pd.Series(out)

    return wanted.join(pool, key, "left").select(key, F.inline(walk("want", "pool")))


@F.pandas_udf(StructType([StructField("page", StringType()), StructField("start", IntegerType()), StructField("split", IntegerType())]))
def restored_place(needles: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
    """Where a text lies when blanks do not count: once on one page, else once cut over both (longest first part)."""
    flat = lambda t: re.sub(r"\s+", "", t or "")

    def place(needle, one, two):
        n, a, b = flat(needle), flat(one), flat(two)
        if n and a.count(n) + b.count(n) == 1:
            return ("first", a.index(n), None) if n in a else ("second", b.index(n), None)
        for k in range(len(n) - 1, 0, -1):
            if a.endswith(n[:k]) and b.startswith(n[k:]):
                return "both", len(a) - k, k
        return None, None, None

    return pd.DataFrame([place(*x) for x in zip(needles, first, second, strict=True)], columns=["page", "start", "split"]).astype({"start": "Int32", "split": "Int32"})


@F.pandas_udf(DoubleType())
def lexical_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """.45 characters + .30 tokens + .15 trigrams + .10 token order; 1 when equal without blanks."""

    def score(x, y):
        if x.replace(" ", "") == y.replace(" ", ""):
            return 1.0
        p, q = x.split(), y.split()
        grams = [{t[k : k + 3] for k in range(max(1, len(t) - 2))} for t in (x, y)]
        share = lambda s, t: len(s & t) / len(s | t) if s | t else 0.0
        return 0.45 * T._ratio(x, y) / 100 + 0.30 * share(set(p), set(q)) + 0.15 * share(*grams) + 0.10 * T._ratio(" ".join(sorted(p)), " ".join(sorted(q))) / 100

    return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def pair_features(pairs: DataFrame) -> DataFrame:
    """Set, order, length, rank and mutual-best features of ``(a, b, x, y, score)`` label pairs; a pair's tokens and 3-grams are made once."""
    pairs = pairs.withColumns({"_tx": T.label_tokens(F.col("x")), "_ty": T.label_tokens(F.col("y")), "_gx": T.char_grams(F.lower("x")), "_gy": T.char_grams(F.lower("y"))})
    tx, ty = F.col("_tx"), F.col("_ty")
    by_a, by_b = Window.partitionBy("a"), Window.partitionBy("b")
    rows = pairs.withColumns({
        "jaccard": T.jaccard(tx, ty), "overlap_min": T.overlap(tx, ty), "overlap_max": T.overlap(tx, ty, F.greatest), "trigram": T.jaccard(F.col("_gx"), F.col("_gy")),
        "same_first": (F.get(tx, F.lit(0)) == F.get(ty, F.lit(0))).cast("int"), "same_last": (F.try_element_at(tx, F.lit(-1)) == F.try_element_at(ty, F.lit(-1))).cast("int"), "length_ratio": F.least(F.length("x"), F.length("y")) / F.greatest(F.length("x"), F.length("y")),
        "degree_a": F.count("*").over(by_a), "degree_b": F.count("*").over(by_b), "rank_a": F.row_number().over(by_a.orderBy(F.desc("score"), "b")), "rank_b": F.row_number().over(by_b.orderBy(F.desc("score"), "a")), "gap_a": F.max("score").over(by_a) - F.col("score"),
    }).drop("_tx", "_ty", "_gx", "_gy")
    return rows.withColumn("mutual_best", ((F.col("rank_a") == 1) & (F.col("rank_b") == 1)).cast("int"))


def template_keys(c) -> F.Column:
    """Named keys of a label: whole, sorted, without title, governed place, head and tail."""
    t = T.label_tokens(c)
    titles = F.array(*map(F.lit, ("king", "queen", "prince", "lord", "minister")))
    rest = F.array_join(F.slice(t, 2, 1 << 30), " ")
    named = lambda n, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(n + ":"), v))
    place = F.regexp_extract(F.lower(c), r"(?:governor|king|lord) of (.+)$", 1)
    return F.array_compact(F.array(named("whole", F.array_join(t, " ")), named("sorted", F.array_join(F.array_sort(t), " ")), named("title", F.when(F.array_contains(titles, F.get(t, F.lit(0))), rest)), named("governor", place), named("head", F.get(t, F.lit(0))), named("tail", F.try_element_at(t, F.lit(-1))), named("singular", F.array_join(F.transform(t, T.naive_singular), " "))))


def rewritten(tokens, bigrams: dict[str, str], unigrams: dict[str, str]) -> F.Column:
    """Tokens after a variant dictionary, longest match first, left to right."""
    two = F.create_map(*[F.lit(v) for pair in bigrams.items() for v in pair]) if bigrams else F.create_map(F.lit("\0"), F.lit("\0"))
    one = F.create_map(*[F.lit(v) for pair in unigrams.items() for v in pair]) if unigrams else F.create_map(F.lit("\0"), F.lit("\0"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))

    def step(acc, w):
        pair = F.try_element_at(two, F.concat_ws(" ", acc["held"], w))
        alone = F.when(acc["held"].isNotNull(), F.array(F.coalesce(F.try_element_at(one, acc["held"]), acc["held"]))).otherwise(F.array().cast("array<string>"))
        return F.when(acc["held"].isNotNull() & pair.isNotNull(), F.struct(F.concat(acc["out"], F.array(pair)).alias("out"), F.lit(None).cast("string").alias("held"))).otherwise(F.struct(F.concat(acc["out"], alone).alias("out"), w.alias("held")))

    return F.aggregate(tokens, start, step, lambda acc: F.concat(acc["out"], F.when(acc["held"].isNotNull(), F.array(F.coalesce(F.try_element_at(one, acc["held"]), acc["held"]))).otherwise(F.array().cast("array<string>"))))


def joint_choice(candidates: DataFrame, key: str) -> DataFrame:
    """One span of each role so that their envelope, then gaps, then spread of centres are least; ties stay unresolved.

    ``candidates(key, s, p, o)`` hold arrays of ``(start, end)``. Gaps and the distances of
    centres are summed over all pairs. Combinations are made within a row only; a row with
    more than 4096 of them is unresolved, which is the rule itself.
    """
    few = candidates.where(F.size("s") * F.size("p") * F.size("o") <= 4096)
    rows = few.select(key, F.explode("s").alias("a"), "p", "o").select(key, "a", F.explode("p").alias("b"), "o").select(key, "a", "b", F.explode("o").alias("c"))
    low, high = F.least("a.start", "b.start", "c.start"), F.greatest("a.end", "b.end", "c.end")
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    gap = lambda x, y: F.greatest(F.lit(0), F.col(f"{y}.start") - F.col(f"{x}.end"), F.col(f"{x}.start") - F.col(f"{y}.end"))
    apart = lambda x, y: F.abs(F.col(f"{x}.start") + F.col(f"{x}.end") - F.col(f"{y}.start") - F.col(f"{y}.end"))
    total = lambda f: f(*pairs[0]) + f(*pairs[1]) + f(*pairs[2])
    cost = F.struct((high - low).alias("envelope"), total(gap).alias("gaps"), total(apart).alias("spread"))
    best = rows.withColumn("cost", cost).withColumn("k", F.rank().over(Window.partitionBy(key).orderBy("cost"))).where("k = 1")
    chosen = best.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("a", "b", "c")).alias("x")).where("n = 1").select(key, F.col("x.a.start").alias("s"), F.col("x.b.start").alias("p"), F.col("x.c.start").alias("o"))
    return candidates.select(key).join(chosen, key, "left").withColumn("resolved", F.col("s").isNotNull())


def similar_patterns(claims: DataFrame, vectors: DataFrame, anchor: list, floor: float, most: int = 200) -> DataFrame:
    """Category patterns by the mean over roles of the cosine of centred centroids with the anchor's; anchors left out.

    Role centroids are small aggregates; the corpus mean of each role is taken off all of them.
    """
    key, total = ["s_cat", "r_cat", "o_cat"], None
    for role in ("subject", "object"):
        rows = claims.join(vectors.select(F.col("tag").alias(role), "embedding"), role)
        corpus = centroids(rows.withColumn("all", F.lit(1)), ["all"]).select(F.col("mean").alias("base"))
        own = centroids(rows, key).join(F.broadcast(corpus)).select(*key, unit(F.zip_with("mean", "base", lambda x, y: x - y)).alias("v"))
        mine = own.where(F.struct(*key).isin([F.struct(*map(F.lit, a)) for a in anchor])).agg(F.first("v").alias("anchor"))
        sims = own.join(F.broadcast(mine)).select(*key, dot(F.col("v"), F.col("anchor")).alias(role))
        total = sims if total is None else total.join(sims, key)
    scored = total.withColumn("score", (F.col("subject") + F.col("object")) / 2)
    for a in anchor:
        scored = scored.where(~((F.col("s_cat") == a[0]) & (F.col("r_cat") == a[1]) & (F.col("o_cat") == a[2])))
    return scored.where(F.col("score") >= floor).orderBy(F.desc("score"), *key).limit(most)


def refine_until_empty(pairs: DataFrame, decide, most: int | None = None, above: float | None = None) -> DataFrame:
    """Rank disjoint pairs, decide, merge or forbid, repeat until a round accepts nothing; ``(item, cluster)``.

    ``decide(frame)`` adds ``accept``; scores of merged clusters are the best of their members'.
    A round takes the best ``most`` disjoint pairs, or all of them.

    ``above`` states that ``decide`` accepts scores above it and no others. Then the order of
    rounds changes nothing: the best open pair is in every round, so none ends them before the
    last accepted score is merged, a merged pair keeps its best score, and what is refused has no
    score above. The clusters are the components of all pairs above, found in a few rounds in
    place of one for each ``most`` merges.
    """
    open_, joined = settled(pairs.select("a", "b", "score")), None
    items = open_.select(F.col("a").alias("item")).union(open_.select("b")).distinct()
    first, passes = open_, 0
    if above is not None:
        joined = open_.where((F.col("score") > above) & (F.col("a") != F.col("b"))).select(F.col("a").alias("from"), F.col("b").alias("to"))
    while above is None:
        judged = settled(decide(greedy_disjoint(open_, most)))
        merged = judged.where("accept").select(F.greatest("a", "b").alias("from"), F.least("a", "b").alias("to"))
        if merged.isEmpty():
            break
        joined = merged if joined is None else joined.union(merged)
        moved = lambda frame, c: frame.join(merged.withColumnRenamed("from", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        left = moved(moved(open_.join(judged.select("a", "b"), ["a", "b"], "left_anti"), "a"), "b").where("a <> b")
        open_ = settled(left.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score")), *([open_] if open_ is not first else []))
        passes += 1
        if passes % 32 == 0:
            joined = settled(joined)  # one list of files in place of many
    if joined is None:
        return items.withColumn("cluster", F.col("item"))
    # a cluster has the name of its smallest member
    named = connected_components(joined, "from", "to").toDF("item", "cluster")
    return items.join(named, "item", "left").select("item", F.coalesce("cluster", "item").alias("cluster"))


def reprojected(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old annotations on the current text: same, moved page set or lost, and whether the text still agrees."""
    both = old.select(key, F.col("text").alias("t1"), F.col("pages").alias("p1")).join(new.select(key, F.col("text").alias("t2"), F.col("pages").alias("p2")), key, "left")
    state = F.when(F.col("t2").isNull(), "lost").when(F.col("t1") != F.col("t2"), "text_changed").when(F.array_sort("p1") != F.array_sort("p2"), "pages_changed").otherwise("same")
    return both.select(key, state.alias("state"))


#: Pairs of equal tokens that are looked at in one step.
PAIRS = 1 << 20


def _equal_runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, n`` of every longest run ``a[i:i + n] == b[j:j + n]``; pairs of equal tokens pass by in steps, only runs are kept."""
    order = np.argsort(b, kind="stable")
    held = b[order]
    first = np.searchsorted(held, a, "left")
    counts = np.searchsorted(held, a, "right") - first
    total, ends, at = np.cumsum(counts), ([], []), 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = counts[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = order[np.arange(n.sum()) + np.repeat(first[at:stop] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)]
        begins = (i == 0) | (j == 0) | (a[i - 1] != b[j - 1])
        closes = (i == len(a) - 1) | (j == len(b) - 1) | (a[np.minimum(i + 1, len(a) - 1)] != b[np.minimum(j + 1, len(b) - 1)])
        for kept, mask in zip(ends, (begins, closes), strict=True):
            kept.append((i[mask], j[mask]))
        at = stop
    (i, j), (p, q) = (tuple(np.concatenate(c) for c in zip(*kept, strict=True)) for kept in ends)
    here, there = np.lexsort((i, j - i)), np.lexsort((p, q - p))  # a diagonal's runs begin and close in turn
    return i[here], j[here], p[there] - i[here] + 1


def matching_blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """``(i, j, n)``: the blocks of ``difflib``'s ``get_matching_blocks`` without junk, in order; adjacent ones stay apart.

    There each stretch is searched anew for its longest block, and what lies before and behind
    it again. Here all runs are found once and taken from the longest down (ties by ``i``, then
    ``j``): one that lies within a stretch still open is its longest block, one that sticks out
    goes on with the parts that lie within open stretches.
    """
    code: dict = {}
    y = np.array([code.setdefault(t, len(code)) for t in b], np.int64)
    x = np.array([code.get(t, -1) for t in a], np.int64)
    if not len(x) or not len(y):
        return []
    i, j, n = _equal_runs(x, y)
    if not len(n):
        return []
    order = np.argsort(n, kind="stable")
    lengths, first = np.unique(n[order], return_index=True)
    waiting = {int(size): [np.stack([i[part], j[part]], 1)] for size, part in zip(lengths, np.split(order, first[1:]), strict=True)}
    alo, ahi, blo, bhi = [0], [len(x)], [0], [len(y)]  # open stretches, in order on both sides
    out = []

    def within(i: int, j: int, size: int) -> int:
        k = bisect.bisect_right(alo, i) - 1
        return k if k >= 0 and i + size <= ahi[k] and blo[k] <= j and j + size <= bhi[k] else -1

    for size in range(int(lengths[-1]), 0, -1):
        runs = np.concatenate(waiting.pop(size, [np.zeros((0, 2), np.int64)]))
        if not len(runs) or not alo:
            continue
        if size == 1:  # most are outside by now
            low, high, left, right = (np.array(c) for c in (alo, ahi, blo, bhi))
            k = np.searchsorted(low, runs[:, 0], "right") - 1
            runs = runs[(k >= 0) & (runs[:, 0] < high[k]) & (left[k] <= runs[:, 1]) & (runs[:, 1] < right[k])]
        shorter: dict = {}
        for i, j in runs[np.lexsort((runs[:, 1], runs[:, 0]))].tolist():
            k = within(i, j, size)
            if k < 0:
                k = max(0, bisect.bisect_right(alo, i) - 1)
                while k < len(alo) and alo[k] < i + size:
                    skip = max(0, alo[k] - i, blo[k] - j)
                    rest = min(size, ahi[k] - i, bhi[k] - j) - skip
                    if rest > 0:
                        shorter.setdefault(rest, []).append((i + skip, j + skip))
                    k += 1
                continue
            out.append((i, j, size))
            parts = [(alo[k], i, blo[k], j), (i + size, ahi[k], j + size, bhi[k])]
            parts = [p for p in parts if p[0] < p[1] and p[2] < p[3]]
            for at, bounds in enumerate((alo, ahi, blo, bhi)):
                bounds[k : k + 1] = [p[at] for p in parts]
        for rest, found in shorter.items():
            waiting.setdefault(rest, []).append(np.array(found, np.int64))
    return sorted(out)


def aligned_tokens(rows: DataFrame, key: str) -> DataFrame:
    """``key, pos, gloss`` for each token of ``tokens`` from the ``glosses(my, en)`` by matching blocks; extras go, gaps are null.

    Rows are dealt by hash over a set number of partitions: texts are few and small beside the
    work on them, so the files they come from would leave most cores idle.
    """

    @F.pandas_udf(ArrayType(IntegerType()))
    def align(tokens: pd.Series, given: pd.Series) -> pd.Series:
        out = []
        for own, found in zip(tokens, given, strict=True):
            hit = np.full(len(own), -1, np.int32)
            for i, j, n in matching_blocks(list(own), list(found)):
                hit[i : i + n] = np.arange(j, j + n)
            out.append(hit)
        return pd.Series(out)

    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    met = dealt.select(key, "glosses", align("tokens", F.col("glosses.my")).alias("hit"))
    return met.select(key, F.inline(F.transform("hit", lambda k, pos: F.struct(pos.alias("pos"), F.when(k >= 0, F.get("glosses.en", k)).alias("gloss")))))


@query("j11_nearest_assignment")
def j11(spark, d):
    e = table(spark, d, "events")
    lines = e.where("event_id % 2 = 0").selectExpr("user_id % 30 as page", "event_id as line", "(event_id * 37) % 900 as y")
    return nearest_assignment(lines, e.where("event_id % 2 <> 0").selectExpr("user_id % 30 as page", "event_id as entry", "(event_id * 53) % 900 as y"), "page")


_J13 = r""", l AS (SELECT sid, page, lower(string_split(text, chr(10))[1]) AS t FROM sentences),
  g AS (SELECT sid, page, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_slice(c, i, i + 2)::VARCHAR)) WHEN len(t) > 0 THEN [c::VARCHAR] ELSE []::VARCHAR[] END AS g FROM (SELECT *, string_split(t, '') AS c FROM l) z),
  p AS (SELECT a.sid AS title_id, b.sid AS heading_id, CASE WHEN len(a.g) + len(b.g) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) END AS sim FROM g a JOIN g b ON a.sid % 3 = 0 AND b.sid % 3 = 1 AND abs(a.page - b.page) <= 1)
  SELECT title_id, heading_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY sim DESC, heading_id) AS k FROM p) x WHERE k = 1"""


@query("j13_best_title", oracle(_J13, "sentences"))
def j13(spark, d):
    """A text's first line is its title or heading: every third text is a title, every third a heading."""
    s = view(spark, d, "sentences").select("sid", "page", F.split("text", "\n")[0].alias("line"))
    titles = s.where("sid % 3 = 0").selectExpr("sid as title_id", "page", "line as title")
    return best_title(titles, s.where("sid % 3 = 1").selectExpr("sid as heading_id", "page", "line as heading")).withColumn("sim", F.round("sim", 6))


@query("j19_theta_top", oracle(", p AS (SELECT claim_id AS a, sid AS b, (claim_id % 71) / 71.0 AS tok, (claim_id % 53) / 53.0 AS tri, (claim_id % 97) / 97.0 AS cos, (claim_id % 31) / 31.0 AS char FROM claims) SELECT a, b, round(0.5 * (0.45 * char + 0.4 * tok + 0.15 * tri) + 0.5 * cos, 6) AS score FROM p ORDER BY 0.5 * (0.45 * char + 0.4 * tok + 0.15 * tri) + 0.5 * cos DESC, a, b LIMIT 50", "claims"))
def j19(spark, d):
    pairs = view(spark, d, "claims").selectExpr("claim_id as a", "sid as b", "claim_id % 71 / 71 as tok", "claim_id % 53 / 53 as tri", "claim_id % 97 / 97 as cos", "claim_id % 31 / 31 as char")
    return theta_top(pairs, 50).withColumn("score", F.round("score", 6))


@query("j25_subsequence_merge")
def j25(spark, d):
    c = view(spark, d, "claims").select("sid", "ordinal", F.col("relation").alias("text"))
    return subsequence_merge(c.where("ordinal % 2 = 0"), c, "sid")


@query("j26_restored_place")
def j26(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("t2"))
    needle = F.concat(F.right("text", F.lit(12)), F.left("t2", F.lit(12)))
    return docs.join(nxt, "doc_id").select("doc_id", restored_place(needle, "text", "t2").alias("p")).select("doc_id", "p.*")


@query("j27_reprojection", oracle("SELECT claim_id, CASE WHEN claim_id % 13 = 0 THEN 'lost' WHEN claim_id % 11 = 0 THEN 'text_changed' WHEN claim_id % 7 = 0 THEN 'pages_changed' ELSE 'same' END AS state FROM claims", "claims"))
def j27(spark, d):
    c = view(spark, d, "claims")
    old = c.select("claim_id", F.col("relation").alias("text"), F.array("page").alias("pages"))
    new = c.where("claim_id % 13 <> 0").select("claim_id", F.when(F.col("claim_id") % 11 == 0, "other").otherwise(F.col("relation")).alias("text"), F.when(F.col("claim_id") % 7 == 0, F.array("page", F.lit(0))).otherwise(F.array("page")).alias("pages"))
    return reprojected(old, new, "claim_id")


@query("j28_member_grain", oracle("SELECT s_cat AS cluster, subject AS member, count(*) AS mentions, min(page) AS first_page FROM claims GROUP BY ALL", "claims"))
def j28(spark, d):
    c = view(spark, d, "claims")
    clusters = c.groupBy(F.col("s_cat").alias("cluster")).agg(F.collect_set("subject").alias("members"))
    members = clusters.select("cluster", F.explode("members").alias("member"))
    facts = c.groupBy(F.col("subject").alias("member"), F.col("s_cat").alias("cluster")).agg(F.count("*").alias("mentions"), F.min("page").alias("first_page"))
    return members.join(facts, ["cluster", "member"])


@query("t09_similar_patterns")
def t09(spark, d):
    claims, vectors = view(spark, d, "claims"), view(spark, d, "vectors")
    return similar_patterns(claims, vectors, [("E1", "R1", "E2")], -1.0, 50).select("s_cat", "r_cat", "o_cat", F.round("score", 5).alias("score"))


_X07 = r"""WITH l AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'King of ' || p_name WHEN 1 THEN 'Lord ' || p_name ELSE p_name END AS label FROM part),
  t AS (SELECT lower(label) AS low, list_filter(string_split(trim(regexp_replace(lower(label), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM l),
  k AS (SELECT unnest(['whole:' || array_to_string(t, ' '), 'sorted:' || array_to_string(list_sort(t), ' '), CASE WHEN t[1] IN ('king', 'queen', 'prince', 'lord', 'minister') THEN 'title:' || array_to_string(t[2:], ' ') END,
    CASE WHEN regexp_extract(low, '(?:governor|king|lord) of (.+)$', 1) <> '' THEN 'governor:' || regexp_extract(low, '(?:governor|king|lord) of (.+)$', 1) END, 'head:' || t[1], 'tail:' || t[-1],
    'singular:' || array_to_string(list_transform(t, lambda w: CASE WHEN w LIKE '%ies' THEN left(w, len(w) - 3) || 'y' WHEN regexp_matches(w, '(ss|us|is)$') THEN w WHEN regexp_matches(w, '(ch|sh|x|z)es$') THEN left(w, len(w) - 2) WHEN w LIKE '%s' THEN left(w, len(w) - 1) ELSE w END), ' ')]) AS key FROM t)
  SELECT DISTINCT key FROM k WHERE key IS NOT NULL"""


@query("x07_template_keys", _X07)
def x07(spark, d):
    k = F.col("p_partkey")
    label = F.when(k % 3 == 0, F.concat(F.lit("King of "), "p_name")).when(k % 3 == 1, F.concat(F.lit("Lord "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.explode(template_keys(label)).alias("key")).distinct()


@query("x08_variant_rewrite", r"SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(' ' || array_to_string(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')), ' '), lambda x: x <> ''), ' ') || ' ', ' blue steel ', ' bluesteel ')), ' '), lambda t: CASE t WHEN 'red' THEN 'crimson' ELSE t END), ' ') AS name FROM part")
def x08(spark, d):
    t = T.label_tokens(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(rewritten(t, {"blue steel": "bluesteel"}, {"red": "crimson"}), " ").alias("name"))


_X15 = """WITH c AS (SELECT o_orderkey AS k, unnest([0, 1, 2]) AS i FROM orders), s AS (SELECT k, (k * 3 + i * 37) % 300 AS a FROM c), p AS (SELECT k, (k * 7 + i * 37) % 300 AS b FROM c), o AS (SELECT k, (k * 11 + i * 37) % 300 AS c FROM c),
  x AS (SELECT s.k, a, b, c, greatest(a, b, c) - least(a, b, c) AS e, greatest(0, abs(a - b) - 5) + greatest(0, abs(a - c) - 5) + greatest(0, abs(b - c) - 5) AS g, abs(a - b) + abs(a - c) + abs(b - c) AS d FROM s JOIN p ON p.k = s.k JOIN o ON o.k = s.k),
  r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY e, g, d) AS n FROM x), u AS (SELECT k, min(a) AS s, min(b) AS p, min(c) AS o FROM r WHERE n = 1 GROUP BY k HAVING count(*) = 1)
  SELECT q.o_orderkey AS claim_id, u.s, u.p, u.o, u.s IS NOT NULL AS resolved FROM orders q LEFT JOIN u ON u.k = q.o_orderkey"""


@query("x15_joint_choice", _X15)
def x15(spark, d):
    span = lambda k: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(((F.col("claim_id") * k + i * 37) % 300).alias("start"), ((F.col("claim_id") * k + i * 37) % 300 + 5).alias("end")))
    return joint_choice(view(spark, d, "claims").select("claim_id", span(3).alias("s"), span(7).alias("p"), span(11).alias("o")), "claim_id")


def _label_pairs(spark, d):
    """Parts with the parts of the next three numbers; each meets them by equality."""
    p = table(spark, d, "part")
    near = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"), F.explode(F.array(*[F.col("p_partkey") + k for k in (1, 2, 3)])).alias("b"))
    return near.join(p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y")), "b").select("a", "x", "b", "y").withColumn("score", F.pmod(F.col("a") * F.col("b"), F.lit(101)) / 101)


@query("x17_lexical_score")
def x17(spark, d):
    return _label_pairs(spark, d).select("a", "b", F.round(lexical_score("x", "y"), 6).alias("score"))


_X21 = r"""WITH n AS (SELECT p_partkey AS k, p_name AS name, list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')), ' '), lambda x: x <> '') AS t,
    CASE WHEN len(p_name) >= 3 THEN list_distinct(list_transform(range(1, len(p_name) - 1), lambda i: substr(lower(p_name), i, 3))) ELSE [lower(p_name)] END AS g FROM part),
  p AS (SELECT x.k AS a, y.k AS b, (x.k * y.k % 101) / 101::DOUBLE AS score, x.t AS tx, y.t AS ty, x.g AS gx, y.g AS gy, len(x.name) AS lx, len(y.name) AS ly FROM n x JOIN n y ON y.k BETWEEN x.k + 1 AND x.k + 3),
  f AS (SELECT a, b, score, len(list_intersect(tx, ty))::DOUBLE / len(list_distinct(list_concat(tx, ty))) AS jaccard, len(list_intersect(tx, ty))::DOUBLE / least(len(list_distinct(tx)), len(list_distinct(ty))) AS overlap_min, len(list_intersect(tx, ty))::DOUBLE / greatest(len(list_distinct(tx)), len(list_distinct(ty))) AS overlap_max,
    len(list_intersect(gx, gy))::DOUBLE / len(list_distinct(list_concat(gx, gy))) AS trigram, CAST(tx[1] = ty[1] AS INT) AS same_first, CAST(tx[-1] = ty[-1] AS INT) AS same_last, least(lx, ly)::DOUBLE / greatest(lx, ly) AS length_ratio,
    count(*) OVER (PARTITION BY a) AS degree_a, count(*) OVER (PARTITION BY b) AS degree_b, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank_a, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rank_b, max(score) OVER (PARTITION BY a) - score AS gap_a FROM p)
  SELECT *, CAST(rank_a = 1 AND rank_b = 1 AS INT) AS mutual_best FROM f"""


@query("x21_pair_features", _X21)
def x21(spark, d):
    return pair_features(_label_pairs(spark, d)).drop("x", "y")


@query("v06_refinement")
def v06(spark, d):
    pairs = view(spark, d, "claims").where("subject <> object").groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.max("score").alias("score"))
    return refine_until_empty(pairs, lambda f: f.withColumn("accept", F.col("score") > 300000), 1000, above=300000)


@query("v12_token_alignment")
def v12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    glosses = F.transform(F.filter("tokens", lambda t, i: i % 4 != 1), lambda t: F.struct(t.alias("my"), F.upper(t).alias("en")))
    return aligned_tokens(docs.withColumn("glosses", glosses), "doc_id")


@query("a27_membership_product", oracle(", m AS (SELECT DISTINCT subject, s_cat FROM claims), n AS (SELECT s_cat, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM m JOIN vectors v ON v.tag = m.subject) SELECT s_cat, round(sqrt(sum(s * s)), 4) AS length FROM (SELECT s_cat, k, sum(x) AS s FROM n GROUP BY s_cat, k) q GROUP BY s_cat", "claims", "vectors"))
def a27(spark, d):
    m = view(spark, d, "claims").select(F.col("subject").alias("tag"), "s_cat").distinct().join(view(spark, d, "vectors").select("tag", "embedding"), "tag")
    sums = m.select("s_cat", F.posexplode("embedding").alias("k", "x")).groupBy("s_cat", "k").agg(F.sum(F.col("x").cast("double")).alias("s"))
    return sums.groupBy("s_cat").agg(F.round(norm(F.collect_list("s")), 4).alias("length"))


@query("f23_warning_filter", oracle("SELECT claim_id, CASE WHEN claim_id % 3 = 0 THEN 'valid' ELSE 'invalid' END AS bucket FROM claims", "claims"))
def f23(spark, d):
    warnings = F.when(F.col("claim_id") % 3 == 0, F.array(F.lit("T[1].s: inferred"), F.lit("T[2].o: inferred"))).otherwise(F.array(F.lit("T[1].s: inferred"), F.lit("empty predicate")))
    left = F.filter(warnings, lambda w: ~w.rlike(r"^T\[[0-9]+\]\.[so]:"))
    return view(spark, d, "claims").select("claim_id", F.when(F.size(left) == 0, "valid").otherwise("invalid").alias("bucket"))


@query("f24_ranked_export", oracle("SELECT claim_id, row_number() OVER (PARTITION BY volume ORDER BY score DESC, claim_id) AS rank, score >= 400000 AS automatic FROM claims", "claims"))
def f24(spark, d):
    w = Window.partitionBy("volume").orderBy(F.desc("score"), "claim_id")
    return view(spark, d, "claims").select("claim_id", F.row_number().over(w).cast("long").alias("rank"), (F.col("score") >= 400000).alias("automatic"))
