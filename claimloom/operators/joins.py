"""Interval, band, as-of, blocking-key and similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions.vectors import unit
from claimloom.model import oracle, table, view
from claimloom.registry import query


def _buckets(start, end, size: int):
    """Numbers of the ``size``-wide buckets that a span touches; none for an empty span."""
    return F.when(F.col(end) > F.col(start), F.sequence(F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size))).otherwise(F.array().cast("array<bigint>"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Pairs of spans of the same keys that overlap, once for each bucket that both touch; the right span is ``_s`` to ``_e``.

    Both sides go to the buckets they touch, so a pair meets by equality and a key with many
    spans makes only the pairs of its buckets.
    """
    l = left.withColumn("_b", F.explode(_buckets("start", "end", size)))
    r = right.withColumn("_b", F.explode(_buckets("_s", "_e", size)))
    return l.join(r, [*keys, "_b"]).where((F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e"))).drop("_b")


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, bucket: int = 64) -> DataFrame:
    """For each left span the right span of the same keys with the most overlap, else the nearest, ties to the smaller id.

    Both sides hold ``start`` and ``end``; the result names its ``method``. Overlaps meet in
    buckets of ``bucket``; a span that overlaps none lies between two right spans, which running
    maxima and minima over the key's ordered ends find. Spans of keys without right ones go.
    """
    r = right.select(*keys, F.col(right_id), F.col("start").alias("_s"), F.col("end").alias("_e"))
    own = left.select(*keys, left_id, "start", "end")
    shared = F.least("end", "_e") - F.greatest("start", "_s")
    met = overlapping(own, r, keys, bucket).groupBy(*keys, left_id).agg(F.min_by(F.struct(F.col(right_id), shared.alias("overlap"), F.lit(0).cast("bigint").alias("distance")), F.struct(-shared, F.col(right_id))).alias("b"))
    alone = own.join(met.select(*keys, left_id), [*keys, left_id], "left_anti")
    none = F.lit(None)
    kinds = {c: right.schema[c].dataType for c in (right_id,)} | {left_id: left.schema[left_id].dataType}
    side = lambda f, at, order: f.select(*keys, at.alias("_at"), F.lit(order).alias("_kind"), *(F.col(c) if c in f.columns else none.cast(t).alias(c) for c, t in kinds.items()), *(F.col(c).cast("bigint").alias(c) if c in f.columns else none.cast("bigint").alias(c) for c in ("start", "end", "_s", "_e")))
    up = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ended = side(r, F.col("_e"), 0).union(side(alone, F.col("start"), 1))
    ended = ended.withColumn("_near", F.max(F.when(F.col("_kind") == 0, F.struct(F.col("_e").alias("e"), (-F.col(right_id)).alias("i")))).over(up)).where("_kind = 1")
    begun = side(r, F.col("_s"), 0).union(side(alone, F.col("end"), 1))
    begun = begun.withColumn("_near", F.min(F.when(F.col("_kind") == 0, F.struct(F.col("_s").alias("s"), F.col(right_id).alias("i")))).over(down)).where("_kind = 1")
    close = ended.select(*keys, left_id, F.struct((F.col("start") - F.col("_near.e")).alias("distance"), (-F.col("_near.i")).alias("i")).alias("c"), F.col("_near").isNotNull().alias("ok"))
    close = close.union(begun.select(*keys, left_id, F.struct((F.col("_near.s") - F.col("end")).alias("distance"), F.col("_near.i").alias("i")).alias("c"), F.col("_near").isNotNull().alias("ok"))).where("ok")
    nearest = close.groupBy(*keys, left_id).agg(F.min("c").alias("c")).select(*keys, left_id, F.col("c.i").alias(right_id), F.lit(0).cast("bigint").alias("overlap"), "c.distance", F.lit("nearest_source_span").alias("method"))
    return met.select(*keys, left_id, f"b.{right_id}", F.col("b.overlap").cast("bigint").alias("overlap"), "b.distance", F.lit("maximum_evidence_overlap").alias("method")).unionByName(nearest)


def contained_or_first(candidates: DataFrame, spans: DataFrame, key: str, candidate_id: str, bucket: int = 64) -> DataFrame:
    """For each span the first candidate inside it, else the first candidate of its key; spans of keys without candidates go.

    Candidates meet the spans that touch the bucket of their start; the first of a key is one row a key.
    """
    c = candidates.select(key, candidate_id, F.col("start").alias("_s"), F.col("end").alias("_e"))
    first = c.groupBy(key).agg(F.min_by(candidate_id, F.struct("_s", F.col(candidate_id))).alias("_first"))
    met = spans.withColumn("_b", F.explode(_buckets("start", "end", bucket))).join(c.withColumn("_b", F.floor(F.col("_s") / bucket)), [key, "_b"]).where("_s >= start and _e <= `end`")
    inner = met.groupBy(*spans.columns).agg(F.min_by(candidate_id, F.struct("_s", F.col(candidate_id))).alias("_in"))
    rows = spans.join(first, key).join(inner, spans.columns, "left")
    return rows.select(*spans.columns, F.coalesce("_in", "_first").alias(candidate_id), F.col("_in").isNotNull().alias("inside"))


def band_join(left: DataFrame, right: DataFrame, key: str, at: str, reach: int) -> DataFrame:
    """Pairs of one key whose ``at`` differ by at most ``reach``.

    Rows meet on (key, at div (reach + 1)); the left side is copied to three neighbouring
    buckets, so the join stays an equi-join whatever the key's size.
    """
    size = reach + 1
    l = left.withColumn("_b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col(at) / size) + k)))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_rb", F.floor(F.col(f"r_{at}") / size))
    return l.join(r, (F.col(key) == F.col(f"r_{key}")) & (F.col("_b") == F.col("_rb")) & (F.abs(F.col(at) - F.col(f"r_{at}")) <= reach)).drop("_b", "_rb")


def fill_gaps(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Missing values from the previous known one plus the steps since, else the next less the steps to it."""
    w = Window.partitionBy(key).orderBy(order)
    # a frame up to the end of a key is read anew for each row: the way back is a running frame in the other order
    back, ahead = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (w, Window.partitionBy(key).orderBy(F.desc("_n"))))
    rows = rows.withColumn("_n", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.col(value) - F.col("_n"))
    filled = F.coalesce(F.col(value), F.last(known, True).over(back) + F.col("_n"), F.last(known, True).over(ahead) + F.col("_n"))
    return rows.withColumn("filled", filled).drop("_n")


def blocking_pairs(rows: DataFrame, item: str, keys, most: int) -> DataFrame:
    """Distinct ``a < b`` pairs that share a blocking key of at most ``most`` members.

    The cap is the operator's own rule (larger groups are too unspecific to be evidence).
    """
    exploded = rows.select(item, F.explode(keys).alias("key")).where("key is not null and key <> ''").distinct()
    size = exploded.groupBy("key").agg(F.count("*").alias("n")).where(f"n between 2 and {most}").select("key")
    kept = exploded.join(size, "key")
    pairs = kept.select("key", F.col(item).alias("a")).join(kept.select("key", F.col(item).alias("b")), "key").where("a < b")
    return pairs.groupBy("a", "b").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def deletion_keys(c) -> F.Column:
    """The text and all texts one deletion away, for 6 to 60 characters; one-edit neighbours share one."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1, F.length(c))))
    return F.when(F.length(c).between(6, 60), F.array_distinct(F.array_append(cut, c))).otherwise(F.array().cast("array<string>"))


def rare_gram_pairs(rows: DataFrame, item: str, text: str, least: int = 2, most: int = 80, rarest: int = 10, floor: float = 0.12, keep: int = 20) -> DataFrame:
    """Similar pairs by their ``rarest`` character 3-grams found in ``least`` to ``most`` records.

    Jaccard of those grams of at least ``floor``, the best ``keep`` partners of each record.
    The gram's frequency bound also bounds what any one join key can produce.
    """
    grams = rows.select(item, F.explode(T.char_grams(F.lower(text))).alias("g")).distinct()
    df = grams.groupBy("g").agg(F.count("*").alias("df")).where(F.col("df").between(least, most))
    ranked = grams.join(df, "g").withColumn("k", F.row_number().over(Window.partitionBy(item).orderBy("df", "g"))).where(F.col("k") <= rarest)
    sizes = ranked.groupBy(item).agg(F.count("*").alias("n"))
    left, right = ranked.select("g", F.col(item).alias("a")), ranked.select("g", F.col(item).alias("b"))
    shared = left.join(right, "g").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    scored = shared.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").withColumn("score", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    best = scored.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))
    return best.where(F.col("rank") <= keep).select("a", "b", "shared", "score", "rank")


def nearest_in_block(a, b, k: int, places: int | None = None):
    """``a, b, sim``: the ``k`` rows of ``b(j, w)`` nearest to each row of ``a(i, v)`` but itself, by unit vectors; ties to the smaller id.

    ``a`` may have a column ``no`` with the ids that are no partners of a row. Cosines are rounded to ``places``, if given.
    """
    import numpy as np
    import pandas as pd

    if not len(a) or not len(b):
        return pd.DataFrame({"a": a["i"][:0], "b": b["j"][:0], "sim": np.zeros(0)})
    b = b.sort_values("j", kind="stable")
    ids, others = a["i"].to_numpy(), b["j"].to_numpy()
    m, out = np.stack(b["w"]), []
    groups = len(others) // 32
    for at in range(0, len(a), 256):
        sim = np.stack(a["v"][at : at + 256]) @ m.T
        sim[(ids[at : at + 256, None] == others[None])] = -np.inf
        sim[np.isnan(sim)] = -np.inf
        if "no" in a and (held := [(row, no) for row, no in enumerate(a["no"][at : at + 256]) if no is not None and len(no)]):
            row, no = np.repeat([r for r, _ in held], [len(x) for _, x in held]), np.concatenate([x for _, x in held])
            place = np.minimum(np.searchsorted(others, no), len(others) - 1)
            there = others[place] == no
            sim[row[there], place[there]] = -np.inf
        if groups > k:  # the k-th best of the groups' maxima is no more than the k-th best of all
            most = sim[:, : groups * 32].reshape(len(sim), groups, 32).max(2)
            floor = np.partition(most, groups - k, 1)[:, groups - k, None] - (0 if places is None else 10.0**-places)
            row, place = np.nonzero(sim >= floor)
        else:
            row, place = np.nonzero(np.isfinite(sim))
        found = sim[row, place] if places is None else np.round(sim[row, place], places)
        order = np.lexsort((place, -found, row))
        row, place, found = row[order], place[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        ok = (rank < k) & np.isfinite(found)
        out.append(pd.DataFrame({"a": ids[at + row[ok]], "b": others[place[ok]], "sim": found[ok]}))
    return pd.concat(out)


def cosine_neighbours(vectors: DataFrame, item: str, k: int, block: int | None = None, every: int = 1) -> DataFrame:
    """Exact ``k`` nearest other items by cosine of each item whose id is divisible by ``every``.

    Items are dealt into blocks; each pair of blocks is one task with one matrix product and
    hands on ``k`` rows an item, so memory is two blocks and the shuffle carries candidates only.
    A block holds about a million components, 1,024 to 16,384 items: each item is sent to as
    many tasks as there are blocks, so fewer blocks send less.
    """
    n, width = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n // (block or min(16_384, max(1024, (1 << 20) // max(1, width or 1))))))
    deal = F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    unit_rows = vectors.select(F.col(item).alias("i"), unit(F.col("embedding")).alias("v"), deal.alias("own"))
    asked = unit_rows.where(F.col("i") % every == 0) if every > 1 else unit_rows
    left = asked.select("i", "v", F.col("own").alias("l"), spread.alias("r"))
    right = unit_rows.select(F.col("i").alias("j"), F.col("v").alias("w"), spread.alias("l"), F.col("own").alias("r"))
    kind = vectors.schema[item].dataType.simpleString()
    met = left.groupBy("l", "r").cogroup(right.groupBy("l", "r")).applyInPandas(lambda a, b: nearest_in_block(a, b, k), f"a {kind}, b {kind}, sim double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    return ranked.where(F.col("rank") <= k)


def fused_candidates(one: DataFrame, two: DataFrame, keep: int = 20) -> DataFrame:
    """Union of two pools of ``(a, b, emb, char)`` scores ranked by their mean; ties by char, emb, then id.

    Rows are dealt by ``a`` before they are merged: pairs seldom repeat, and merging them where
    they are read would hold all the pairs of a file in one task.
    """
    pool = one.unionByName(two).repartition("a").groupBy("a", "b").agg(F.max("emb").alias("emb"), F.max("char").alias("char"))
    order = Window.partitionBy("a").orderBy(F.desc(0.5 * F.col("emb") + 0.5 * F.col("char")), F.desc("char"), F.desc("emb"), "b")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def without_cannot_links(pairs: DataFrame, members: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of clusters none of whose source pairs was rejected; ``members(cluster, source)``, ``rejected(x, y)``."""
    both = rejected.select("x", "y").union(rejected.select("y", "x"))
    mapped = both.join(members.toDF("a", "x"), "x").join(members.toDF("b", "y"), "y").select("a", "b").distinct()
    return pairs.join(mapped, ["a", "b"], "left_anti")


def neighbourhood(ends: DataFrame, tag: str, depth: int = 1, limit: int = 600, fan: int = 160) -> DataFrame:
    """Claims within ``depth`` hops of a tag: the first hop has half the budget, ``fan`` sorted neighbours go on."""
    order = ["volume", "page", "claim_id"]
    first = ends.where(F.col("tag") == tag).dropDuplicates(["claim_id"]).orderBy(*order).limit(limit // 2 if depth > 1 else limit).withColumn("hop", F.lit(1))
    if depth < 2:
        return first
    reached = first.select(F.col("other").alias("tag")).where(F.col("tag") != tag).distinct().orderBy("tag").limit(fan)
    second = ends.join(F.broadcast(reached), "tag", "left_semi").join(first.select("claim_id"), "claim_id", "left_anti").dropDuplicates(["claim_id"])
    return first.unionByName(second.orderBy(*order).limit(limit - limit // 2).withColumn("hop", F.lit(2)))


# spans of the test tables: views and clicks are claims, all other events evidence ------------
SPANS = "SELECT event_id, user_id AS page, (event_id * 37) % 900 AS start, (event_id * 37) % 900 + 5 + event_id % 60 AS end_ FROM events WHERE event_type {which} ('view', 'click')"


def _spans(spark, d, which, name):
    rows = spark.sql(SPANS.format(which=which).replace("FROM events", "FROM {e}"), e=table(spark, d, "events"))
    return rows.withColumnRenamed("end_", "end").withColumnRenamed("event_id", name)


_J08 = f"""WITH l AS ({SPANS.format(which="IN")}), r AS ({SPANS.format(which="NOT IN")}), p AS (
  SELECT l.page, l.event_id AS claim, r.event_id AS sentence, greatest(0, least(l.end_, r.end_) - greatest(l.start, r.start)) AS overlap,
    greatest(0, greatest(l.start, r.start) - least(l.end_, r.end_)) AS distance FROM l JOIN r USING (page)),
q AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY overlap DESC, distance, sentence) AS k FROM p)
SELECT page, claim, sentence, overlap, distance, CASE WHEN overlap > 0 THEN 'maximum_evidence_overlap' ELSE 'nearest_source_span' END AS method FROM q WHERE k = 1"""


@query("j08_best_overlap", _J08)
def j08(spark, d):
    return best_overlap(_spans(spark, d, "IN", "claim"), _spans(spark, d, "NOT IN", "sentence"), ["page"], "claim", "sentence")


_J09 = f"""WITH l AS ({SPANS.format(which="IN")}), r AS ({SPANS.format(which="NOT IN")}), p AS (
  SELECT l.event_id AS claim, r.event_id AS mention, r.start >= l.start AND r.end_ <= l.end_ AS inside, r.start FROM l JOIN r USING (page)),
q AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY NOT inside, start, mention) AS k FROM p)
SELECT claim, mention, inside FROM q WHERE k = 1"""


@query("j09_contained_or_first", _J09)
def j09(spark, d):
    return contained_or_first(_spans(spark, d, "NOT IN", "mention"), _spans(spark, d, "IN", "claim"), "page", "mention").select("claim", "mention", "inside")


@query(
    "j10_gap_fill",
    """WITH e AS (SELECT event_id % 20 AS grp, event_id, row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id) AS n, CASE WHEN event_id % 7 = 3 THEN user_id END AS printed FROM events),
    k AS (SELECT *, last_value(printed - n IGNORE NULLS) OVER (PARTITION BY grp ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS b,
      first_value(printed - n IGNORE NULLS) OVER (PARTITION BY grp ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM e)
    SELECT grp, event_id, coalesce(printed, b + n, a + n) AS filled FROM k""",
)
def j10(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") % 20).alias("grp"), "event_id", F.when(F.col("event_id") % 7 == 3, F.col("user_id")).alias("printed"))
    return fill_gaps(rows, "grp", "event_id", "printed").select("grp", "event_id", "filled")


@query("j12_band_pages", oracle("SELECT a.claim_id, b.claim_id AS near_id FROM claims a JOIN claims b ON a.volume = b.volume AND abs(a.page - b.page) <= 8 AND a.sid <> b.sid WHERE a.subject = 'n7' AND b.object = 'n9'", "claims"))
def j12(spark, d):
    claims = view(spark, d, "claims").select("claim_id", "sid", "volume", "page", "subject", "object")
    met = band_join(claims.where("subject = 'n7'"), claims.where("object = 'n9'"), "volume", "page", 8)
    return met.where("sid <> r_sid").select("claim_id", F.col("r_claim_id").alias("near_id"))


@query(
    "j14_blocking_keys",
    """WITH k AS (SELECT DISTINCT c_custkey, unnest(['n' || c_nationkey || c_mktsegment || CAST(floor(c_acctbal / 50) AS INT), 's' || right(c_name, 2) || c_mktsegment || c_nationkey]) AS key FROM customer),
    s AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 100)
    SELECT a.c_custkey AS a, b.c_custkey AS b, string_agg(a.key, '+' ORDER BY a.key) AS keys FROM k a JOIN k b ON a.key = b.key AND a.c_custkey < b.c_custkey SEMI JOIN s ON a.key = s.key GROUP BY 1, 2""",
)
def j14(spark, d):
    keys = F.array(F.concat(F.lit("n"), "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 50).cast("int")), F.concat(F.lit("s"), F.right("c_name", F.lit(2)), "c_mktsegment", "c_nationkey"))
    return blocking_pairs(table(spark, d, "customer"), "c_custkey", keys, 100).withColumn("keys", F.array_join("keys", "+"))


@query(
    "j15_one_edit",
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,12}')) AS word FROM documents),
    k AS (SELECT DISTINCT word, unnest(list_append(list_transform(range(1, len(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)), word)) AS key FROM w),
    s AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 100)
    SELECT DISTINCT a.word AS a, b.word AS b FROM k a JOIN k b ON a.key = b.key AND a.word < b.word SEMI JOIN s ON a.key = s.key""",
)
def j15(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,12}"), F.lit(0))).alias("word")).distinct()
    return blocking_pairs(words, "word", deletion_keys(F.col("word")), 100).select("a", "b")


@query(
    "j16_rare_grams",
    """WITH g AS (SELECT DISTINCT p_partkey AS item, unnest(list_transform(range(1, len(p_name) - 1), lambda i: substr(lower(p_name), i, 3))) AS g FROM part),
    f AS (SELECT g, count(*) AS df FROM g GROUP BY g HAVING count(*) BETWEEN 2 AND 80),
    k AS (SELECT item, g FROM (SELECT g.*, row_number() OVER (PARTITION BY item ORDER BY df, g.g) AS k FROM g JOIN f ON g.g = f.g) x WHERE k <= 10),
    n AS (SELECT item, count(*) AS n FROM k GROUP BY item),
    s AS (SELECT x.item AS a, y.item AS b, count(*) AS shared FROM k x JOIN k y ON x.g = y.g AND x.item <> y.item GROUP BY 1, 2),
    r AS (SELECT s.*, shared::DOUBLE / (u.n + v.n - shared) AS score FROM s JOIN n u ON u.item = s.a JOIN n v ON v.item = s.b)
    SELECT a, b, shared, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM r WHERE score >= 0.12) x WHERE rank <= 20""",
)
def j16(spark, d):
    return rare_gram_pairs(table(spark, d, "part"), "p_partkey", "p_name").select(F.col("a"), F.col("b"), "shared", "score", "rank")


_NEAR = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query("j17_cosine_neighbours", f"SELECT a, b, sim FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_NEAR} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) x WHERE k <= 15")
def j17(spark, d):
    return cosine_neighbours(table(spark, d, "embeddings"), "vec_id", 15).select("a", "b", F.round("sim", 6).alias("sim"))


@query(
    "j21_fused_candidates",
    """WITH p AS (SELECT c_custkey AS a, (c_custkey * k) % 101 AS b, ((c_custkey * 13 + k * 7) % 100) / 100.0 AS emb, ((c_custkey * 5 + k * 11) % 100) / 100.0 AS char FROM customer, range(1, 61) r(k)),
    q AS (SELECT a, b, max(emb) AS emb, max(char) AS char FROM p GROUP BY a, b)
    SELECT a, b, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY 0.5 * emb + 0.5 * char DESC, char DESC, emb DESC, b) AS rank FROM q) x WHERE rank <= 20""",
)
def j21(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(60))).alias("k"))
    rows = base.selectExpr("a", "k", "(a * k) % 101 as b", "cast((a * 13 + k * 7) % 100 as decimal(5,1)) / 100 as emb", "cast((a * 5 + k * 11) % 100 as decimal(5,1)) / 100 as char")
    return fused_candidates(rows.where("k <= 30").drop("k"), rows.where("k > 30").drop("k")).select("a", "b", "rank")


@query("j22_cannot_link", "WITH p AS (SELECT a.c_nationkey AS a, b.c_nationkey AS b FROM (SELECT DISTINCT c_nationkey FROM customer) a JOIN (SELECT DISTINCT c_nationkey FROM customer) b ON a.c_nationkey < b.c_nationkey), r AS (SELECT c_custkey AS x, c_custkey + 1 AS y FROM customer WHERE c_custkey % 10 = 0), m AS (SELECT x.c_nationkey AS a, y.c_nationkey AS b FROM r JOIN customer x ON x.c_custkey = r.x JOIN customer y ON y.c_custkey = r.y) SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE (m.a = p.a AND m.b = p.b) OR (m.a = p.b AND m.b = p.a))")
def j22(spark, d):
    customer = table(spark, d, "customer")
    nations = customer.select("c_nationkey").distinct()
    pairs = nations.toDF("a").join(nations.toDF("b"), F.col("a") < F.col("b"))
    rejected = customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("x"), (F.col("c_custkey") + 1).alias("y"))
    return without_cannot_links(pairs, customer.select("c_nationkey", "c_custkey"), rejected)


@query(
    "j23_two_hops",
    oracle(
        """, f AS (SELECT DISTINCT ON (claim_id) * FROM ends WHERE tag = 'n7' ORDER BY claim_id), f1 AS (SELECT * FROM f ORDER BY volume, page, claim_id LIMIT 60),
    r AS (SELECT DISTINCT other AS tag FROM f1 WHERE other <> 'n7' ORDER BY tag LIMIT 20),
    s AS (SELECT DISTINCT claim_id, volume, page FROM ends WHERE tag IN (SELECT tag FROM r) AND claim_id NOT IN (SELECT claim_id FROM f1))
    SELECT claim_id, 1 AS hop FROM f1 UNION ALL SELECT claim_id, 2 FROM (SELECT * FROM s ORDER BY volume, page, claim_id LIMIT 60) z""",
        "ends",
    ),
)
def j23(spark, d):
    return neighbourhood(view(spark, d, "ends"), "n7", 2, 120, 20).select("claim_id", "hop")


@query("j07_ordinal_alignment", oracle(", o AS (SELECT claim_id, sid, row_number() OVER (PARTITION BY sid ORDER BY ordinal) AS k FROM claims), p AS (SELECT claim_id, sid, row_number() OVER (PARTITION BY sid ORDER BY claim_id) AS k FROM claims) SELECT o.sid, o.k, o.claim_id = p.claim_id AS equal FROM o JOIN p ON o.sid = p.sid AND o.k = p.k", "claims"))
def j07(spark, d):
    claims = view(spark, d, "claims")
    listed = claims.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("ordinal", "claim_id"))).alias("x"))
    tagged = claims.groupBy("sid").agg(F.sort_array(F.collect_list("claim_id")).alias("y"))
    both = listed.join(tagged, "sid").select("sid", F.posexplode(F.arrays_zip(F.col("x.claim_id").alias("a"), F.col("y").alias("b"))))
    return both.select("sid", (F.col("pos") + 1).cast("long").alias("k"), (F.col("col.a") == F.col("col.b")).alias("equal"))


@query("j24_known_label_overlay", oracle("SELECT claim_id, CASE WHEN claim_id % 35 = 0 THEN 'conflict' WHEN claim_id % 5 = 0 THEN 'merge' WHEN claim_id % 7 = 0 THEN 'no_merge' WHEN score >= 300000 THEN 'merge_by_model' ELSE 'review' END AS label FROM claims", "claims"))
def j24(spark, d):
    claims = view(spark, d, "claims")
    merge = claims.where("claim_id % 5 = 0").select("claim_id", F.lit(True).alias("m"))
    no = claims.where("claim_id % 7 = 0").select("claim_id", F.lit(True).alias("x"))
    rows = claims.select("claim_id", "score").join(merge, "claim_id", "left").join(no, "claim_id", "left")
    label = F.when(F.col("m") & F.col("x"), "conflict").when(F.col("m"), "merge").when(F.col("x"), "no_merge").when(F.col("score") >= 300000, "merge_by_model").otherwise("review")
    return rows.select("claim_id", label.alias("label"))


@query("j29_scoped_evidence", oracle("SELECT category, page, count(DISTINCT claim_id) AS claims, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM (SELECT claim_id, page, unnest(['o', 'r', 's']) AS role, unnest([o_cat, r_cat, s_cat]) AS category FROM claims WHERE volume = 'vol1') x GROUP BY category, page", "claims"))
def j29(spark, d):
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_cat").alias("category")) for r in "sro"]))
    rows = view(spark, d, "claims").where("volume = 'vol1'").select("claim_id", "page", roles.alias("x")).select("claim_id", "page", "x.*")
    return rows.groupBy("category", "page").agg(F.count_distinct("claim_id").alias("claims"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("j30_layered_overrides", oracle("SELECT claim_id, CASE WHEN claim_id % 11 = 0 THEN 'page' WHEN claim_id % 3 = 0 THEN 'gloss' ELSE relation END AS grounding FROM claims", "claims"))
def j30(spark, d):
    claims = view(spark, d, "claims").select("claim_id", "relation")
    gloss = claims.where("claim_id % 3 = 0").select("claim_id", F.lit("gloss").alias("g"))
    page = claims.where("claim_id % 11 = 0").select("claim_id", F.lit("page").alias("p"))
    found = F.coalesce("p", "g", "relation", F.raise_error(F.lit("no grounding")).cast("string"))
    return claims.join(gloss, "claim_id", "left").join(page, "claim_id", "left").select("claim_id", found.alias("grounding"))
