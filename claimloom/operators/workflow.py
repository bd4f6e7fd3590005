"""Checked joins, tables with their constraints, structural label predicates and decision loops."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from claimloom.functions import text as T
from claimloom.functions.vectors import centroids, unit
from claimloom.model import oracle, table, view
from claimloom.operators.graph import WALKED, disjoint_wave, numbered
from claimloom.operators.joins import nearest_in_block
from claimloom.plans.lineage import cut, settled
from claimloom.registry import query

# joins that must find every key -------------------------------------------------


def labelled(rows: DataFrame, labels: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``rows`` with a number from ``labels(key, id)`` for each of ``columns`` as ``<column>_id``; a value without a label raises.

    The misses of all columns are found in one pass of anti-joins before the joins run; keys of
    ``labels`` must be unique.
    """
    twice = labels.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"label {twice[0][0]!r} is there more than once")
    asked = None
    for c in columns:
        one = rows.select(F.lit(c).alias("column"), F.col(c).alias(key)).where(F.col(key).isNotNull()).distinct()
        asked = one if asked is None else asked.union(one)
    missing = asked.join(labels, key, "left_anti").orderBy("column", key).limit(5).collect()
    if missing:
        raise KeyError(f"no label for {[(r['column'], r[key]) for r in missing]}")
    for c in columns:
        rows = rows.join(labels.select(F.col(key).alias(c), F.col("id").alias(f"{c}_id")), c)
    return rows


# tables with primary keys and checks ----------------------------------------------

#: Tables of the category store: primary key, checks by name, references to other tables.
STORE = {
    "categories": {"key": ["code"], "checks": {"code_shape": "code rlike '^[ER][0-9]+$'", "seen_positive": "uses > 0"}, "references": {}},
    "assignments": {"key": ["tag"], "checks": {"tag_given": "length(tag) > 0"}, "references": {"code": ("categories", "code")}},
    "page_assignments": {"key": ["volume", "page", "tag"], "checks": {"page_positive": "page >= 1"}, "references": {"tag": ("assignments", "tag")}},
    "page_runs": {"key": ["volume", "page"], "checks": {"claims_positive": "claims > 0"}, "references": {}},
}


def category_store(claims: DataFrame) -> dict[str, DataFrame]:
    """The four tables of the category store, from claims."""
    ends = claims.select(F.col("subject").alias("tag"), F.col("s_cat").alias("code"), "volume", "page").union(claims.select("object", "o_cat", "volume", "page"))
    return {
        "categories": ends.groupBy("code").agg(F.count("*").alias("uses")),
        "assignments": ends.groupBy("tag").agg(F.min("code").alias("code")),
        "page_assignments": ends.select("volume", "page", "tag").distinct(),
        "page_runs": claims.groupBy("volume", "page").agg(F.count("*").alias("claims")),
    }


def violations(tables: dict[str, DataFrame], store: dict = STORE) -> DataFrame:
    """``table, rule, n`` for each primary key, check and reference with the rows that break it; 0 proves it."""
    out = None
    for name, rules in store.items():
        t = tables[name]
        null = F.lit(False)
        for k in rules["key"]:
            null = null | F.col(k).isNull()
        twice = t.groupBy(*rules["key"]).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("n"))
        parts = [("primary_key", twice), ("key_not_null", t.agg(F.count_if(null).alias("n")))]
        parts += [(rule, t.agg(F.count_if(~F.coalesce(F.expr(check), F.lit(False))).alias("n"))) for rule, check in rules["checks"].items()]
        for column, (other, key) in rules["references"].items():
            parts.append((f"{column}_in_{other}", t.where(F.col(column).isNotNull()).join(tables[other].select(F.col(key).alias(column)), column, "left_anti").agg(F.count("*").alias("n"))))
        for rule, counted in parts:
            row = counted.select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), F.col("n").cast("long").alias("n"))
            out = row if out is None else out.union(row)
    return out


# structural predicates over tokens ------------------------------------------------


def _without(tokens: Column, words) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*words))


def _tail(tokens: Column) -> Column:
    return F.slice(tokens, 2, 1 << 30)


def _front(tokens: Column) -> Column:
    return F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))


def rotated_roles(a: Column, b: Column) -> Column:
    """Tokens that stand first in one label and last in the other, ``of`` and ``the`` apart and all others in one order."""
    x, y = _without(a, ("of", "the")), _without(b, ("of", "the"))
    fits = (F.size(x) >= 2) & (F.size(x) == F.size(y)) & (x != y)
    turned = lambda p, q: F.when(fits & (F.get(p, F.lit(0)) == F.try_element_at(q, F.lit(-1))) & (_tail(p) == _front(q)), F.get(p, F.lit(0)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(turned(x, y), turned(y, x)))))


def swapped_conjuncts(a: Column, b: Column) -> Column:
    """``p and q`` against ``q and p``; a common head after the second conjunct may be shared by both."""

    def parts(t: Column):
        at = F.array_position(t, "and").cast("int")
        return F.slice(t, 1, F.greatest(at - 1, F.lit(0))), F.slice(t, at + 1, 1 << 30)

    def common(p: Column, q: Column) -> Column:
        equal = F.zip_with(F.reverse(p), F.reverse(q), lambda x, y: F.coalesce(x == y, F.lit(False)))
        return F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)).cast("int") - 1, F.size(equal))

    (a1, a2), (b1, b2) = parts(a), parts(b)
    one_and = lambda t: F.size(F.filter(t, lambda x: x == "and")) == 1
    full = (F.size(a1) > 0) & (F.size(a2) > 0) & (F.size(b1) > 0) & (F.size(b2) > 0)
    head = common(a2, b2)
    core = lambda t: F.slice(t, 1, F.greatest(F.size(t) - head, F.lit(0)))
    shared = (head > 0) & (F.size(core(a2)) > 0) & (F.size(core(b2)) > 0) & (a1 == core(b2)) & (core(a2) == b1)
    return one_and(a) & one_and(b) & F.coalesce(full & (((a1 == b2) & (a2 == b1)) | shared), F.lit(False))


@F.pandas_udf(BooleanType())
def spelling_variants(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two token arrays differ in spelling alone: no more tokens on one side, high matching-block ratios."""
    from difflib import SequenceMatcher

    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()

    def alike(x, y) -> bool:
        x, y = ([t for t in side if t not in ("of", "the", "and")] for side in (x, y))
        if not x or not y or sorted(x) == sorted(y) or max(len(x), len(y)) > 6 or set(x) < set(y) or set(y) < set(x):
            return False
        p, q = "".join(x), "".join(y)
        lengths = min(len(p), len(q)) / max(len(p), len(q))
        if len(x) != len(y):
            return ratio(p, q) >= 0.94 and lengths >= 0.84
        apart = [ratio(s, t) for s, t in zip(x, y, strict=True) if s != t]
        return bool(apart) and min(apart) >= 0.82 and ratio(p, q) >= 0.88 and lengths >= 0.82

    return pd.Series([alike(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")


# decision loops --------------------------------------------------------------------


def continued_waves(footprints: DataFrame, decide, most: int | None = None) -> DataFrame:
    """Waves of disjoint parents until the roster is empty: ``wave, parent, member``.

    ``footprints(parent, place, members)`` is the roster. Each wave admits disjoint parents in
    order of place and ``decide(frame)`` keeps the ``parent, member`` rows it accepts. What a wave
    assigns, parents included, is purged from every list; admitted parents leave the roster.
    ``most`` waves, if given, raise when the roster is not empty by then.
    """
    roster = settled(footprints.select("parent", "place", F.array_except("members", F.array("parent")).alias("members")))
    out, wave = None, 0
    while not roster.isEmpty():
        if wave == most:
            raise RuntimeError(f"the roster is not empty after {most} waves")
        wave += 1
        admitted = settled(disjoint_wave(roster).select("parent"))
        pairs = roster.join(admitted, "parent", "left_semi").select("parent", F.explode("members").alias("member"))
        accepted = settled(decide(pairs).select(F.lit(wave).alias("wave"), "parent", "member"))
        out = accepted if out is None else out.union(accepted)
        used = settled(accepted.select(F.col("member").alias("x")).union(admitted.select("parent")).distinct(), admitted)
        left = roster.join(used.toDF("parent"), "parent", "left_anti")
        items = left.select("parent", "place", F.explode_outer("members").alias("x")).join(used.withColumn("gone", F.lit(True)), "x", "left")
        roster = settled(items.groupBy("parent", "place").agg(F.collect_list(F.when(F.col("gone").isNull(), F.col("x"))).alias("members")), roster, used)
    return out if out is not None else footprints.select(F.lit(0).alias("wave"), "parent", F.col("parent").alias("member")).limit(0)


def window_register(mentions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A register of names over ordered windows, and what is wrong with the windows' decisions.

    ``mentions(window, tag)`` are the tags that each window holds, ``decisions(window, name, tag)``
    its groups: every tag of the window must be in exactly one group, and a tag that no window up
    to then has held is unknown. Windows apply in order, so the last decision on a tag holds:
    ``tag, name, window``. Wrong rows are ``window, tag, problem`` and are not applied.
    """
    first = mentions.groupBy("tag").agg(F.min("window").alias("first"))
    counts = decisions.groupBy("window", "tag").agg(F.count("*").alias("times"), F.min("name").alias("name"))
    both = mentions.select("window", "tag").distinct().withColumn("due", F.lit(True)).join(counts, ["window", "tag"], "full").join(first, "tag", "left")
    problem = F.when(F.col("times").isNull(), "missing").when(F.col("first").isNull() | (F.col("first") > F.col("window")), "unknown").when(F.col("times") > 1, "duplicate")
    judged = both.withColumn("problem", problem)
    register = judged.where("problem is null").groupBy("tag").agg(F.max_by(F.struct("name", "window"), "window").alias("x")).select("tag", "x.name", "x.window")
    return register, judged.where("problem is not null").select("window", "tag", "problem")


#: Partners in a cluster's list, decimals of their cosines (equal ones are ties, whichever side asks), and clusters whose lists may hold all others.
LISTED, DECIMALS, FEW = 15, 12, 512


def _listed(asked: DataFrame, others: DataFrame, barred: DataFrame | None, k: int) -> DataFrame:
    """``a, b, sim``: the ``k`` nearest of ``others(cluster, v)`` to each of ``asked(cluster, v)``, none barred; blocks meet as in ``cosine_neighbours``."""
    n, width = others.agg(F.count("*"), F.max(F.size("v"))).first()
    size = min(16_384, max(1024, (1 << 20) // max(1, width or 1)))
    rows, columns = (max(1, -(-m // size)) for m in (asked.count(), n))
    own = lambda blocks: F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    if barred is not None:
        no = barred.select("a", "b").union(barred.select("b", "a")).groupBy(F.col("a").alias("cluster")).agg(F.collect_list("b").alias("no"))
        asked = asked.join(no, "cluster", "left")
    left = asked.select(F.col("cluster").alias("i"), "v", own(rows).alias("l"), every(columns).alias("r"), *(["no"] if barred is not None else []))
    right = others.select(F.col("cluster").alias("j"), F.col("v").alias("w"), every(rows).alias("l"), own(columns).alias("r"))
    kind = others.schema["cluster"].dataType.simpleString()
    met = left.groupBy("l", "r").cogroup(right.groupBy("l", "r")).applyInPandas(lambda a, b: nearest_in_block(a, b, k, DECIMALS), f"a {kind}, b {kind}, sim double")
    return met if columns == 1 else _shortest(met, k)


def _shortest(lists: DataFrame, k: int) -> DataFrame:
    return lists.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("_n") <= k).select("a", "b", "sim")


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """The pairs that a walk in order takes for certain: a pair that stands in one list alone makes both its ends wait, and so does one with an end that waits."""
    frame = frame.sort_values(["score", "a", "b"], ascending=[False, True, True])
    used, waits, kept = set(), set(), []
    for a, b, both in zip(frame["a"], frame["b"], frame["both"], strict=True):
        free = a not in used and b not in used
        sure = free and both and a not in waits and b not in waits
        (used if sure else waits if free else set()).update((a, b))
        kept.append(sure)
    return frame.loc[kept, ["a", "b", "score"]]


def _certain(lists: DataFrame, whole: bool) -> DataFrame:
    """``a, b, score``: pairs of ``lists(a, b, sim)`` that are sure to be in the walk over all pairs, whatever the lists leave out.

    A list leaves out only partners behind its own: pairs that come first in the lists of both
    their ends are taken, round after round, until one task can walk those left. Whole lists
    give one pair at least: the best, should sides differ in the last decimal of a tie.
    """
    ends = lists.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
    left, taken = settled(ends.groupBy("a", "b").agg(F.max("sim").alias("score"), (F.count("*") > 1).alias("both"))), None
    kind = left.select("a", "b", "score").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    key = F.struct(-F.col("score"), F.col("a"), F.col("b"))
    while left.count() > WALKED:
        first = left.select(F.col("a").alias("x"), key.alias("k")).union(left.select("b", key)).groupBy("x").agg(F.min("k").alias("k"))
        now = settled(left.where("both").withColumn("k", key).join(first.toDF("a", "ka"), "a").join(first.toDF("b", "kb"), "b").where("k = ka and k = kb").select("a", "b", "score"))
        if now.isEmpty():
            break
        taken = now if taken is None else taken.union(now)
        used = now.select(F.col("a").alias("x")).union(now.select("b"))
        left = settled(left.join(used.toDF("a"), "a", "left_anti").join(used.toDF("b"), "b", "left_anti"), left)
    else:
        now = settled(left.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_walk, kind))
        taken = now if taken is None else taken.union(now)
    if whole and (taken is None or taken.isEmpty()):
        return settled(left.orderBy(F.desc("score"), "a", "b").limit(1).select("a", "b", "score"), left)
    return taken if taken is not None else now


def disjoint_by_cosine(centres: DataFrame, lists: DataFrame, barred: DataFrame | None, near: int) -> DataFrame:
    """``a, b, score`` as a walk over all pairs of ``centres(cluster, v)`` that are not barred takes them, best cosine first.

    ``lists(a, b, sim)`` hold each cluster's best partners; those that they leave unpaired list
    each other anew, until no pair is left. Each turn pairs the best of all, and most of the rest.
    """
    taken, rest, whole = None, centres, False
    while True:
        now = _certain(lists, whole)
        if whole and now.isEmpty():
            return taken
        taken = now if taken is None else taken.union(now)
        rest = settled(rest.join(now.select(F.col("a").alias("cluster")).union(now.select("b")), "cluster", "left_anti"), *([rest] if rest is not centres else []))
        n = rest.count()
        if n < 2:
            return taken
        lists, whole = _listed(rest, rest, barred, n if n <= FEW else near), True


def refine_by_centroids(vectors: DataFrame, decide, most: int | None = None, near: int = LISTED) -> DataFrame:
    """``item, cluster``: rank disjoint cluster pairs by centroid cosine, decide, merge or bar, recompute, until a pass accepts nothing.

    A pass walks all pairs that are not barred and takes the best ``most`` disjoint ones, or all.
    ``vectors(item, embedding)``; ``decide(frame)`` adds ``accept`` to ``a, b, score``. A rejected
    pair is barred for good, for whatever its sides are merged into too. Lists of ``near``
    partners go from pass to pass; only merged clusters meet all others again.
    """
    members, barred = settled(vectors.select("item", F.col("item").alias("cluster"))), None
    centred = lambda rows: settled(centroids(rows.join(vectors, "item"), ["cluster"]).select("cluster", unit(F.col("mean")).alias("v")))
    centres = centred(members)
    lists = settled(_listed(centres, centres, None, near))
    while True:
        pairs = disjoint_by_cosine(centres, lists, barred, near)
        judged = settled(decide(pairs.orderBy(F.desc("score"), "a", "b").limit(most) if most else pairs))
        merged = judged.where("accept").select(F.col("b").alias("from"), F.col("a").alias("to"))
        if merged.isEmpty():
            return members
        refused = judged.where("not accept").select("a", "b")
        refused = refused if barred is None else refused.union(barred)
        moved = lambda frame, c: frame.join(merged.withColumnRenamed("from", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        members = settled(moved(members, "cluster").select("item", "cluster"), members)
        barred = settled(moved(moved(refused, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), *([barred] if barred is not None else []))
        fresh = centred(members.join(merged.select(F.col("to").alias("cluster")), "cluster", "left_semi"))
        touched = merged.select(F.col("from").alias("a")).union(merged.select("to"))
        same = centres.join(touched.toDF("cluster"), "cluster", "left_anti")
        old = lists.join(touched, "a", "left_anti").join(touched.toDF("b"), "b", "left_anti").join(barred.union(barred.select("b", "a")), ["a", "b"], "left_anti").select("a", "b", "sim")
        # a list knows nothing behind its last partner, so merged clusters enter no further down
        ends = old.groupBy("a").agg(F.max(F.struct(-F.col("sim"), F.col("b"))).alias("last"))
        entering = _listed(same, fresh, barred, near).join(ends, "a").where(F.struct(-F.col("sim"), F.col("b")) <= F.col("last")).select("a", "b", "sim")
        lists = settled(_shortest(old.union(entering), near).union(_listed(fresh, same.union(fresh), barred, near)), lists)
        centres = settled(same.union(fresh), centres, fresh)


def assign_codes(register: DataFrame, batch: DataFrame) -> DataFrame:
    """``tag, code, pages`` after a batch of ``(tag, place, page, wanted)`` has come to a register of ``(tag, code, pages)``.

    Known tags keep their code. A new tag gets the code that it wants, else the largest code
    so far plus its rank among such tags by first ``place``. Pages of the batch add to those
    of the register. A tag that wants two codes or another than its own, and a code that two
    tags would have, raise before anything is assigned: the batch counts whole or not at all.
    """
    seen = batch.groupBy("tag").agg(F.min("place").alias("place"), F.count_distinct("page").alias("more"), F.min("wanted").alias("low"), F.max("wanted").alias("high"))
    met = cut(seen.join(register.withColumnRenamed("pages", "had"), "tag", "full"))
    clash = met.where((F.col("low") != F.col("high")) | (F.col("low") != F.col("code")))
    given = met.select("tag", F.coalesce("code", "low").alias("code"), "place", "more", "had")
    twice = given.where("code is not null").groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    if not clash.isEmpty() or not twice.isEmpty():
        raise ValueError(f"{clash.count()} tags want another code, {twice.count()} codes are wanted twice")
    last = given.agg(F.coalesce(F.max("code"), F.lit(0)).alias("last"))
    fresh = numbered(given.where("code is null").drop("code"), [F.col("place"), F.col("tag")], "n").join(F.broadcast(last)).withColumn("code", F.col("last") + F.col("n"))
    every = given.where("code is not null").select("tag", "code", "more", "had").union(fresh.select("tag", "code", "more", "had"))
    return every.select("tag", F.col("code").cast("long").alias("code"), (F.coalesce("had", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("pages"))


_CODED = "SELECT concat(event_type, '-', CAST(user_id AS STRING)) AS tag, event_id AS place, event_id % 97 AS page, event_id < 3 * (SELECT count(*) FROM events) // 4 AS early FROM events"


@query(
    "v09_second_batch",
    f"""WITH e AS ({_CODED}), a AS (SELECT tag, row_number() OVER (ORDER BY min(place), tag) AS code, count(DISTINCT page) AS pages FROM e WHERE early GROUP BY tag),
    b AS (SELECT tag, min(place) AS place, count(DISTINCT page) AS pages FROM e WHERE NOT early GROUP BY tag),
    n AS (SELECT tag, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY place, tag) AS code FROM b WHERE tag NOT IN (SELECT tag FROM a))
    SELECT coalesce(a.tag, b.tag) AS tag, coalesce(a.code, n.code) AS code, CAST(coalesce(a.pages, 0) + coalesce(b.pages, 0) AS BIGINT) AS pages FROM a FULL JOIN b ON a.tag = b.tag LEFT JOIN n ON n.tag = b.tag""",
)
def v09(spark, d):
    """Three quarters of the events make the register, the others come as a second batch."""
    events = table(spark, d, "events")
    rows = events.join(F.broadcast(events.agg(F.count("*").alias("n")))).select(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("tag"), F.col("event_id").alias("place"), (F.col("event_id") % 97).alias("page"), F.lit(None).cast("long").alias("wanted"), (F.col("event_id") < F.expr("3 * n div 4")).alias("early"))
    none = spark.createDataFrame([], "tag string, code long, pages long")
    return assign_codes(assign_codes(none, rows.where("early").drop("early")), rows.where("not early").drop("early"))


@query("v06_centroid_refinement")
def v06(spark, d):
    """Vectors merge where their centroids are near and their numbers do not add up to a multiple of seven; the latter pairs are barred."""
    accept = (F.col("score") >= 0.45) & ((F.col("a") + F.col("b")) % 7 != 0)
    return refine_by_centroids(table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "embedding"), lambda f: f.withColumn("accept", accept))


@query("j01_labelled", oracle("SELECT c.claim_id, s.id AS subject_id, o.id AS object_id FROM claims c JOIN (SELECT tag, CAST(substr(tag, 2) AS BIGINT) AS id FROM tags) s ON s.tag = c.subject JOIN (SELECT tag, CAST(substr(tag, 2) AS BIGINT) AS id FROM tags) o ON o.tag = c.object", "claims", "tags"))
def j01(spark, d):
    labels = view(spark, d, "tags").select("tag", F.expr("cast(substr(tag, 2) as bigint)").alias("id"))
    return labelled(view(spark, d, "claims").select("claim_id", "subject", "object"), labels, ["subject", "object"], "tag").select("claim_id", "subject_id", "object_id")


@query("s13_store_rows", oracle(", ends_ AS (SELECT subject AS tag, s_cat AS code, volume, page FROM claims UNION ALL SELECT object, o_cat, volume, page FROM claims) SELECT 'categories' AS \"table\", count(DISTINCT code) AS n FROM ends_ UNION ALL SELECT 'assignments', count(DISTINCT tag) FROM ends_ UNION ALL SELECT 'page_assignments', count(*) FROM (SELECT DISTINCT volume, page, tag FROM ends_) x UNION ALL SELECT 'page_runs', count(*) FROM (SELECT DISTINCT volume, page FROM claims) y", "claims"))
def s13(spark, d):
    out = None
    for name, t in category_store(view(spark, d, "claims")).items():
        row = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.union(row)
    return out


@query("s13_violations", oracle(", p AS (SELECT 'page_runs' AS t, count(*) FILTER (n > 1) AS c FROM (SELECT volume, page, count(*) AS n FROM claims GROUP BY ALL) x) SELECT 'categories' AS \"table\", unnest(['primary_key', 'key_not_null', 'code_shape', 'seen_positive']) AS rule, 0::BIGINT AS n UNION ALL SELECT 'assignments', unnest(['primary_key', 'key_not_null', 'tag_given', 'code_in_categories']), 0 UNION ALL SELECT 'page_assignments', unnest(['primary_key', 'key_not_null', 'page_positive', 'tag_in_assignments']), 0 UNION ALL SELECT 'page_runs', unnest(['primary_key', 'key_not_null', 'claims_positive']), 0 UNION ALL SELECT 'raw claims', 'page_runs key', sum(n - 1)::BIGINT FROM (SELECT volume, page, count(*) AS n FROM claims GROUP BY ALL) z", "claims"))
def s13b(spark, d):
    claims = view(spark, d, "claims")
    broken = violations({"raw claims": claims}, {"raw claims": {"key": ["volume", "page"], "checks": {}, "references": {}}}).where("rule = 'primary_key'")
    return violations(category_store(claims)).union(broken.select("table", F.lit("page_runs key").alias("rule"), "n"))


_X19 = "WITH l AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS w FROM part), x AS (SELECT k, [w[1], 'and', w[2], 'forces'] AS x, CASE k % 3 WHEN 0 THEN [w[2], 'and', w[1], 'forces'] WHEN 1 THEN [w[1], 'and', w[2], 'fleet'] ELSE [w[2], 'forces', 'and', w[1]] END AS y, ['king', 'of', w[1], w[2]] AS p, CASE k % 2 WHEN 0 THEN [w[1], w[2], 'king'] ELSE [w[2], w[1], 'king'] END AS q FROM l)"


@query("x19_structure", _X19 + " SELECT k, k % 3 <> 1 AS swapped, CASE WHEN p[3:4] = q[1:2] THEN 'king' ELSE '' END AS rotated FROM x")
def x19(spark, d):
    k, w = F.col("k"), F.split("p_name", " ")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), w[0].alias("a"), w[1].alias("b"))
    lit = lambda t: F.lit(t)
    x = F.array("a", lit("and"), "b", lit("forces"))
    y = F.when(k % 3 == 0, F.array("b", lit("and"), "a", lit("forces"))).when(k % 3 == 1, F.array("a", lit("and"), "b", lit("fleet"))).otherwise(F.array("b", lit("forces"), lit("and"), "a"))
    q = F.when(k % 2 == 0, F.array("a", "b", lit("king"))).otherwise(F.array("b", "a", lit("king")))
    return rows.select("k", swapped_conjuncts(x, y).alias("swapped"), F.array_join(rotated_roles(F.array(lit("king"), lit("of"), "a", "b"), q), ",").alias("rotated"))


@query("x19_spelling")
def x19b(spark, d):
    rows = table(spark, d, "part").select("p_partkey", T.label_tokens(F.col("p_name")).alias("x"))
    changed = F.transform("x", lambda t, i: F.when(i == 0, F.concat(F.lit("h"), t)).otherwise(t))
    return rows.select("p_partkey", spelling_variants("x", changed).alias("variant"))


@query("v07_waves")
def v07(spark, d):
    c = view(spark, d, "claims").groupBy(F.col("subject").alias("parent")).agg(F.count("*").alias("n"), F.collect_set("object").alias("members"))
    accept = F.pmod(F.crc32(F.concat("parent", "member")), F.lit(3)) > 0
    return continued_waves(numbered(c, [F.desc("n"), F.col("parent")], "place").select("parent", "place", "members"), lambda f: f.where(accept))


_V08 = ", m AS (SELECT DISTINCT page // 10 AS win, subject AS tag FROM claims), d AS (SELECT win, tag, 'g' || CAST(substr(tag, 2) AS INT) % 7 || '.' || win AS name FROM m WHERE CAST(substr(tag, 2) AS INT) % 5 <> win % 5)"


@query("v08_register", oracle(_V08 + " SELECT tag, name, win AS \"window\" FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY win DESC) AS k FROM d) x WHERE k = 1", "claims"))
def v08(spark, d):
    return window_register(*_windows(spark, d))[0]


@query("v08_problems", oracle(_V08 + " SELECT win AS \"window\", tag, 'missing' AS problem FROM m WHERE CAST(substr(tag, 2) AS INT) % 5 = win % 5", "claims"))
def v08b(spark, d):
    return window_register(*_windows(spark, d))[1]


def _windows(spark, d):
    m = view(spark, d, "claims").select(F.floor(F.col("page") / 10).cast("int").alias("window"), F.col("subject").alias("tag")).distinct()
    number = F.expr("cast(substr(tag, 2) as int)")
    named = F.concat(F.lit("g"), (number % 7).cast("string"), F.lit("."), F.col("window").cast("string"))
    return m, m.where(number % 5 != F.col("window") % 5).select("window", named.alias("name"), "tag")
