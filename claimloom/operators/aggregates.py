"""Aggregations, profiles, classifier metrics and set reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions.vectors import centroids
from claimloom.model import oracle, table, view
from claimloom.plans.lineage import cut
from claimloom.registry import query


def idf_table(rows: DataFrame, item: str, tokens) -> DataFrame:
    """``token, df, idf`` with idf = ln((N + 1) / (df + 1)) + 1 over distinct tokens of each item."""
    per = rows.groupBy(item).agg(F.count("*").alias("_rows"))
    n = per.agg(F.count("*").alias("total"), F.coalesce(F.max("_rows"), F.lit(0)).alias("most")).first()
    own = rows.select(item, F.explode(F.array_distinct(tokens)).alias("token"))
    if n.most > 1:  # an item of several rows counts once for a token
        own = own.distinct()
    df = own.groupBy("token").agg(F.count("*").alias("df"))  # tokens are distinct in an item, so counts combine before the shuffle
    return df.select("token", "df", (F.log(F.lit(n.total + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighted_token_means(rows: DataFrame, item: str, tokens, vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean of the vectors of each item's tokens, weighted by ``weights(token, idf)``; tokens without a vector do not count."""
    own = rows.select(item, F.explode(F.array_distinct(tokens)).alias("token")).join(vectors.select("token", "embedding"), "token").join(weights.select("token", "idf"), "token")
    return centroids(own, [item], weight=F.col("idf"))


def coverage(retained: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Share of retained characters that some evidence interval covers, by interval arithmetic."""
    merged = merged_intervals(evidence, [key])
    met = retained.join(merged.select(key, F.col("start").alias("_s"), F.col("end").alias("_e")), key, "left")
    shared = F.coalesce(F.sum(F.greatest(F.lit(0), F.least("end", "_e") - F.greatest("start", "_s"))), F.lit(0))
    return met.groupBy(key, "start", "end").agg(shared.alias("c")).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("retained"), F.sum("c").alias("covered"))


def merged_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Touching and overlapping intervals of each key as one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("_new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("_island", F.sum("_new").over(w))
    return fresh.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def uncovered(rows: DataFrame, keys: list[str], length: str) -> DataFrame:
    """What no interval of a key covers of 0..length; a key whose only interval is null is one gap."""
    ends = rows.groupBy(*keys).agg(F.max(length).alias("start")).withColumn("end", F.col("start"))
    every = rows.where("start is not null").select(*keys, "start", "end").unionByName(ends)
    reach = F.max("end").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    gaps = every.select(*keys, F.coalesce(reach, F.lit(0)).alias("_reach"), "start").where("start > _reach")
    return gaps.select(*keys, F.col("_reach").alias("start"), F.col("start").alias("end"))


def curve(scored: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """A row for each distinct score with cumulative true and false positives at or above it.

    Scores are aggregated first and dealt into ranges; each range sums its own steps in order
    and starts from the total of the ranges above it, so no task sees more than its range.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    steps = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(w * F.col(label)).alias("p"), F.sum(w * (1 - F.col(label))).alias("n"))
    steps = cut(steps.repartitionByRange(F.desc("threshold")).withColumn("_part", F.spark_partition_id()))
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = steps.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_p").over(every), F.lit(0.0)).alias("_p"), F.coalesce(F.sum("_n").over(every), F.lit(0.0)).alias("_n"))
    down = Window.partitionBy("_part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    placed = steps.join(F.broadcast(before), "_part").withColumns({"tp": F.col("_p") + F.sum("p").over(down), "fp": F.col("_n") + F.sum("n").over(down)})
    return placed.select("threshold", "p", "n", "tp", "fp")


def classifier_metrics(scored: DataFrame, score: str = "score", label: str = "label", weight: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row: weighted average precision, ROC AUC (ties half), Brier score, precision, recall, F1, balanced accuracy."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    yes = F.col(score) >= threshold
    part = lambda p, y: F.sum(F.when(p & (F.col(label) == y), w).otherwise(0.0))
    flat = scored.agg(part(yes, 1).alias("tp"), part(yes, 0).alias("fp"), part(~yes, 1).alias("fn"), part(~yes, 0).alias("tn"), (F.sum(w * (F.col(score) - F.col(label)) ** 2) / F.sum(w)).alias("brier"))
    c = curve(scored, score, label, weight)
    ranked = c.agg(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum("p").alias("P"), F.sum("n").alias("N"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return flat.join(F.broadcast(ranked)).select(
        (F.col("ap") / F.col("P")).alias("average_precision"), (F.col("area") / (F.col("P") * F.col("N"))).alias("roc_auc"), "brier", precision.alias("precision"), recall.alias("recall"),
        (2 * precision * recall / (precision + recall)).alias("f1"), ((recall + F.col("tn") / (F.col("tn") + F.col("fp"))) / 2).alias("balanced_accuracy"),
    )


def wilson(successes, trials, z: float = 1.959963984540054):
    """Bounds of the Wilson interval."""
    p = successes / trials
    middle, spread = p + z * z / (2 * trials), z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    return (middle - spread) / (1 + z * z / trials), (middle + spread) / (1 + z * z / trials)


def best_threshold(scored: DataFrame, score: str, label: str, precision: float, accepted: int) -> DataFrame:
    """The threshold with the best recall among those with enough precision and accepted pairs, highest on ties."""
    c = curve(scored, score, label).where((F.col("tp") / (F.col("tp") + F.col("fp")) >= precision) & (F.col("tp") + F.col("fp") >= accepted))
    return c.orderBy(F.desc("tp"), F.desc("threshold")).limit(1).select("threshold", "tp", "fp")


def one_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row a key, the first in the order, by a combining aggregate instead of a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def reconciled(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer merge in which the existing value wins; ``state`` tells what was done."""
    both = old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new")), key, "full")
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "restored").when(F.col("_old") != F.col("_new"), "kept").otherwise("same")
    return both.select(key, F.coalesce("_old", "_new").alias(value), state.alias("state"))


def differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows on one side only, with repeats: ``missing`` and ``unexpected``."""
    return expected.exceptAll(found).withColumn("side", F.lit("missing")).unionByName(found.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def partition_proof(members: DataFrame, item: str, total: int) -> DataFrame:
    """Items of 0..total-1 that are missing or assigned more than once; no rows prove a partition."""
    counts = members.groupBy(item).agg(F.count("*").alias("times"))
    every = members.sparkSession.range(total).withColumnRenamed("id", item)
    return every.join(counts, item, "full").select(item, F.coalesce("times", F.lit(0)).alias("times")).where("times <> 1")


_V = "SELECT label, k, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) AS x FROM embeddings) u GROUP BY label, k"


@query("a09_centroids", f"SELECT label, round(sqrt(sum(m * m)), 6) AS cohesion, round(max(m), 6) AS largest FROM ({_V}) v GROUP BY label")
def a09(spark, d):
    return centroids(table(spark, d, "embeddings"), ["label"]).select("label", F.round("cohesion", 6).alias("cohesion"), F.round(F.array_max("mean"), 6).alias("largest"))


@query("a10_weighted_means", _V.replace("avg(x)", "sum(x * w) / sum(w)").replace("SELECT label, generate_subscripts", "SELECT label, vec_id % 5 + 1 AS w, generate_subscripts").join(("SELECT label, round(sqrt(sum(m * m)), 6) AS cohesion FROM (", ") v GROUP BY label")))
def a10(spark, d):
    rows = table(spark, d, "embeddings")
    return centroids(rows, ["label"], weight=F.col("vec_id") % 5 + 1).select("label", F.round("cohesion", 6).alias("cohesion"))


@query("a11_ambiguity", oracle("SELECT tag, count(*) AS n, round(ln(1 + count(*)) * (1 - max(score) / 1000000) , 6) AS ambiguity FROM ends GROUP BY tag", "ends"))
def a11(spark, d):
    return view(spark, d, "ends").groupBy("tag").agg(F.count("*").alias("n"), F.round(F.log1p(F.count("*")) * (1 - F.max("score") / 1000000), 6).alias("ambiguity"))


@query("a12_quantile_profile", oracle("SELECT volume, round(quantile_cont(score, 0.05), 4) AS p05, round(quantile_cont(score, 0.25), 4) AS p25, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.95), 4) AS p95 FROM claims GROUP BY volume", "claims"))
def a12(spark, d):
    q = view(spark, d, "claims").groupBy("volume").agg(F.percentile("score", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.95)))).alias("q"))
    return q.select("volume", *(F.round(F.col("q")[k], 4).alias(n) for k, n in enumerate(("p05", "p25", "p50", "p95"))))


@query("a13_community_sizes", oracle("SELECT label, count(*) AS communities, max(n) AS largest, quantile_cont(n, 0.5) AS median FROM (SELECT r_cat AS label, s_cat, o_cat, count(*) AS n FROM claims GROUP BY ALL) x GROUP BY label", "claims"))
def a13(spark, d):
    sizes = view(spark, d, "claims").groupBy(F.col("r_cat").alias("label"), "s_cat", "o_cat").agg(F.count("*").alias("n"))
    return sizes.groupBy("label").agg(F.count("*").alias("communities"), F.max("n").alias("largest"), F.percentile("n", 0.5).alias("median"))


@query(
    "a14_idf",
    r"""WITH t AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS token FROM documents),
    n AS (SELECT count(DISTINCT doc_id) AS n FROM documents) SELECT token, count(*) AS df, round(ln((max(n) + 1.0) / (count(*) + 1)) + 1, 6) AS idf FROM t, n GROUP BY token""",
)
def a14(spark, d):
    return idf_table(table(spark, d, "documents"), "doc_id", T.label_tokens(F.col("text"))).select("token", "df", F.round("idf", 6).alias("idf"))


@query("a15_gloss_clusters", "SELECT lower(trim(text)) AS gloss, count(*) AS mentions, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def a15(spark, d):
    return table(spark, d, "documents").groupBy(F.lower(F.trim("text")).alias("gloss")).agg(F.count("*").alias("mentions"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_doc"))


@query("a16_usage_cost", "SELECT event_type, CAST(sum(coalesce(user_id, 0)) AS BIGINT) AS tokens, round(sum(coalesce(value, 0)) * 0.000002, 6) AS cost FROM events GROUP BY event_type")
def a16(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.coalesce("user_id", F.lit(0))).alias("tokens"), F.round(F.sum(F.coalesce("value", F.lit(0.0))) * 0.000002, 6).alias("cost"))


_SPAN = "SELECT user_id AS page, CAST((event_id * 53) % 1000 AS INT) AS start, CAST((event_id * 53) % 1000 + 3 + event_id % 20 AS INT) AS \"end\" FROM events"


def _spans(spark, d):
    return table(spark, d, "events").selectExpr("user_id as page", "cast((event_id * 53) % 1000 as int) as start", "cast((event_id * 53) % 1000 + 3 + event_id % 20 as int) as end")


@query("a17_coverage", f"WITH e AS ({_SPAN.format(9)}), r AS (SELECT DISTINCT page, 0 AS start, 1030 AS \"end\" FROM e), p AS (SELECT DISTINCT page, unnest(range(start, \"end\")) AS c FROM e) SELECT r.page, 1030 AS retained, count(p.c) AS covered FROM r JOIN p USING (page) GROUP BY r.page")
def a17(spark, d):
    spans = _spans(spark, d)
    whole = spans.select("page").distinct().selectExpr("page", "0 as start", "1030 as end")
    return coverage(whole, spans, "page")


@query("a18_histogram", oracle("SELECT CASE WHEN frequency = 1 THEN '1' WHEN frequency = 2 THEN '2' WHEN frequency <= 4 THEN '3-4' WHEN frequency <= 9 THEN '5-9' ELSE '10+' END AS bucket, count(*) AS tags, CAST(sum(frequency) AS BIGINT) AS mentions FROM (SELECT subject, object, count(*) AS frequency FROM claims GROUP BY ALL) x GROUP BY 1", "claims"))
def a18(spark, d):
    sizes = view(spark, d, "claims").groupBy("subject", "object").agg(F.count("*").alias("frequency"))
    bucket = F.when(F.col("frequency") == 1, "1").when(F.col("frequency") == 2, "2").when(F.col("frequency") <= 4, "3-4").when(F.col("frequency") <= 9, "5-9").otherwise("10+")
    return sizes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("tags"), F.sum("frequency").alias("mentions"))


@query("a19_first_n", oracle("SELECT tag, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY claim_id) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY claim_id, role) AS k FROM ends) x WHERE k <= 5 GROUP BY tag", "ends"))
def a19(spark, d):
    ranked = view(spark, d, "ends").select("tag", "claim_id", "role").withColumn("k", F.row_number().over(Window.partitionBy("tag").orderBy("claim_id", "role"))).where("k <= 5")
    return ranked.groupBy("tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list("claim_id")), lambda x: x.cast("string")), ",").alias("sample"))


@query("a20_representative", oracle("SELECT DISTINCT ON (sid) sid, claim_id, page, relation FROM claims ORDER BY sid, score DESC, page, claim_id", "claims"))
def a20(spark, d):
    rows = view(spark, d, "claims").select("sid", "claim_id", "page", "relation", "score")
    return one_of(rows, ["sid"], -F.col("score"), F.col("page"), F.col("claim_id")).select("sid", "claim_id", "page", "relation")


@query("a21_divergence", oracle("SELECT count(*) AS groups, count(*) FILTER (v > 1) AS divergent, count(*) FILTER (n > 1 AND v > 1) AS divergent_many FROM (SELECT subject, object, count(*) AS n, count(DISTINCT relation || '|' || decision) AS v FROM claims GROUP BY subject, object) x", "claims"))
def a21(spark, d):
    groups = view(spark, d, "claims").groupBy("subject", "object").agg(F.count("*").alias("n"), F.count_distinct(F.to_json(F.struct("relation", "decision"))).alias("v"))
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.expr("v > 1")).alias("divergent"), F.count_if(F.expr("n > 1 and v > 1")).alias("divergent_many"))


@query("a22_pair_counts", "SELECT d.source, l.quality, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def a22(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source", "quality").agg(F.count("*").alias("n"))


_SCORED = "SELECT vec_id, (vec_id * 37 % 100) / 100.0::DOUBLE AS score, CASE WHEN (vec_id * 37 % 100) + (vec_id * 11 % 60) > 80 THEN 1 ELSE 0 END AS label FROM embeddings"


def _scored(spark, d):
    return table(spark, d, "embeddings").selectExpr("vec_id", "cast(vec_id * 37 % 100 as double) / 100 as score", "case when (vec_id * 37 % 100) + (vec_id * 11 % 60) > 80 then 1 else 0 end as label")


@query(
    "a23_classifier_metrics",
    f"""WITH s AS ({_SCORED}), t AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score),
    c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM t),
    a AS (SELECT sum(p * tp / (tp + fp)) / sum(p) AS ap, (SELECT sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) / count(*) FROM s x, s y WHERE x.label = 1 AND y.label = 0) AS auc FROM c),
    f AS (SELECT avg((score - label) * (score - label)) AS brier, sum(label) FILTER (score >= 0.5) / count(*) FILTER (score >= 0.5) AS pr, sum(label) FILTER (score >= 0.5) / sum(label) AS re, count(*) FILTER (score < 0.5 AND label = 0) / count(*) FILTER (label = 0) AS tnr FROM s)
    SELECT round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc, round(brier, 6) AS brier, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1, round((re + tnr) / 2, 6) AS balanced_accuracy FROM a, f""",
)
def a23(spark, d):
    m = classifier_metrics(_scored(spark, d))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query("a24_bounding_box", oracle("SELECT subject, min(page) - 3 AS left_, max(page) + 3 AS right_, min(score) AS low, max(score) AS high FROM claims GROUP BY subject", "claims"))
def a24(spark, d):
    return view(spark, d, "claims").groupBy("subject").agg((F.min("page") - 3).alias("left_"), (F.max("page") + 3).alias("right_"), F.min("score").alias("low"), F.max("score").alias("high"))


@query("a25_page_quality", oracle("SELECT volume, count(*) AS pages, CAST(sum(len(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS letters, count(*) FILTER (len(text) < 20 OR len(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.3 * len(text)) AS suspicious FROM sentences GROUP BY volume", "sentences"))
def a25(spark, d):
    letters, chars = F.regexp_count("text", F.lit("[A-Za-z]")), F.length("text")
    return view(spark, d, "sentences").groupBy("volume").agg(F.count("*").alias("pages"), F.sum(chars).alias("chars"), F.sum(letters).alias("letters"), F.count_if((chars < 20) | (letters < 0.3 * chars)).alias("suspicious"))


@query("a26_rollup_totals", oracle("SELECT coalesce(volume, 'all') AS volume, count(*) AS claims, count(DISTINCT sid) AS sentences FROM claims GROUP BY ROLLUP (volume)", "claims"))
def a26(spark, d):
    return view(spark, d, "claims").rollup("volume").agg(F.count("*").alias("claims"), F.count_distinct("sid").alias("sentences")).withColumn("volume", F.coalesce("volume", F.lit("all")))


@query("a28_status_index", oracle("SELECT page, count(*) FILTER (decision = 'F') AS valid, count(*) FILTER (decision <> 'F') AS invalid FROM claims GROUP BY page", "claims"))
def a28(spark, d):
    return view(spark, d, "claims").groupBy("page").agg(F.count_if(F.expr("decision = 'F'")).alias("valid"), F.count_if(F.expr("decision <> 'F'")).alias("invalid"))


@query("u01_union_with_sources", "SELECT tag, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(source) AS first_source FROM (SELECT c_nationkey AS tag, 'customer' AS source FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) x GROUP BY tag")
def u01(spark, d):
    pools = {n: table(spark, d, n).select(F.col(f"{n[0]}_nationkey").alias("tag"), F.lit(n).alias("source")) for n in ("customer", "supplier")}
    return pools["customer"].unionByName(pools["supplier"]).groupBy("tag").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("source").alias("first_source"))


@query("u02_passes_renumbered", oracle("SELECT pass, claim_id, row_number() OVER (PARTITION BY pass ORDER BY claim_id) AS ordinal FROM (SELECT 1 AS pass, claim_id FROM claims WHERE decision = 'F' UNION ALL SELECT 2, claim_id FROM claims WHERE decision = 'P') x", "claims"))
def u02(spark, d):
    c = view(spark, d, "claims")
    rows = c.where("decision = 'F'").select(F.lit(1).alias("pass"), "claim_id").unionByName(c.where("decision = 'P'").select(F.lit(2).alias("pass"), "claim_id"))
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("pass").orderBy("claim_id")).cast("long"))


@query("u03_completeness", "(SELECT doc_id, 'missing' AS side FROM documents EXCEPT SELECT doc_id, 'missing' FROM labels) UNION ALL (SELECT doc_id, 'unexpected' FROM labels EXCEPT SELECT doc_id, 'unexpected' FROM documents)")
def u03(spark, d):
    return differences(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"))


@query("u04_distinct_keys", oracle("SELECT subject, upper(relation) AS relation, object, min(claim_id) AS claim_id FROM claims GROUP BY ALL", "claims"))
def u04(spark, d):
    return view(spark, d, "claims").groupBy("subject", F.upper("relation").alias("relation"), "object").agg(F.min("claim_id").alias("claim_id"))


@query("u05_role_union", oracle("SELECT DISTINCT claim_id FROM (SELECT claim_id FROM claims WHERE subject = 'n8' UNION SELECT claim_id FROM claims WHERE object = 'n8') x", "claims"))
def u05(spark, d):
    c = view(spark, d, "claims")
    return c.where("subject = 'n8'").select("claim_id").union(c.where("object = 'n8'").select("claim_id")).distinct()


@query("u06_intersection", oracle("SELECT subject AS tag FROM claims WHERE volume = 'vol1' INTERSECT SELECT object FROM claims WHERE volume = 'vol2'", "claims"))
def u06(spark, d):
    c = view(spark, d, "claims")
    return c.where("volume = 'vol1'").select(F.col("subject").alias("tag")).intersect(c.where("volume = 'vol2'").select(F.col("object").alias("tag")))


@query("u07_register_merge", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'restored' WHEN a.v <> b.v THEN 'kept' ELSE 'same' END AS state FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey * 5 AS k, s_nationkey AS v FROM supplier) b ON a.k = b.k")
def u07(spark, d):
    old = table(spark, d, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey as k", "c_nationkey as v")
    return reconciled(old, table(spark, d, "supplier").selectExpr("s_suppkey * 5 as k", "s_nationkey as v"), "k", "v")


@query("u08_partition_proof", "SELECT i AS item, coalesce(n, 0) AS times FROM range(400) r(i) FULL JOIN (SELECT doc_id % 500 AS item, count(*) AS n FROM labels GROUP BY 1) x ON r.i = x.item WHERE coalesce(n, 0) <> 1 AND i IS NOT NULL UNION ALL SELECT item, n FROM (SELECT doc_id % 500 AS item, count(*) AS n FROM labels GROUP BY 1) y WHERE item >= 400 AND n <> 1")
def u08(spark, d):
    return partition_proof(table(spark, d, "labels").select((F.col("doc_id") % 500).alias("item")), "item", 400)


@query("u10_missing_split", oracle("SELECT s.sid, CASE WHEN len(s.text) < 40 THEN 'short' WHEN regexp_matches(s.text, '^[0-9 .,]+$') THEN 'number' ELSE 'missing' END AS state FROM sentences s WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.sid)", "sentences"))
def u10(spark, d):
    gone = view(spark, d, "sentences").join(table(spark, d, "labels").select(F.col("doc_id").alias("sid")), "sid", "left_anti")
    return gone.select("sid", F.when(F.length("text") < 40, "short").when(F.col("text").rlike("^[0-9 .,]+$"), "number").otherwise("missing").alias("state"))


@query("w01_running_rank", oracle("SELECT claim_id, role, tag, row_number() OVER (PARTITION BY tag ORDER BY score DESC, claim_id, role) AS place FROM ends", "ends"))
def w01(spark, d):
    w = Window.partitionBy("tag").orderBy(F.desc("score"), "claim_id", "role")
    return view(spark, d, "ends").select("claim_id", "role", "tag", F.row_number().over(w).cast("long").alias("place"))


@query("w02_top_two_margin", oracle("SELECT tag, claim_id, round(score - coalesce(nxt, -1), 4) AS margin FROM (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS k FROM ends WINDOW w AS (PARTITION BY tag ORDER BY score DESC, claim_id, role)) x WHERE k = 1", "ends"))
def w02(spark, d):
    w = Window.partitionBy("tag").orderBy(F.desc("score"), "claim_id", "role")
    top = view(spark, d, "ends").select("tag", "claim_id", "score", "role", F.row_number().over(w).alias("k")).where("k <= 2")
    both = top.select("tag", "claim_id", "k", "score", F.lead("score", 1, -1.0).over(Window.partitionBy("tag").orderBy("k")).alias("second"))
    return both.where("k = 1").select("tag", "claim_id", F.round(F.col("score") - F.col("second"), 4).alias("margin"))


@query("w03_ordinals", oracle("SELECT claim_id, volume || '_s' || lpad(CAST(row_number() OVER (PARTITION BY volume ORDER BY sid, ordinal, claim_id) AS VARCHAR), 6, '0') AS name FROM claims", "claims"))
def w03(spark, d):
    n = F.row_number().over(Window.partitionBy("volume").orderBy("sid", "ordinal", "claim_id"))
    return view(spark, d, "claims").select("claim_id", F.concat("volume", F.lit("_s"), F.lpad(n.cast("string"), 6, "0")).alias("name"))


@query("w04_exemplars", oracle(", t AS (SELECT s_cat, subject, count(*) AS n, max(score) AS best FROM claims GROUP BY s_cat, subject), r AS (SELECT *, row_number() OVER (PARTITION BY s_cat ORDER BY n DESC, subject) AS a, row_number() OVER (PARTITION BY s_cat ORDER BY best DESC, subject) AS b FROM t) SELECT s_cat, string_agg(subject, ',' ORDER BY a) FILTER (a <= 20) AS frequent, string_agg(subject, ',' ORDER BY b) FILTER (b <= 20) AS central FROM r GROUP BY s_cat", "claims"))
def w04(spark, d):
    t = view(spark, d, "claims").groupBy("s_cat", "subject").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    p = Window.partitionBy("s_cat")
    r = t.withColumns({"a": F.row_number().over(p.orderBy(F.desc("n"), "subject")), "b": F.row_number().over(p.orderBy(F.desc("best"), "subject"))}).where("a <= 20 or b <= 20")
    listed = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(k) <= 20, F.struct(k, "subject")))), lambda x: x["subject"]), ",")
    return r.groupBy("s_cat").agg(listed("a").alias("frequent"), listed("b").alias("central"))


@query("w05_order_check", oracle("SELECT tag, frequency, prev FROM (SELECT *, lag(frequency) OVER (PARTITION BY left(tag, 2) ORDER BY tag) AS prev FROM tags) x WHERE frequency > prev", "tags"))
def w05(spark, d):
    w = Window.partitionBy(F.left("tag", F.lit(2))).orderBy("tag")
    return view(spark, d, "tags").withColumn("prev", F.lag("frequency").over(w)).where("frequency > prev")


@query("w09_islands", f"WITH e AS ({_SPAN.format(9)}), p AS (SELECT DISTINCT page, unnest(range(start, \"end\")) AS c FROM e), g AS (SELECT page, c, c - row_number() OVER (PARTITION BY page ORDER BY c) AS k FROM p) SELECT page, min(c) AS start, max(c) + 1 AS \"end\" FROM g GROUP BY page, k")
def w09(spark, d):
    return merged_intervals(_spans(spark, d), ["page"])


@query("w09_uncovered", f"WITH e AS ({_SPAN.format(9)}), p AS (SELECT DISTINCT page, unnest(range(start, \"end\")) AS c FROM e), f AS (SELECT DISTINCT page, unnest(range(0, 1030)) AS c FROM e), x AS (SELECT * FROM f EXCEPT SELECT * FROM p), g AS (SELECT page, c, c - row_number() OVER (PARTITION BY page ORDER BY c) AS k FROM x) SELECT page, min(c) AS start, max(c) + 1 AS \"end\" FROM g GROUP BY page, k")
def w09b(spark, d):
    return uncovered(_spans(spark, d).withColumn("len", F.lit(1030)), ["page"], "len")


@query("w10_threshold_sweep", f"WITH s AS ({_SCORED}), t AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM t) SELECT score AS threshold, tp::DOUBLE AS tp, fp::DOUBLE AS fp FROM c WHERE tp / (tp + fp) >= 0.9 AND tp + fp >= 20 ORDER BY tp DESC, score DESC LIMIT 1")
def w10(spark, d):
    return best_threshold(_scored(spark, d), "score", "label", 0.9, 20)


@query("w11_gap_to_maximum", oracle("SELECT claim_id, round(max(score) OVER (PARTITION BY subject) - score, 4) AS gap FROM claims", "claims"))
def w11(spark, d):
    return view(spark, d, "claims").select("claim_id", F.round(F.max("score").over(Window.partitionBy("subject")) - F.col("score"), 4).alias("gap"))


@query("w12_priority_pick", oracle("SELECT subject, min_by(relation, (CASE relation WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END, relation)) AS primary_rule, string_agg(DISTINCT relation, ',' ORDER BY relation) AS evidence FROM claims GROUP BY subject", "claims"))
def w12(spark, d):
    rank = F.when(F.col("relation") == "1-URGENT", 1).when(F.col("relation") == "2-HIGH", 2).otherwise(9)
    return view(spark, d, "claims").groupBy("subject").agg(F.min_by("relation", F.struct(rank, "relation")).alias("primary_rule"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("evidence"))


@query("w13_sticky_state", oracle("SELECT claim_id, coalesce(max(CASE WHEN score > 480000 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS back_matter FROM claims", "claims"))
def w13(spark, d):
    w = Window.partitionBy("subject").orderBy("claim_id").rowsBetween(Window.unboundedPreceding, -1)
    return view(spark, d, "claims").select("claim_id", F.coalesce(F.max((F.col("score") > 480000).cast("int")).over(w), F.lit(0)).alias("back_matter"))


@query(
    "w14_sentence_assembly",
    r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    s AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(piece, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM p)
    SELECT doc_id, CAST(sentence AS BIGINT) AS sentence, string_agg(piece, ' ' ORDER BY pos) AS text FROM s GROUP BY doc_id, sentence""",
)
def w14(spark, d):
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "piece"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    named = pieces.withColumn("sentence", F.coalesce(F.sum(F.col("piece").rlike("[.!?]$").cast("int")).over(w), F.lit(0)))
    return named.groupBy("doc_id", "sentence").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("text"))


@query("w15_position_sample", oracle("SELECT volume, claim_id, k - 1 AS place FROM (SELECT volume, claim_id, row_number() OVER (PARTITION BY volume ORDER BY score DESC, claim_id) AS k, count(*) OVER (PARTITION BY volume) AS n FROM claims) x WHERE k - 1 IN (0, 1, 2, n // 10, n // 4, n // 2, 3 * n // 4)", "claims"))
def w15(spark, d):
    w = Window.partitionBy("volume")
    rows = view(spark, d, "claims").select("volume", "claim_id", (F.row_number().over(w.orderBy(F.desc("score"), "claim_id")) - 1).cast("long").alias("place"), F.count("*").over(w).alias("n"))
    return rows.where("place in (0, 1, 2, n div 10, n div 4, n div 2, 3 * n div 4)").select("volume", "claim_id", "place")
