"""Remaining listings, predicates and audits of the public surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions.vectors import dot, unit
from claimloom.model import oracle, table, view
from claimloom.operators.aggregates import differences, reconciled
from claimloom.operators.components import connected_components
from claimloom.operators.facets import FilterSpec, filtered_tags
from claimloom.operators.joins import overlapping
from claimloom.operators.labels import best_span, match_ladder
from claimloom.plans.lineage import settled
from claimloom.registry import query

#: Month names as dates spell them.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def similar_tags(tags: DataFrame, vectors: DataFrame, anchor: str, floor: float = 0.9, most: int | None = 100) -> DataFrame:
    """Tags at or over ``floor`` by cosine to the anchor, which stays visible and first whatever its score; the best ``most``, or all."""
    own = vectors.join(tags, "tag").select("tag", "frequency", unit(F.col("embedding")).alias("v"))
    mine = own.where(F.col("tag") == anchor).select(F.col("v").alias("a"))
    scored = own.join(F.broadcast(mine)).select("tag", "frequency", dot(F.col("v"), F.col("a")).alias("similarity"))
    shown = scored.where((F.col("similarity") >= floor) | (F.col("tag") == anchor)).orderBy(F.col("tag") != anchor, F.desc("similarity"), "tag")
    return shown if most is None else shown.limit(most)


def facet_counts(claims: DataFrame, spec: FilterSpec, roles=("s_cat", "r_cat", "o_cat")) -> DataFrame:
    """``role, value, n``: each facet counted under the other facets' filters."""
    out = None
    for role in roles:
        part = claims.where(spec.columns(without=role)).groupBy(F.col(role).alias("value")).agg(F.count("*").alias("n")).select(F.lit(role).alias("role"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def _scoped(claims: DataFrame) -> DataFrame:
    """Each claim under ``corpus`` and under its volume."""
    return claims.withColumn("scope", F.explode(F.array(F.lit("corpus"), F.col("volume"))))


def catalog(claims: DataFrame) -> DataFrame:
    """``scope, claims, entities, relations, sentences, pages`` of the corpus and of each volume."""
    rows = _scoped(claims)
    plain = rows.groupBy("scope").agg(F.count("*").alias("claims"), F.count_distinct("relation").alias("relations"), F.count_distinct("sid").alias("sentences"), F.count_distinct("volume", "page").alias("pages"))
    ends = rows.select("scope", F.explode(F.array("subject", "object")).alias("tag")).groupBy("scope").agg(F.count_distinct("tag").alias("entities"))
    return plain.join(ends, "scope").select("scope", "claims", "entities", "relations", "sentences", "pages")


def claim_record(claims: DataFrame, sentences: DataFrame, claim_id: int) -> DataFrame:
    """One claim with the text of its sentence; no row for an unknown id."""
    one = claims.where(F.col("claim_id") == claim_id).select("claim_id", "sid", "volume", "page", "subject", "relation", "object")
    return one.join(sentences.select("sid", "lang", "text"), "sid", "left")


def atlas(claims: DataFrame) -> DataFrame:
    """``scope, nodes, edges, claims, components`` of the corpus graph and of each volume's, all at once."""
    rows = _scoped(claims)
    named = lambda c: F.concat("scope", F.lit(":"), c)
    edges = settled(rows.select("scope", F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct())
    components = connected_components(edges.select(named("a").alias("a"), named("b").alias("b")), "a", "b")
    nodes = components.groupBy(F.split("node", ":")[0].alias("scope")).agg(F.count("*").alias("nodes"), F.count_if(F.col("node") == F.col("component")).alias("components"))
    return rows.groupBy("scope").agg(F.count("*").alias("claims")).join(edges.where("a <> b").groupBy("scope").agg(F.count("*").alias("edges")), "scope").join(nodes, "scope").select("scope", "nodes", "edges", "claims", "components")


def page_view(claims: DataFrame, sentences: DataFrame, volume: str, page: int, variant: str = "claims") -> DataFrame:
    """A page's claims in order, or (``text``) its sentences with the number of their claims."""
    here = lambda f: f.where((F.col("volume") == volume) & (F.col("page") == page))
    if variant == "claims":
        return here(claims).select("sid", "ordinal", "claim_id", "subject", "relation", "object").orderBy("sid", "ordinal", "claim_id")
    if variant != "text":
        raise ValueError("variant must be claims or text")
    counts = claims.groupBy("sid").agg(F.count("*").alias("claims"))
    return here(sentences).select("sid", "text").join(counts, "sid", "left").select("sid", "text", F.coalesce("claims", F.lit(0)).alias("claims")).orderBy("sid")


def line_kinds(c) -> F.Column:
    """date, footnote, publisher or null for a line."""
    return F.when(c.rlike(rf"(?i)\b[0-9]{{1,2}}\s+({MONTHS})\s+[0-9]{{4}}\b|\b({MONTHS})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}\b"), "date").when(c.rlike(r"^\s*(\[[0-9]+\]|[0-9]+[.)])\s"), "footnote").when(c.rlike(r"(?i)\b(press|publisher|published by|printed at)\b"), "publisher")


def dictionary_rows(entries: DataFrame) -> DataFrame:
    """``roman, pos, sense`` from ``senses`` whose items are tab-separated part of speech and meaning; repeats go, order stays."""
    rows = entries.select("roman", F.posexplode("senses").alias("at", "s")).select("roman", "at", F.split("s", "\t").alias("p"))
    rows = rows.select("roman", "at", F.when(F.size("p") > 1, F.col("p")[0]).alias("pos"), F.element_at("p", -1).alias("sense"))
    return rows.groupBy("roman", "pos", "sense").agg(F.min("at").alias("at"))


def cached_glosses(cache: DataFrame, page: DataFrame) -> DataFrame:
    """Cached glosses of a page on its present tokens: by ranges that overlap, the larger share first.

    Both sides hold ``page, tok`` numbers and token ``size``; ranges come from running sizes.
    """
    w = Window.partitionBy("page").orderBy("tok")
    placed = lambda f: f.withColumn("end", F.sum("size").over(w)).withColumn("start", F.col("end") - F.col("size"))
    old, new = placed(cache).select("page", F.col("start").alias("_s"), F.col("end").alias("_e"), "gloss"), placed(page)
    shared = F.least("end", "_e") - F.greatest("start", "_s")
    met = overlapping(new, old, ["page"], 64).withColumn("shared", shared)
    best = met.groupBy("page", "tok").agg(F.max_by("gloss", F.struct("shared", -F.col("_s"))).alias("gloss"))
    return page.select("page", "tok").join(best, ["page", "tok"], "left")


@query("t02_has_more", oracle("SELECT claim_id FROM claims WHERE volume = 'vol1' ORDER BY claim_id LIMIT 26", "claims"))
def t02(spark, d):
    return view(spark, d, "claims").where("volume = 'vol1'").select("claim_id").orderBy("claim_id").limit(25 + 1)


@query("t08_own_role_excluded", oracle("SELECT subject AS tag, count(*) AS frequency FROM claims WHERE volume = 'vol2' AND relation = '5-LOW' GROUP BY subject", "claims"))
def t08(spark, d):
    return filtered_tags(view(spark, d, "claims"), FilterSpec(volume=("vol2",), relation=("5-LOW",), subject=("n7",)), "subject")


@query("t08_similar_tags", oracle("SELECT v.tag, t.frequency, round(list_cosine_similarity(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), 5) AS similarity FROM vectors v JOIN tags t ON t.tag = v.tag, (SELECT embedding FROM vectors WHERE tag = 'n7') a WHERE v.tag = 'n7' OR list_cosine_similarity(v.embedding::DOUBLE[], a.embedding::DOUBLE[]) >= 0.2", "vectors", "tags"))
def t08b(spark, d):
    return similar_tags(view(spark, d, "tags"), view(spark, d, "vectors"), "n7", 0.2, None).withColumn("similarity", F.round("similarity", 5))


@query("g13_facet_counts", oracle("SELECT 's_cat' AS role, s_cat AS value, count(*) AS n FROM claims WHERE r_cat = 'R1' GROUP BY s_cat UNION ALL SELECT 'r_cat', r_cat, count(*) FROM claims WHERE s_cat IN ('E1', 'E2') GROUP BY r_cat UNION ALL SELECT 'o_cat', o_cat, count(*) FROM claims WHERE r_cat = 'R1' AND s_cat IN ('E1', 'E2') GROUP BY o_cat", "claims"))
def g13(spark, d):
    return facet_counts(view(spark, d, "claims"), FilterSpec(s_cat=("E1", "E2"), r_cat=("R1",)))


_SCOPED = ", x AS (SELECT *, unnest(['corpus', volume]) AS scope FROM claims)"


@query("e_catalog", oracle(_SCOPED + " SELECT c.*, e.entities FROM (SELECT scope, count(*) AS claims, count(DISTINCT relation) AS relations, count(DISTINCT sid) AS sentences, count(DISTINCT volume || page) AS pages FROM x GROUP BY scope) c JOIN (SELECT scope, count(DISTINCT tag) AS entities FROM (SELECT scope, unnest([subject, object]) AS tag FROM x) y GROUP BY scope) e ON e.scope = c.scope", "claims").replace("c.*", "c.scope, c.claims, c.relations, c.sentences, c.pages"))
def e_catalog(spark, d):
    return catalog(view(spark, d, "claims"))


@query("e_claim", oracle("SELECT c.claim_id, c.sid, c.volume, c.page, c.subject, c.relation, c.object, s.lang, s.text FROM claims c LEFT JOIN sentences s ON s.sid = c.sid WHERE c.claim_id = 7", "claims", "sentences"))
def e_claim(spark, d):
    return claim_record(view(spark, d, "claims"), view(spark, d, "sentences"), 7)


@query("e_atlas", oracle(_SCOPED + ", e AS (SELECT DISTINCT scope, least(subject, object) AS a, greatest(subject, object) AS b FROM x), k AS (SELECT scope, a AS x, b AS y FROM e UNION SELECT scope, b, a FROM e), r AS (WITH RECURSIVE w(scope, x, y) AS (SELECT scope, x, x FROM k UNION SELECT w.scope, w.x, k.y FROM w JOIN k ON k.scope = w.scope AND k.x = w.y) SELECT * FROM w), n AS (SELECT scope, x, min(y) AS c FROM r GROUP BY scope, x) SELECT q.scope, q.nodes, q.components, (SELECT count(*) FROM e WHERE e.scope = q.scope AND a <> b) AS edges, (SELECT count(*) FROM x WHERE x.scope = q.scope) AS claims FROM (SELECT scope, count(*) AS nodes, count(DISTINCT c) AS components FROM n GROUP BY scope) q", "claims"))
def e_atlas(spark, d):
    return atlas(view(spark, d, "claims"))


@query("e_page", oracle("SELECT s.sid, s.text, count(c.claim_id) AS claims FROM sentences s LEFT JOIN claims c ON c.sid = s.sid WHERE s.volume = 'vol2' AND s.page = 11 GROUP BY s.sid, s.text", "claims", "sentences"))
def e_page(spark, d):
    return page_view(view(spark, d, "claims"), view(spark, d, "sentences"), "vol2", 11, "text")


@query("f21_line_kinds", rf"SELECT doc_id, CAST(line AS INT) AS line, CASE WHEN regexp_matches(value, '(?i)\b[0-9]{{1,2}}\s+({MONTHS})\s+[0-9]{{4}}\b|\b({MONTHS})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}\b') THEN 'date' WHEN regexp_matches(value, '^\s*(\[[0-9]+\]|[0-9]+[.)])\s') THEN 'footnote' WHEN regexp_matches(value, '(?i)\b(press|publisher|published by|printed at)\b') THEN 'publisher' END AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) x")
def f21(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return lines.select("doc_id", "line", line_kinds(F.col("value")).alias("kind"))


@query("x13_match_ladder")
def x13(spark, d):
    return table(spark, d, "documents").select("doc_id", match_ladder("text", F.upper(F.substring("text", 30, 25))).alias("m")).select("doc_id", "m.*")


@query("x14_best_span")
def x14(spark, d):
    return table(spark, d, "documents").select("doc_id", best_span("text", F.concat(F.substring("text", 30, 12), F.lit("#"), F.substring("text", 43, 12))).alias("m")).select("doc_id", "m.*")


@query("x23_loose_numbers", "SELECT c_custkey, TRY_CAST(CASE WHEN regexp_full_match(translate(substr(c_name, 10), 'Oo', '00'), '[0-9]+') THEN translate(substr(c_name, 10), 'Oo', '00') END AS BIGINT) AS n FROM customer")
def x23(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.loose_number(F.expr("substr(c_name, 10)")).alias("n"))


@query("x28_script", "SELECT doc_id, CASE WHEN regexp_matches(text, '[က-႟]') THEN 'my' ELSE 'en' END AS script FROM documents")
def x28(spark, d):
    return table(spark, d, "documents").select("doc_id", T.script(F.col("text")).alias("script"))


@query("x31_dictionary", "SELECT p_brand AS roman, p_type AS pos, p_size || '' AS sense, count(*) > 0 AS seen FROM part GROUP BY ALL")
def x31(spark, d):
    entries = table(spark, d, "part").groupBy(F.col("p_brand").alias("roman")).agg(F.collect_list(F.concat("p_type", F.lit("\t"), F.col("p_size").cast("string"))).alias("senses"))
    return dictionary_rows(entries).select("roman", "pos", "sense", F.lit(True).alias("seen"))


@query("q03_schema_checks", "SELECT event_id, json_extract(props, '$.k') IS NULL AS missing, len(json_keys(props)) <> 1 AS extra FROM events")
def q03(spark, d):
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").isNull().alias("missing"), (F.size(keys) != 1).alias("extra"))


@query("q04_exclusion_audit", oracle("SELECT tag, 'unexpected' AS side FROM (SELECT tag FROM tags EXCEPT SELECT subject FROM claims) x", "claims", "tags"))
def q04(spark, d):
    active = view(spark, d, "claims").select(F.col("subject").alias("tag")).distinct()
    return differences(active, view(spark, d, "tags").select("tag"))


@query("u09_carried_mappings", "SELECT c_custkey AS k, c_nationkey AS v, CASE WHEN c_custkey % 10 = 0 THEN 'restored' WHEN c_custkey % 7 = 0 AND c_nationkey <> 1 THEN 'kept' ELSE 'same' END AS state FROM customer")
def u09(spark, d):
    old = table(spark, d, "customer").selectExpr("c_custkey as k", "c_nationkey as v")
    new = old.where("k % 10 <> 0").select("k", F.when(F.col("k") % 7 == 0, F.lit(1)).otherwise(F.col("v")).alias("v"))
    return reconciled(old, new, "k", "v")


_V10 = """WITH o AS (SELECT user_id AS page, event_id AS tok, event_type AS gloss, sum(1 + event_id % 4) OVER w AS e, sum(1 + event_id % 4) OVER w - (1 + event_id % 4) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  n AS (SELECT user_id AS page, event_id AS tok, sum(2 + event_id % 3) OVER w AS e, sum(2 + event_id % 3) OVER w - (2 + event_id % 3) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  m AS (SELECT n.page, n.tok, o.gloss, row_number() OVER (PARTITION BY n.page, n.tok ORDER BY least(n.e, o.e) - greatest(n.s, o.s) DESC, o.s) AS k FROM n JOIN o ON o.page = n.page AND o.s < n.e AND n.s < o.e)
  SELECT n.page, n.tok, m.gloss FROM n LEFT JOIN m ON m.page = n.page AND m.tok = n.tok AND m.k = 1"""


@query("v10_cached_glosses", _V10)
def v10(spark, d):
    e = table(spark, d, "events")
    cache = e.selectExpr("user_id as page", "event_id as tok", "1 + event_id % 4 as size", "event_type as gloss")
    return cached_glosses(cache, e.selectExpr("user_id as page", "event_id as tok", "2 + event_id % 3 as size"))


@query("s11_evidence_rows", oracle("SELECT c.claim_id, c.subject, a.frequency, s.lang FROM claims c JOIN tags a ON a.tag = c.subject JOIN sentences s ON s.sid = c.sid WHERE c.volume = 'vol1'", "claims", "tags", "sentences"))
def s11(spark, d):
    claims = view(spark, d, "claims").where("volume = 'vol1'").select("claim_id", "sid", "subject")
    rows = claims.join(view(spark, d, "tags").toDF("subject", "frequency"), "subject").join(view(spark, d, "sentences").select("sid", "lang"), "sid")
    return rows.select("claim_id", "subject", "frequency", "lang")
