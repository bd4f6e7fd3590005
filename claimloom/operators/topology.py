"""Subgraphs of a scope within budgets, bundles of categories, and the evidence behind an edge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.model import oracle, view
from claimloom.operators.facets import FilterSpec, clamp, oriented
from claimloom.plans.lineage import cut
from claimloom.registry import query

ORDER = ["volume", "page", "sid", "ordinal", "claim_id"]
KINDS = ("corpus", "page", "range", "tags", "entity", "relation", "claim")
#: Claims and nodes that one answer holds at most (fixed values).
MOST_CLAIMS, MOST_NODES = 1000, 600
#: Rows of evidence on one page at most (fixed value).
MOST_EVIDENCE = 100


@dataclass(frozen=True)
class Scope:
    """Which claims a subgraph is of; ``kind`` says which of the other fields count."""

    kind: str = "corpus"
    volume: str = ""
    start_page: int | None = None
    end_page: int | None = None
    values: tuple[str, ...] = ()
    sid: int | None = None
    ordinal: int | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"scope must be one of {', '.join(KINDS)}")
        if self.kind in ("page", "range"):
            if self.volume not in ("vol1", "vol2", "vol3") or self.start_page is None or self.start_page < 1:
                raise ValueError("a volume and a page from 1 are needed")
            if self.kind == "range" and (self.end_page is None or self.end_page < self.start_page):
                raise ValueError("the range ends before it begins")
        if self.kind in ("tags", "entity", "relation") and not 1 <= len(self.values) <= 100:
            raise ValueError("from 1 to 100 tags are needed")
        if self.kind == "claim" and (self.sid is None or self.ordinal is None):
            raise ValueError("a sentence and an ordinal are needed")

    def columns(self) -> Column:
        if self.kind == "page":
            return (F.col("volume") == self.volume) & (F.col("page") == self.start_page)
        if self.kind == "range":
            return (F.col("volume") == self.volume) & F.col("page").between(self.start_page, self.end_page)
        if self.kind in ("tags", "entity"):
            return F.col("subject").isin(*self.values) | F.col("object").isin(*self.values)
        if self.kind == "relation":
            return F.col("relation").isin(*self.values)
        if self.kind == "claim":
            return (F.col("sid") == self.sid) & (F.col("ordinal") == self.ordinal)
        return F.lit(True)


@dataclass
class Subgraph:
    """``nodes(tag, frequency, degree, anchor)``, ``edges(subject, relation, object, claims, claim_id)`` and one row of ``counts``."""

    nodes: DataFrame
    edges: DataFrame
    counts: DataFrame


def topology(claims: DataFrame, tags: DataFrame, scope: Scope, depth: int = 1, limit: int = 300, nodes: int = MOST_NODES) -> Subgraph:
    """The subgraph of a scope: its first ``limit`` claims in reading order, then the first ``nodes`` of their names.

    With ``depth`` 2 half of the claims are kept for those of names met in the first half. An
    edge is a subject, relation and object with its claims and the first of them; a node has
    its frequency in all claims, its degree here and whether the scope names it. ``truncated``
    says that the scope has more claims than are returned or names were left out. Only what
    the scope selects is sorted, and answers are bounded by the budgets.
    """
    if depth not in (1, 2):
        raise ValueError("depth must be 1 or 2")
    limit = clamp(limit, MOST_CLAIMS)
    own = claims.where(scope.columns())
    # claims at depth 1 count towards the total; what a second hop adds is a sample by design
    first = cut(own.orderBy(*ORDER).limit(max(1, limit // 2) if depth == 2 else limit))
    taken = first
    if depth == 2:
        names = first.select(F.col("subject").alias("tag")).union(first.select("object")).distinct()
        beyond = claims.join(F.broadcast(names), F.col("subject") == F.col("tag"), "left_semi").union(claims.join(F.broadcast(names), F.col("object") == F.col("tag"), "left_semi"))
        fresh = beyond.dropDuplicates(["claim_id"]).join(F.broadcast(first.select("claim_id")), "claim_id", "left_anti").select(*first.columns)  # at most MOST_CLAIMS each
        taken = cut(first.unionByName(fresh.orderBy(*ORDER).limit(limit - limit // 2)))
    place = F.struct(*ORDER)
    ends = taken.select(F.col("subject").alias("tag"), place.alias("at")).union(taken.select("object", place))
    met = ends.groupBy("tag").agg(F.min("at").alias("at"))
    ranked = cut(met.withColumn("n", F.row_number().over(Window.orderBy("at", "tag"))))  # bounded by twice the claims
    kept = ranked.where(F.col("n") <= nodes).select("tag")
    inside = cut(taken.join(F.broadcast(kept.toDF("subject")), "subject", "left_semi").join(F.broadcast(kept.toDF("object")), "object", "left_semi"))
    edges = inside.groupBy("subject", "relation", "object").agg(F.count("*").alias("claims"), F.min_by("claim_id", place).alias("claim_id"))
    touched = inside.select(F.col("subject").alias("tag"), F.col("object").alias("other")).union(inside.select("object", "subject"))
    degree = touched.where("tag <> other").groupBy("tag").agg(F.count_distinct("other").alias("degree"))
    anchor = F.col("tag").isin(*scope.values) if scope.kind in ("tags", "entity") else F.lit(False)
    out = kept.join(tags.select("tag", "frequency"), "tag", "left").join(degree, "tag", "left").select("tag", "frequency", F.coalesce("degree", F.lit(0)).alias("degree"), anchor.alias("anchor"))
    total = own.agg(F.count("*").alias("total"))
    shown = first.join(inside.select("claim_id"), "claim_id", "left_semi").agg(F.count("*").alias("own"))
    counts = total.join(shown).join(inside.agg(F.count("*").alias("claims"))).select("total", "claims", (F.col("total") > F.col("own")).alias("truncated"))
    return Subgraph(out, edges, counts)


def category_topology(claims: DataFrame, scope: Scope, spec: FilterSpec | None = None, a: tuple = (), relations: tuple = (), b: tuple = (), direction: str = "ab") -> DataFrame:
    """``source, relation, target, claims, sentences, pairs``: bundles of categories in a scope.

    ``spec`` narrows by tags; ``a``, ``relations`` and ``b`` are categories of the two sides,
    read forward (``ab``), backward or either way. Claims that fit both ways count once.
    """
    rows = claims.where(scope.columns() & (spec.columns() if spec else F.lit(True)))
    fit = oriented(rows, a, relations, b, direction)
    both = F.count_distinct(F.struct("subject", "object")).alias("pairs")
    return fit.groupBy(F.col("s_cat").alias("source"), F.col("r_cat").alias("relation"), F.col("o_cat").alias("target")).agg(F.count("*").alias("claims"), F.count_distinct("sid").alias("sentences"), both)


def evidence(claims: DataFrame, sentences: DataFrame, match: Column, offset: int = 0, limit: int = 20) -> DataFrame:
    """``total, claim_id, sid, subject, relation, object, lang, text``: a page of the claims that ``match`` with their sentences.

    In reading order; ``total`` counts all that match. A claim whose sentence is missing stays, with nulls.
    """
    own = claims.where(match)
    total = own.agg(F.count("*").alias("total"))
    page = own.orderBy(*ORDER).offset(max(0, offset)).limit(clamp(limit, MOST_EVIDENCE))
    # a page has a hundred rows at most: the sentences are probed with it, not shuffled
    texts = sentences.join(F.broadcast(page.select("sid").distinct()), "sid", "left_semi").select("sid", "lang", "text")
    return page.join(texts, "sid", "left").join(total).select("total", "claim_id", "sid", "subject", "relation", "object", "lang", "text")


def triple(source: str, relation: str, target: str, sid: int | None = None, ordinal: int | None = None) -> Column:
    """Claims of exactly this subject, relation and object, or the one of them at a place."""
    out = (F.col("subject") == source) & (F.col("relation") == relation) & (F.col("object") == target)
    return out & (F.col("sid") == sid) & (F.col("ordinal") == ordinal) if sid is not None and ordinal is not None else out


def bundle(source: str, target: str, relations: tuple = (), spec: FilterSpec | None = None, scope: Scope | None = None) -> Column:
    """Claims from one category to another, within categories of relations, tags and a scope."""
    out = (F.col("s_cat") == source) & (F.col("o_cat") == target) & (F.col("r_cat").isin(*relations) if relations else F.lit(True))
    return out & (spec.columns() if spec else F.lit(True)) & (scope.columns() if scope else F.lit(True))


def _edges_sql(where: str, limit: int, nodes: int = MOST_NODES) -> str:
    return oracle(
        f""", own AS (SELECT * FROM claims WHERE {where}), k AS (SELECT * FROM own ORDER BY volume, page, sid, ordinal, claim_id LIMIT {limit}),
  p AS (SELECT *, row_number() OVER (ORDER BY volume, page, sid, ordinal, claim_id) AS place FROM k),
  n AS (SELECT tag FROM (SELECT subject AS tag, place FROM p UNION ALL SELECT object, place FROM p) x GROUP BY tag ORDER BY min(place), tag LIMIT {nodes}),
  i AS (SELECT * FROM p WHERE subject IN (SELECT tag FROM n) AND object IN (SELECT tag FROM n))
  SELECT subject, relation, object, count(*) AS claims, arg_min(claim_id, place) AS claim_id, (SELECT count(*) FROM own) > (SELECT count(*) FROM i) AS truncated FROM i GROUP BY subject, relation, object""",
        "claims",
    )


def _edges(spark, d, scope: Scope, limit: int, nodes: int = MOST_NODES) -> DataFrame:
    found = topology(view(spark, d, "claims"), view(spark, d, "tags"), scope, 1, limit, nodes)
    return found.edges.join(found.counts.select("truncated"))


@query("topology_page", _edges_sql("volume = 'vol2' AND page = 11", 500))
def page_topology(spark, d):
    return _edges(spark, d, Scope("page", "vol2", 11), 500)


@query("topology_range", _edges_sql("volume = 'vol1' AND page BETWEEN 5 AND 30", 300, 40))
def range_topology(spark, d):
    return _edges(spark, d, Scope("range", "vol1", 5, 30), 300, 40)


@query("topology_relation", _edges_sql("relation IN ('2-HIGH')", 300))
def relation_topology(spark, d):
    return _edges(spark, d, Scope("relation", values=("2-HIGH",)), 300)


@query("topology_claim", _edges_sql("sid = 100 AND ordinal = 2", 300))
def claim_topology(spark, d):
    return _edges(spark, d, Scope("claim", sid=100, ordinal=2), 300)


@query("topology_tags", _edges_sql("subject IN ('n7', 'n8', 'n1003') OR object IN ('n7', 'n8', 'n1003')", 300))
def tags_topology(spark, d):
    return _edges(spark, d, Scope("tags", values=("n7", "n8", "n1003")), 300)


@query(
    "topology_nodes",
    oracle(
        """, k AS (SELECT * FROM claims WHERE volume = 'vol3' AND page BETWEEN 1 AND 20 ORDER BY volume, page, sid, ordinal, claim_id LIMIT 400),
  e AS (SELECT subject AS tag, object AS other FROM k UNION ALL SELECT object, subject FROM k)
  SELECT e.tag, any_value(t.frequency) AS frequency, count(DISTINCT other) FILTER (other <> e.tag) AS degree FROM e JOIN tags t ON t.tag = e.tag GROUP BY e.tag""",
        "claims",
        "ends",
        "tags",
    ),
)
def topology_nodes(spark, d):
    return topology(view(spark, d, "claims"), view(spark, d, "tags"), Scope("range", "vol3", 1, 20), 1, 400, 1000).nodes.drop("anchor")


_BUNDLES = "SELECT s_cat AS source, r_cat AS relation, o_cat AS target, count(*) AS claims, count(DISTINCT sid) AS sentences, count(DISTINCT (subject, object)) AS pairs FROM claims WHERE {} GROUP BY s_cat, r_cat, o_cat"


@query("category_topology", oracle(_BUNDLES.format("volume = 'vol1' AND page BETWEEN 1 AND 60 AND r_cat IN ('R1', 'R2') AND ((s_cat IN ('E1', 'E2') AND o_cat IN ('E3', 'E4')) OR (o_cat IN ('E1', 'E2') AND s_cat IN ('E3', 'E4')))"), "claims"))
def category_bundles(spark, d):
    return category_topology(view(spark, d, "claims"), Scope("range", "vol1", 1, 60), None, ("E1", "E2"), ("R1", "R2"), ("E3", "E4"), "either")


@query("category_topology_tags", oracle(_BUNDLES.format("(subject IN ('n7', 'n8') OR object IN ('n7', 'n8'))"), "claims"))
def category_bundles_of_tags(spark, d):
    return category_topology(view(spark, d, "claims"), Scope("corpus"), FilterSpec(entity=("n7", "n8")))


_EVIDENCE = """, own AS (SELECT * FROM claims WHERE {}), k AS (SELECT * FROM own ORDER BY volume, page, sid, ordinal, claim_id LIMIT {} OFFSET {})
  SELECT (SELECT count(*) FROM own) AS total, k.claim_id, k.sid, k.subject, k.relation, k.object, s.lang, s.text FROM k LEFT JOIN sentences s ON s.sid = k.sid"""


@query("evidence", oracle(", f AS (SELECT subject AS fs, relation AS fr, object AS fo FROM claims WHERE claim_id = 8)" + _EVIDENCE.format("(subject, relation, object) IN (SELECT (fs, fr, fo) FROM f)", 20, 0), "claims", "sentences"))
def triple_evidence(spark, d):
    claims = view(spark, d, "claims")
    one = claims.where("claim_id = 8").select("subject", "relation", "object").first()
    return evidence(claims, view(spark, d, "sentences"), triple(*one))


@query("category_evidence", oracle(_EVIDENCE.format("s_cat = 'E1' AND o_cat = 'E3' AND r_cat IN ('R1', 'R5')", 20, 5), "claims", "sentences"))
def bundle_evidence(spark, d):
    return evidence(view(spark, d, "claims"), view(spark, d, "sentences"), bundle("E1", "E3", ("R1", "R5")), 5, 20)
