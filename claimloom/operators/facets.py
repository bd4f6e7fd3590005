"""Filters, facet counts, listings and pages over claims."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.model import oracle, view
from claimloom.registry import query

MOST_VALUES, MOST_CHARS = 100, 300
ENTITY_ID, SENTENCE_ID = re.compile(r"e_[0-9a-f]{32}"), re.compile(r"vol[123]_.+")


@dataclass(frozen=True)
class FilterSpec:
    """A facet request; empty tuples constrain nothing, values of one field OR, fields AND."""

    volume: tuple[str, ...] = ()
    subject: tuple[str, ...] = ()
    relation: tuple[str, ...] = ()
    object: tuple[str, ...] = ()
    entity: tuple[str, ...] = ()
    s_cat: tuple[str, ...] = ()
    r_cat: tuple[str, ...] = ()
    o_cat: tuple[str, ...] = ()
    contains: str = ""
    page_start: int | None = None
    page_end: int | None = None

    @classmethod
    def parse(cls, parameters: dict) -> FilterSpec:
        """Check a request before any plan is built; repeated and comma-joined values merge in order."""
        known, out = {f.name: f for f in fields(cls)}, {}
        for name, value in parameters.items():
            if name not in known:
                raise ValueError(f"unknown parameter {name}")
            if name in ("page_start", "page_end"):
                out[name] = int(value)
            elif name == "contains":
                out[name] = str(value)
            else:
                parts = [value] if isinstance(value, str) else list(value)
                out[name] = tuple(dict.fromkeys(p.strip() for x in parts for p in x.split(",") if p.strip()))
        spec = cls(**out)
        for f in fields(cls):
            value = getattr(spec, f.name)
            if isinstance(value, tuple) and (len(value) > MOST_VALUES or any(len(v) > MOST_CHARS for v in value)):
                raise ValueError(f"{f.name} has too many or too long values")
        if any(v not in ("vol1", "vol2", "vol3") for v in spec.volume):
            raise ValueError("volume must be vol1, vol2 or vol3")
        if (spec.page_start is not None or spec.page_end is not None) and len(spec.volume) != 1:
            raise ValueError("pages need one volume")
        if spec.page_start is not None and spec.page_end is not None and spec.page_start > spec.page_end:
            raise ValueError("page_start is after page_end")
        return spec

    def columns(self, without: str = "") -> Column:
        """The conjunction, leaving out the field ``without`` (a facet never narrows itself)."""
        out = F.lit(True)
        for name in ("volume", "subject", "relation", "object", "s_cat", "r_cat", "o_cat"):
            if name != without and getattr(self, name):
                out = out & F.col(name).isin(*getattr(self, name))
        if self.entity and without != "entity":
            out = out & (F.col("subject").isin(*self.entity) | F.col("object").isin(*self.entity))
        if self.contains:
            needle = F.lower(F.lit(self.contains))
            out = out & (F.lower("subject").contains(needle) | F.lower("object").contains(needle) | F.lower("relation").contains(needle))
        if self.page_start is not None:
            out = out & (F.col("page") >= self.page_start)
        if self.page_end is not None:
            out = out & (F.col("page") <= self.page_end)
        return out


def check_id(value: str, kind: str) -> str:
    """An id that matches its syntax whole; anything else is refused before it nears a plan."""
    if not (ENTITY_ID if kind == "entity" else SENTENCE_ID).fullmatch(value):
        raise ValueError(f"not a valid {kind} id")
    return value


def oriented(claims: DataFrame, a: Sequence[str], relations: Sequence[str], b: Sequence[str], direction: str = "either") -> DataFrame:
    """Claims whose sides fit (a, b) forward or reversed, with the ``orientations`` that fit."""
    if direction not in ("either", "ab", "ba"):
        raise ValueError("direction must be either, ab or ba")
    fit = lambda c, values: F.col(c).isin(*values) if values else F.lit(True)
    forward = fit("s_cat", a) & fit("o_cat", b) if direction != "ba" else F.lit(False)
    reverse = fit("o_cat", a) & fit("s_cat", b) if direction != "ab" else F.lit(False)
    named = F.array_compact(F.array(F.when(forward, "forward"), F.when(reverse, "reverse")))
    return claims.where(fit("r_cat", relations)).withColumn("orientations", named).where(F.size("orientations") > 0)


def triples(claims: DataFrame, spec: FilterSpec, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of matching claims in volume, page, sentence, ordinal order; the claim id ends the order."""
    return claims.where(spec.columns()).orderBy("volume", "page", "sid", "ordinal", "claim_id").offset(max(0, offset)).limit(clamp(limit, 100))


def thematic_patterns(claims: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Category patterns with their claims, commonest first."""
    rows = claims.where(spec.columns()) if spec else claims
    return rows.groupBy("s_cat", "r_cat", "o_cat").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s_cat", "r_cat", "o_cat")


def filtered_tags(claims: DataFrame, spec: FilterSpec, role: str) -> DataFrame:
    """Tags of one role under all filters but the role's own, by frequency."""
    return claims.where(spec.columns(without=role)).groupBy(F.col(role).alias("tag")).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "tag")


def clamp(value: int, most: int) -> int:
    return max(1, min(int(value), most))


def fingerprint(spec: FilterSpec) -> str:
    rows = {f.name: getattr(spec, f.name) for f in fields(spec)}
    return hashlib.sha256(json.dumps(rows, sort_keys=True, default=list).encode()).hexdigest()[:20]


def encode_cursor(spec: FilterSpec, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "o": offset, "q": fingerprint(spec)}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(spec: FilterSpec, cursor: str) -> int:
    """The offset of a cursor that belongs to this request; any other is refused."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if found["v"] == 1 and found["q"] == fingerprint(spec) and isinstance(found["o"], int) and found["o"] >= 0:
            return found["o"]
    except (ValueError, KeyError, TypeError):
        pass
    raise ValueError("invalid_cursor")


def triples_page(claims: DataFrame, spec: FilterSpec, limit: int = 25, cursor: str | None = None) -> tuple[list, str | None]:
    """Rows and the next cursor, which is there only when a further row is (one more is fetched to see)."""
    at, size = (decode_cursor(spec, cursor) if cursor else 0), clamp(limit, 100)
    order = claims.where(spec.columns()).orderBy("volume", "page", "sid", "ordinal", "claim_id")
    rows = order.offset(at).limit(size + 1).collect()
    return rows[:size], encode_cursor(spec, at + size) if len(rows) > size else None


SPEC = FilterSpec(volume=("vol1",), s_cat=("E1", "E2"), page_start=5, page_end=60)
SPEC_SQL = "volume = 'vol1' AND s_cat IN ('E1', 'E2') AND page BETWEEN 5 AND 60"
CLAIM_COLUMNS = "claim_id, sid, ordinal, volume, page, subject, relation, object"


@query("f01_in_list", oracle(f"SELECT {CLAIM_COLUMNS} FROM claims WHERE relation IN ('1-URGENT', '2-HIGH') AND volume IN ('vol2')", "claims"))
def f01(spark, d):
    return view(spark, d, "claims").where(FilterSpec(volume=("vol2",), relation=("1-URGENT", "2-HIGH")).columns()).select(*CLAIM_COLUMNS.split(", "))


@query("f02_contains_fold", oracle("SELECT sid, source FROM sentences WHERE contains(lower(text), lower('ThAt'))", "sentences"))
def f02(spark, d):
    return view(spark, d, "sentences").where(F.lower("text").contains(F.lower(F.lit("ThAt")))).select("sid", "source")


@query("f03_either_endpoint", oracle("SELECT claim_id, subject, object FROM claims WHERE subject IN ('n7', 'n9') OR object IN ('n7', 'n9')", "claims"))
def f03(spark, d):
    return view(spark, d, "claims").where(FilterSpec(entity=("n7", "n9")).columns()).select("claim_id", "subject", "object")


PAGES = "CASE WHEN claim_id % 5 = 0 THEN {0}(page, page + 1) ELSE {0}(page) END"


@query("f04_pages_scope", oracle("SELECT claim_id, page FROM claims WHERE volume = 'vol3' AND len(list_filter(CASE WHEN claim_id % 5 = 0 THEN [page, page + 1] ELSE [page] END, lambda p: p BETWEEN 20 AND 22)) > 0", "claims"))
def f04(spark, d):
    pages = F.expr(PAGES.format("array"))
    return view(spark, d, "claims").where(F.col("volume") == "vol3").where(F.exists(pages, lambda p: p.between(20, 22))).select("claim_id", "page")


@query(
    "f05_orientation",
    oracle(
        """SELECT claim_id, s_cat IN ('E1','E2') AND o_cat IN ('E3') AS forward, o_cat IN ('E1','E2') AND s_cat IN ('E3') AS reverse FROM claims
    WHERE r_cat IN ('R1','R2') AND ((s_cat IN ('E1','E2') AND o_cat IN ('E3')) OR (o_cat IN ('E1','E2') AND s_cat IN ('E3')))""",
        "claims",
    ),
)
def f05(spark, d):
    rows = oriented(view(spark, d, "claims"), ("E1", "E2"), ("R1", "R2"), ("E3",))
    return rows.select("claim_id", F.array_contains("orientations", "forward").alias("forward"), F.array_contains("orientations", "reverse").alias("reverse"))


@query("f06_composite_facets", oracle(f"SELECT {CLAIM_COLUMNS} FROM claims WHERE {SPEC_SQL}", "claims"))
def f06(spark, d):
    return view(spark, d, "claims").where(SPEC.columns()).select(*CLAIM_COLUMNS.split(", "))


@query("f08_id_syntax", oracle("SELECT count(*) FILTER (regexp_full_match('e_' || substr(sha256(tag), 1, 32), 'e_[0-9a-f]{32}')) AS good, count(*) FILTER (regexp_full_match(tag, 'e_[0-9a-f]{32}')) AS bad FROM tags", "tags"))
def f08(spark, d):
    key, shape = F.concat(F.lit("e_"), F.substring(F.sha2("tag", 256), 1, 32)), f"^(?:{ENTITY_ID.pattern})$"
    return view(spark, d, "tags").agg(F.count_if(key.rlike(shape)).alias("good"), F.count_if(F.col("tag").rlike(shape)).alias("bad"))


@query("facet_buckets", oracle("SELECT relation AS tag, count(*) AS frequency FROM claims WHERE volume = 'vol1' AND s_cat IN ('E1', 'E2') AND page BETWEEN 5 AND 60 GROUP BY relation", "claims"))
def facet_buckets(spark, d):
    spec = FilterSpec(volume=("vol1",), s_cat=("E1", "E2"), relation=("2-HIGH",), page_start=5, page_end=60)
    return filtered_tags(view(spark, d, "claims"), spec, "relation")


@query("a01_frequency", oracle("SELECT tag, count(*) AS mentions, count(*) FILTER (role = 'subject') AS as_subject FROM ends GROUP BY tag", "ends"))
def a01(spark, d):
    return view(spark, d, "ends").groupBy("tag").agg(F.count("*").alias("mentions"), F.count_if(F.col("role") == "subject").alias("as_subject"))


@query("a02_patterns", oracle("SELECT s_cat, r_cat, o_cat, count(*) AS n FROM claims GROUP BY ALL", "claims"))
def a02(spark, d):
    return thematic_patterns(view(spark, d, "claims"))


@query("a03_distinct_sets", oracle("SELECT tag, count(DISTINCT other) AS counterparts, count(DISTINCT relation) AS relations FROM ends GROUP BY tag", "ends"))
def a03(spark, d):
    # two set sizes per tag: pairs first, so that no expanded row goes through the shuffle twice
    return view(spark, d, "ends").groupBy("tag").agg(F.count_distinct("other").alias("counterparts"), F.count_distinct("relation").alias("relations"))


@query("a04_total_and_active", oracle(f"SELECT s_cat, r_cat, o_cat, count(*) AS total, count(*) FILTER ({SPEC_SQL}) AS active FROM claims GROUP BY s_cat, r_cat, o_cat", "claims"))
def a04(spark, d):
    return view(spark, d, "claims").groupBy("s_cat", "r_cat", "o_cat").agg(F.count("*").alias("total"), F.count_if(SPEC.columns()).alias("active"))


@query("a05_edge_collapse", oracle("SELECT subject, relation, object, count(*) AS occurrences, min(claim_id) AS first_claim FROM claims GROUP BY ALL", "claims"))
def a05(spark, d):
    return view(spark, d, "claims").groupBy("subject", "relation", "object").agg(F.count("*").alias("occurrences"), F.min("claim_id").alias("first_claim"))


@query(
    "a06_bundles",
    oracle(
        """SELECT 'subject' AS side, s_cat AS category, r_cat, count(*) AS n, string_agg(DISTINCT o_cat, ',' ORDER BY o_cat) AS others FROM claims GROUP BY s_cat, r_cat
    UNION ALL SELECT 'object', o_cat, r_cat, count(*), string_agg(DISTINCT s_cat, ',' ORDER BY s_cat) FROM claims GROUP BY o_cat, r_cat""",
        "claims",
    ),
)
def a06(spark, d):
    sides = F.explode(F.array(F.struct(F.lit("subject").alias("side"), F.col("s_cat").alias("category"), F.col("o_cat").alias("other")), F.struct(F.lit("object").alias("side"), F.col("o_cat").alias("category"), F.col("s_cat").alias("other"))))
    rows = view(spark, d, "claims").select(sides.alias("x"), "r_cat").select("x.*", "r_cat")
    return rows.groupBy("side", "category", "r_cat").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("other")), ",").alias("others"))


@query(
    "a07_mode_per_bundle",
    oracle(
        """, c AS (SELECT s_cat, o_cat, relation, count(*) AS n FROM claims GROUP BY ALL)
    SELECT s_cat, o_cat, CAST(sum(n) AS BIGINT) AS claims, count(*) AS relations, (array_agg(relation ORDER BY n DESC, relation))[1] AS most_common FROM c GROUP BY s_cat, o_cat""",
        "claims",
    ),
)
def a07(spark, d):
    counts = view(spark, d, "claims").groupBy("s_cat", "o_cat", "relation").agg(F.count("*").alias("n"))
    return counts.groupBy("s_cat", "o_cat").agg(F.sum("n").alias("claims"), F.count("*").alias("relations"), F.min_by("relation", F.struct(-F.col("n"), F.col("relation"))).alias("most_common"))


@query("a08_partition_counters", oracle("SELECT volume, count(*) FILTER (decision = 'F') AS f, count(*) FILTER (decision = 'O') AS o, count(*) FILTER (decision = 'P') AS p FROM claims GROUP BY volume", "claims"))
def a08(spark, d):
    counts = view(spark, d, "claims").groupBy("volume").pivot("decision", ["F", "O", "P"]).count()
    return counts.select("volume", *(F.coalesce(F.col(x), F.lit(0)).alias(x.lower()) for x in "FOP"))


@query("t01_total_order", oracle("SELECT claim_id, row_number() OVER (ORDER BY score DESC, volume, claim_id) AS place FROM claims ORDER BY score DESC, volume, claim_id LIMIT 50", "claims"))
def t01(spark, d):
    top = view(spark, d, "claims").orderBy(F.desc("score"), "volume", "claim_id").limit(50)
    from pyspark.sql import Window

    return top.select("claim_id", F.row_number().over(Window.orderBy(F.desc("score"), "volume", "claim_id")).cast("long").alias("place"))


@query("t03_offset_page", oracle(f"SELECT {CLAIM_COLUMNS} FROM claims WHERE {SPEC_SQL} ORDER BY volume, page, sid, ordinal, claim_id LIMIT 25 OFFSET 25", "claims"))
def t03(spark, d):
    return triples(view(spark, d, "claims"), SPEC, 25, 25).select(*CLAIM_COLUMNS.split(", "))


@query("t05_top_k_per_group", oracle("SELECT volume, claim_id, score FROM (SELECT *, row_number() OVER (PARTITION BY volume, r_cat ORDER BY score DESC, claim_id) AS k FROM claims) x WHERE k <= 3", "claims"))
def t05(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("volume", "r_cat").orderBy(F.desc("score"), "claim_id")
    return view(spark, d, "claims").withColumn("k", F.row_number().over(order)).where("k <= 3").select("volume", "claim_id", "score")


@query("t07_tag_search", oracle("SELECT tag, frequency FROM tags WHERE contains(tag, 'n1') ORDER BY frequency DESC, tag LIMIT 40", "tags"))
def t07(spark, d):
    from claimloom.functions.text import search_key

    found = view(spark, d, "tags").where(search_key(F.col("tag")).contains(search_key(F.lit("N1"))))
    return found.orderBy(F.desc("frequency"), "tag").limit(clamp(40, 200))


@query("f20_nested_projection", oracle("SELECT claim_id, subject || '|' || relation || '|' || object AS triple, s_cat || '>' || r_cat || '>' || o_cat AS thematic FROM claims", "claims"))
def f20(spark, d):
    rows = view(spark, d, "claims")
    nested = rows.select("claim_id", F.struct("subject", "relation", "object").alias("t"), F.struct("s_cat", "r_cat", "o_cat").alias("c"))
    return nested.select("claim_id", F.concat_ws("|", "t.subject", "t.relation", "t.object").alias("triple"), F.concat_ws(">", "c.s_cat", "c.r_cat", "c.o_cat").alias("thematic"))


@query("j02_evidence", oracle("SELECT c.claim_id, s.sid, s.lang FROM claims c JOIN sentences s ON c.sid = s.sid WHERE c.subject = 'n7'", "claims", "sentences"))
def j02(spark, d):
    claims = view(spark, d, "claims").where("subject = 'n7'").select("claim_id", "sid")
    return claims.join(view(spark, d, "sentences").select("sid", "lang"), "sid").select("claim_id", "sid", "lang")


@query("j03_star_labels", oracle("SELECT DISTINCT c.subject, a.frequency AS s_freq, c.object, b.frequency AS o_freq FROM claims c JOIN tags a ON a.tag = c.subject JOIN tags b ON b.tag = c.object", "claims", "tags"))
def j03(spark, d):
    pairs, tags = view(spark, d, "claims").select("subject", "object").distinct(), view(spark, d, "tags")
    one, two = tags.toDF("subject", "s_freq"), tags.toDF("object", "o_freq")
    return pairs.join(one, "subject").join(two, "object").select("subject", "s_freq", "object", "o_freq")


@query("j04_values_semi_join", oracle("SELECT DISTINCT claim_id FROM ends WHERE tag IN ('n3', 'n5', 'n8')", "ends"))
def j04(spark, d):
    wanted = spark.createDataFrame([("n3",), ("n5",), ("n8",)], "tag string")
    return view(spark, d, "ends").join(F.broadcast(wanted), "tag", "left_semi").select("claim_id").distinct()


@query("j05_anti_join", oracle("SELECT v.tag FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.tag = v.tag)", "vectors", "tags"))
def j05(spark, d):
    return view(spark, d, "vectors").select("tag").join(view(spark, d, "tags").select("tag"), "tag", "left_anti")


@query("j06_left_default", oracle("SELECT v.tag, coalesce(t.frequency, 0) AS frequency, CASE WHEN t.tag IS NULL THEN 'unresolved' ELSE 'known' END AS state FROM vectors v LEFT JOIN tags t ON t.tag = v.tag", "vectors", "tags"))
def j06(spark, d):
    rows = view(spark, d, "vectors").select("tag").join(view(spark, d, "tags"), "tag", "left")
    return rows.select("tag", F.coalesce("frequency", F.lit(0)).alias("frequency"), F.when(F.col("frequency").isNull(), "unresolved").otherwise("known").alias("state"))
