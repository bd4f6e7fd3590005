"""Queries over label and text functions: normal forms, keys, similarities, vetoes, spans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from claimloom.functions import lexicons as L
from claimloom.functions import text as T
from claimloom.functions.vectors import dot, norm, residual, scaled_concat, unit
from claimloom.model import oracle, table, view
from claimloom.operators.resolution import rewritten
from claimloom.registry import query

SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


def _some(tokens: Column, words) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def _among(tokens: Column, words) -> Column:
    """The distinct tokens that are among the words, sorted."""
    return F.array_sort(F.array_intersect(tokens, F.array(*map(F.lit, words))))


def _digits(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda x: x.rlike("^[0-9]+$"))))


def types_of(tokens: Column) -> Column:
    """The types of a token array by marker words and numbers; ``other`` when it has none."""
    named = [F.when(_some(tokens, words), name) for name, words in L.TYPES.items()]
    named.append(F.when((F.size(_digits(tokens)) > 0) | _some(tokens, L.NUMBERS), "quantity"))
    found = F.array_compact(F.array(*named))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def contradiction(a: Column, b: Column) -> Column:
    """The first reason why two token arrays cannot name one thing, or null."""
    personal = lambda t: F.coalesce(F.get(t, F.lit(0)).isin(L.PERSONAL), F.lit(False))
    unlike = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & (x != y)
    opposed = F.lit(False)
    for one, other in L.AXES:
        opposed = opposed | (_some(a, one) & _some(b, other)) | (_some(a, other) & _some(b, one))
    only = lambda t, kind, without: _some(t, kind) & ~_some(t, without)
    crossed = (only(a, L.PLACES, L.PERSONS) & only(b, L.PERSONS, L.PLACES)) | (only(b, L.PLACES, L.PERSONS) & only(a, L.PERSONS, L.PLACES))
    return (
        F.when(personal(a) & personal(b) & (F.array_sort(a) == F.array_sort(b)) & (a != b), "personal_name_token_order_conflict")
        .when(unlike(_digits(a), _digits(b)), "conflicting_numeric_values")
        .when(unlike(_among(a, L.NUMBERS), _among(b, L.NUMBERS)), "conflicting_number_or_ordinal_words")
        .when(opposed, "opposed_direction_side_or_relation")
        .when(unlike(_among(a, L.KINSHIP), _among(b, L.KINSHIP)), "conflicting_kinship_roles")
        .when(_some(a, L.HARD_GROUPS) != _some(b, L.HARD_GROUPS), "individual_or_entity_vs_explicit_group_or_unit")
        .when(_some(a, L.EVENTS) != _some(b, L.EVENTS), "entity_vs_event_or_action")
        .when(crossed, "place_vs_person_or_office")
    )


def merge_reason(a: Column, b: Column) -> Column:
    """The first conservative rule by which two token arrays name one thing, or null."""
    va, vb = (rewritten(t, L.VARIANT_PAIRS, L.VARIANTS) for t in (a, b))
    compact = lambda t: F.array_join(t, "")
    both = lambda words: _some(a, words) & _some(b, words)
    personal = F.coalesce(F.get(a, F.lit(0)).isin(L.PERSONAL), F.lit(False)) | F.coalesce(F.get(b, F.lit(0)).isin(L.PERSONAL), F.lit(False))
    typed = both(L.OBJECTS) | both(L.EVENTS) | both(L.PLACES) | both(L.INSTITUTIONS) | (both(L.GROUPS) & ~_some(a, L.PERSONS) & ~_some(b, L.PERSONS))
    free = both(["and"]) | (typed & ~personal)  # token order may change
    without = lambda t, words: F.array_sort(F.filter(t, lambda x: ~x.isin(words)))
    same = lambda words: without(a, words) == without(b, words)
    anchored = lambda words, generic: F.exists(a, lambda x: ~x.isin(sorted({*words, *generic})))
    articles, places, events = ["of", "the"], ["city", "town"], ["campaign", "expedition"]
    return (
        F.when(a == b, "exact_after_case_punctuation_and_spacing_normalization")
        .when(compact(a) == compact(b), "exact_after_word_boundary_normalization")
        .when(compact(va) == compact(vb), "exact_after_curated_transliteration_normalization")
        .when((F.array_sort(a) == F.array_sort(b)) & free, "same_normalized_tokens_in_different_order")
        .when((F.array_sort(va) == F.array_sort(vb)) & free, "same_tokens_after_curated_transliteration_normalization")
        .when((_some(a, articles) | _some(b, articles)) & same(articles) & (F.size(without(a, articles)) > 0), "same_tokens_after_removing_of_the")
        .when(anchored(places, {*L.TITLES, *L.STOPWORDS, *L.GROUPS, *L.PERSONS, *L.PLACES}) & same(places) & both(places), "named_city_town_wording_variant")
        .when(anchored(events, {*L.TITLES, *L.STOPWORDS, *L.EVENTS, "royal", "military"}) & same(events) & both(events), "named_campaign_expedition_wording_variant")
    )


def evidence_gate(token_set: Column, chars: Column, idf_jaccard: Column, overlap_min: Column, exact: Column) -> Column:
    return exact | (token_set >= 0.92) | (chars >= 0.93) | ((idf_jaccard >= 0.68) & (overlap_min >= 0.80))


def band_route(raw: Column, veto: Column, rule: Column, probability: Column, auto: float = 0.9, review: float = 0.5) -> Column:
    """``(decision, source)``: below 94 only rules count; else veto, rule, model."""
    out = lambda d, s: F.struct(F.lit(d).alias("decision"), F.lit(s).alias("source"))
    low = F.when(rule.isNotNull(), out("auto", "rule")).otherwise(out("reject", "score"))
    high = F.when(veto.isNotNull(), out("reject", "veto")).when(rule.isNotNull(), out("auto", "rule")).when(probability >= auto, out("auto", "model")).when(probability >= review, out("review", "model")).otherwise(out("reject", "model"))
    return F.when(raw < 94, low).otherwise(high)


def lane(role: Column, reorder: Column, orthographic: Column, probability: Column, cosine: Column, numbers_match: Column) -> Column:
    """The first lane whose floors the pair clears, or null; numbers must agree in all."""
    clear = lambda flag, p, c: numbers_match & flag & (probability >= p) & (cosine >= c)
    return F.when(clear(role, 0.5, 0.6), "learned_role").when(clear(reorder, 0.6, 0.7), "reorder").when(clear(orthographic, 0.7, 0.7), "orthographic").when(clear(F.lit(True), 0.95, 0.9), "general")


@F.pandas_udf(ArrayType(SPAN))
def spans_ignoring_space(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """All places, overlapping too, where the needle occurs when white space does not count."""

    def find(text, needle):
        if text is None or not needle or not needle.strip():
            return []
        kept = [k for k, c in enumerate(text) if not c.isspace()]
        flat, want, out, at = "".join(text[k] for k in kept), "".join(needle.split()), [], -1
        while (at := flat.find(want, at + 1)) >= 0:
            out.append({"start": kept[at], "end": kept[at + len(want) - 1] + 1})
        return out

    return pd.Series([find(t, n) for t, n in zip(texts, needles, strict=True)])


@F.pandas_udf(StructType([*SPAN.fields, StructField("mode", StringType())]))
def match_ladder(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """The first mode that places the needle once: exact, folded case and blanks, no white space; else null."""

    def place(text, needle):
        if not text or not needle:
            return None
        if text.count(needle) == 1:
            at = text.index(needle)
            return {"start": at, "end": at + len(needle), "mode": "exact"}
        for mode, join in (("normalized", r"\s+"), ("compact", r"\s*")):
            parts = needle.split() if mode == "normalized" else list("".join(needle.split()))
            hits = list(re.finditer(join.join(map(re.escape, parts)), text, re.I))
            if len(hits) == 1:
                return {"start": hits[0].start(), "end": hits[0].end(), "mode": mode}
        return None

    return pd.DataFrame([place(t, n) or {"start": None, "end": None, "mode": None} for t, n in zip(texts, needles, strict=True)]).astype({"start": "Int32", "end": "Int32"})


# pickled in runs of 100 rows: an Arrow batch would hold 10,000 whole texts of any length in a worker
@F.udf(StructType([*SPAN.fields, StructField("ratio", DoubleType())]), useArrow=False)
def best_span(text, needle):
    """The stretch most like the needle: starts voted by shared 5-grams, the best by matching blocks."""
    from difflib import SequenceMatcher

    text, needle = text or "", needle or ""
    votes: dict[int, int] = {}
    for k in range(len(needle) - 4):
        at = text.find(needle[k : k + 5])
        while at >= 0:
            votes[max(0, at - k)] = votes.get(max(0, at - k), 0) + 1
            at = text.find(needle[k : k + 5], at + 1)
    best = (0.0, None, None)
    for start in sorted(votes, key=lambda s: (-votes[s], s))[:8]:
        part = text[start : start + len(needle)]
        ratio = SequenceMatcher(None, part, needle, autojunk=False).ratio()
        if ratio > best[0]:
            best = (ratio, start, start + len(part))
    return best[1], best[2], round(best[0], 6)


@F.pandas_udf(ArrayType(StringType()))
def split_near_middle(texts: pd.Series) -> pd.Series:
    """Two halves cut after the punctuation nearest the middle, within a quarter of the length; else one piece."""

    def cut(text):
        if not text:
            return [text or ""]
        middle, reach = len(text) // 2, max(1, len(text) // 4)
        marks = [k + 1 for k, c in enumerate(text) if c in ".,;:!?။၊" and abs(k + 1 - middle) <= reach and k + 1 < len(text)]
        at = min(marks, key=lambda k: (abs(k - middle), k), default=None)
        return [text] if at is None else [text[:at], text[at:]]

    return texts.map(cut)


def word_budget(rows: DataFrame, key: str, order: str, words: str, budget: int) -> DataFrame:
    """``block`` numbers of ordered segments packed until the budget is reached, per key.

    The running total resets at each block, which no plain window can do; a pass over each
    key's rows in order does, a batch at a time. A segment without a count has no words.
    """
    ordered = rows.select(key, order, F.coalesce(F.col(words), F.lit(0)).cast("long").alias("_w")).repartition(key).sortWithinPartitions(key, order, "_w")
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, order)]

    def run(batches):
        import pyarrow as pa

        own, block, total = object(), 0, 0
        for batch in batches:
            blocks = []
            for at, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != own:
                    own, block, total = at, 0, 0
                if total > 0 and total + n > budget:
                    block, total = block + 1, 0
                total += n
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, pa.int32())], names=[key, order, "block"])

    return ordered.mapInArrow(run, ", ".join([*kinds, "block int"]))


def json_repaired(c: Column) -> Column:
    """A JSON object that may itself be written as a string, or be cut off: its complete ``"s"`` values, in order."""
    inner = F.coalesce(F.try_parse_json(c).cast("string"), c)
    plain = F.when(F.left(F.trim(inner), F.lit(1)) == '"', F.regexp_replace(inner, r'\\"', '"')).otherwise(inner)
    return F.regexp_extract_all(plain, F.lit(r'"s"\s*:\s*"([^"]*)"'), F.lit(1))


NAMES = "SELECT p_partkey, p_name FROM part"
WORDS = "list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g')), ' '), lambda x: x <> '')"


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_type")


@query("x01_search_key", "SELECT p_partkey, trim(regexp_replace(translate(lower(p_type), '_-', '  '), '\\s+', ' ', 'g')) AS key FROM part")
def x01(spark, d):
    return _parts(spark, d).select("p_partkey", T.search_key(F.col("p_type")).alias("key"))


@query("x02_tag_key", r"SELECT o_orderkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(o_orderpriority), '[_\-/]+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM orders")
def x02(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.tag_key(F.col("o_orderpriority")).alias("key"))


@query("x05_token_ngrams", f"SELECT p_partkey, array_to_string({WORDS}, '|') AS tokens, list_aggregate(list_transform(range(1, len({WORDS})), lambda i: {WORDS}[i] || ' ' || {WORDS}[i + 1]), 'string_agg', '|') AS bigrams FROM part")
def x05(spark, d):
    tokens = T.label_tokens(F.col("p_name"))
    bigrams = F.array_join(T.token_ngrams(tokens, 2), "|")
    return _parts(spark, d).select("p_partkey", F.array_join(tokens, "|").alias("tokens"), F.when(bigrams != "", bigrams).alias("bigrams"))


@query("x03_compatible_tokens", f"SELECT p_partkey, array_to_string({WORDS}, '|') AS tokens FROM part")
def x03(spark, d):
    wide = F.translate("p_name", "abcde", "ａｂｃｄｅ")  # full-width letters, which NFKC folds
    return _parts(spark, d).select("p_partkey", F.array_join(T.compatible_tokens(wide), "|").alias("tokens"))


@query("x04_transliterated", "SELECT p_partkey, 'the ' || p_name || ' and 12345 cafestrasse king x' || p_partkey AS plain FROM part")
def x04(spark, d):
    written = F.concat(F.lit("The"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("&12,345—CaféStraße's (King's) x"), F.col("p_partkey").cast("string"))
    return _parts(spark, d).select("p_partkey", T.transliterated(written).alias("plain"))


@query("x26_mojibake", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'é' ELSE 'က' END || p_name AS text FROM part")
def x26(spark, d):
    broken = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Ã©").otherwise("က"), "p_name")
    return _parts(spark, d).select("p_partkey", T.repaired_mojibake(broken).alias("text"))


@query("x06_singular", "SELECT DISTINCT w, CASE WHEN w LIKE '%ies' THEN left(w, len(w) - 3) || 'y' WHEN regexp_matches(w, '(ss|us|is)$') THEN w WHEN regexp_matches(w, '(ch|sh|x|z)es$') THEN left(w, len(w) - 2) WHEN w LIKE '%s' THEN left(w, len(w) - 1) ELSE w END AS singular FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) x")
def x06(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return words.select("w", T.naive_singular(F.col("w")).alias("singular"))


@query("x09_compact_offsets", "SELECT doc_id, list_aggregate(list_filter(c, lambda x: NOT regexp_full_match(x, '\\s')), 'string_agg', '') AS compact, coalesce(list_sum(list_transform(c, lambda x, i: CASE WHEN regexp_full_match(x, '\\s') THEN 0 ELSE i END)), 0) AS offsets FROM (SELECT doc_id, string_split(text, '') AS c FROM documents) z")
def x09(spark, d):
    kept = F.filter(F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i"))), lambda x: ~x["c"].rlike(r"^\s$"))
    rows = table(spark, d, "documents").select("doc_id", kept.alias("k"))
    return rows.select("doc_id", F.array_join("k.c", "").alias("compact"), F.aggregate("k.i", F.lit(0).cast("long"), lambda s, x: s + x).cast("decimal(38,0)").alias("offsets"))


@query("x10_utf16", "SELECT doc_id, len(text) AS points, len(text) AS units FROM documents")
def x10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("points"), T.utf16_length(F.col("text")).cast("long").alias("units"))


@query("x11_spans_ignoring_space")
def x11(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(spans_ignoring_space("text", F.lit("that the"))).alias("s"))
    return found.select("doc_id", "s.start", "s.end")


@query("x12_unique_recovery", "SELECT doc_id, CASE WHEN n = 1 THEN strpos(t, 'andthe') END AS at FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t, len(regexp_extract_all(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'andthe')) AS n FROM documents) x")
def x12(spark, d):
    flat = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, d, "documents").select("doc_id", F.when(F.regexp_count(flat, F.lit("andthe")) == 1, F.instr(flat, "andthe").cast("long")).alias("at"))


@query("x16_set_similarity", f"SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS jaccard, round(len(list_intersect(x, y))::DOUBLE / least(len(list_distinct(x)), len(list_distinct(y))), 6) AS overlap_min FROM (SELECT p_partkey, {WORDS} AS x FROM part) a JOIN (SELECT p_partkey, {WORDS} AS y FROM part) b ON b.p_partkey = a.p_partkey + 1")
def x16(spark, d):
    rows = _parts(spark, d).select("p_partkey", T.label_tokens(F.col("p_name")).alias("x"))
    both = rows.select(F.col("p_partkey").alias("a"), "x").join(rows.select(F.col("p_partkey").alias("b"), F.col("x").alias("y")), F.col("b") == F.col("a") + 1)
    return both.select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(T.overlap(F.col("x"), F.col("y")), 6).alias("overlap_min"))


@query("x18_indel_family")
def x18(spark, d):
    rows = _parts(spark, d)
    both = rows.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")).join(rows.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y")), F.col("b") == F.col("a") + 1)
    return both.select("a", "b", *(F.round(f("x", "y"), 4).alias(n) for n, f in (("ratio", T.indel_ratio), ("token_sort", T.token_sort_ratio), ("token_set", T.token_set_ratio))))


@query("x22_split_near_middle")
def x22(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(split_near_middle("text")).alias("pieces"))


@query("x24_line_offsets", "SELECT doc_id, pos, CAST(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - len(line) - 1 AS BIGINT) AS start, len(line) AS size FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) x")
def x24(spark, d):
    from pyspark.sql import Window

    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), (F.sum(F.length("line") + 1).over(w) - F.length("line") - 1).alias("start"), F.length("line").cast("long").alias("size"))


@query("x25_sentences_words", r"SELECT doc_id, greatest(len(regexp_extract_all(text, '\S+')), len(regexp_replace(text, '\s+', '', 'g')) // 6) AS words, len(regexp_extract_all(regexp_replace(text, '\s+$', ''), '[.!?]\s+')) + 1 AS pieces FROM documents")
def x25(spark, d):
    return table(spark, d, "documents").select("doc_id", T.pseudo_words(F.col("text")).cast("long").alias("words"), F.size(T.sentences(F.regexp_replace("text", r"\s+$", ""))).cast("long").alias("pieces"))


@query("x27_safe_names", r"SELECT p_partkey, left(regexp_replace(trim(p_name), '[^\w.-]+', '_', 'g'), 60) AS name FROM part")
def x27(spark, d):
    return _parts(spark, d).select("p_partkey", T.safe_name(F.col("p_name")).alias("name"))


@query("x29_content_keys", "SELECT DISTINCT 'e_' || substr(sha256(p_name), 1, 32) AS key FROM part")
def x29(spark, d):
    return _parts(spark, d).select(T.content_key(F.col("p_name")).alias("key")).distinct()


@query("x30_view_templates", oracle("SELECT claim_id, v.view, CASE v.view WHEN 'triple' THEN subject || ' ' || relation || ' ' || object WHEN 'subject' THEN subject WHEN 'object' THEN object ELSE relation || ' of ' || object END AS text FROM claims, (VALUES ('triple'), ('subject'), ('object'), ('context')) v(view)", "claims"))
def x30(spark, d):
    views = {"triple": F.concat_ws(" ", "subject", "relation", "object"), "subject": F.col("subject"), "object": F.col("object"), "context": F.concat("relation", F.lit(" of "), "object")}
    exploded = F.explode(F.array(*[F.struct(F.lit(n).alias("view"), c.alias("text")) for n, c in views.items()]))
    return view(spark, d, "claims").select("claim_id", exploded.alias("v")).select("claim_id", "v.*")


_PAIRS = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query("x32_weighted_fusion", f"SELECT a.vec_id, round(0.7 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 0.3 * list_cosine_similarity(list_reverse(a.embedding)::DOUBLE[], b.embedding::DOUBLE[]), 5) AS sim FROM {_PAIRS}")
def x32(spark, d):
    e = table(spark, d, "embeddings")
    both = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    left = scaled_concat((F.col("a"), 0.7), (F.reverse("a"), 0.3))
    right = scaled_concat((F.col("b"), 0.7), (F.col("b"), 0.3))
    return both.select("vec_id", F.round(dot(left, right), 5).alias("sim"))


@query("x33_residual", f"SELECT a.vec_id, round(sqrt(1 - pow(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)), 5) AS length FROM {_PAIRS}")
def x33(spark, d):
    e = table(spark, d, "embeddings")
    both = e.select("vec_id", unit(F.col("embedding")).alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), unit(F.col("embedding")).alias("b")), "vec_id")
    return both.select("vec_id", F.round(norm(residual(F.col("a"), F.col("b"))), 5).alias("length"))


@query("x34_decay_scores", oracle("SELECT tag, round(1 - exp(-frequency / 1.5), 6) AS decay, round(1 + log2(frequency + 1), 6) AS size, round(2 * log2(frequency + 1) + log2(frequency % 7 + 1), 6) AS score FROM tags", "tags"))
def x34(spark, d):
    f = F.col("frequency")
    return view(spark, d, "tags").select("tag", F.round(1 - F.exp(-f / 1.5), 6).alias("decay"), F.round(1 + F.log2(f + 1), 6).alias("size"), F.round(2 * F.log2(f + 1) + F.log2(f % 7 + 1), 6).alias("score"))


@query("x35_geometry", oracle("SELECT tag, round(sqrt(frequency * frequency + 49.0), 6) AS reach, CAST(ceil(4 + 2 * sqrt(frequency)) AS BIGINT) AS radius FROM tags", "tags"))
def x35(spark, d):
    return view(spark, d, "tags").select("tag", F.round(F.hypot(F.col("frequency").cast("double"), F.lit(7.0)), 6).alias("reach"), F.ceil(4 + 2 * F.sqrt("frequency")).alias("radius"))


@query("x36_least_squares", "SELECT round(regr_slope(o_totalprice, o_custkey), 4) AS slope, round(regr_intercept(o_totalprice, o_custkey), 2) AS intercept, round(regr_r2(o_totalprice, o_custkey), 8) AS r2 FROM orders")
def x36(spark, d):
    return table(spark, d, "orders").agg(*(F.round(f("o_totalprice", "o_custkey"), n).alias(name) for f, n, name in ((F.regr_slope, 4, "slope"), (F.regr_intercept, 2, "intercept"), (F.regr_r2, 8, "r2"))))


@query("x37_json_repair", "SELECT event_id, array_to_string(regexp_extract_all('[{\"s\": \"a' || event_id || '\"}, {\"s\": \"b' || user_id || '\"}, {\"s\": \"cut', '\"s\"\\s*:\\s*\"([^\"]*)\"', 1), '|') AS items, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x37(spark, d):
    broken = F.concat(F.lit('[{"s": "a'), F.col("event_id").cast("string"), F.lit('"}, {"s": "b'), F.col("user_id").cast("string"), F.lit('"}, {"s": "cut'))
    return table(spark, d, "events").select("event_id", F.array_join(json_repaired(broken), "|").alias("items"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("x38_dates", "SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, count(*) AS n FROM orders GROUP BY 1")
def x38(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso")).agg(F.count("*").alias("n"))


@query("x39_ith_occurrence", "SELECT doc_id, CASE WHEN len(p) > 2 THEN len(p[1]) + len(p[2]) + 3 END AS at FROM (SELECT doc_id, string_split(text, 'the') AS p FROM documents) x")
def x39(spark, d):
    parts = F.split("text", "the")
    return table(spark, d, "documents").select("doc_id", F.when(F.size(parts) > 2, F.length(parts[0]) + F.length(parts[1]) + 3).cast("long").alias("at"))


@query("x40_marked_text", "SELECT doc_id, substr(text, 1, 10) || '[[' || substr(text, 11, 15) || ']]' || substr(text, 26) AS marked FROM documents")
def x40(spark, d):
    spans = F.array(F.struct(F.lit(10).alias("a"), F.lit(25).alias("b")))
    marked = F.array_join(F.transform(spans, lambda s: F.concat(F.lit("[["), F.substr(F.col("text"), s["a"] + 1, s["b"] - s["a"]), F.lit("]]"))), "")
    return table(spark, d, "documents").select("doc_id", F.concat(F.substring("text", 1, 10), marked, F.substring("text", 26, 1 << 30)).alias("marked"))


#: Words of the made labels that the rules are checked with.
MADE = "king north city of tha horse elder campaign regiment nga the htun town first and south expedition son 12 myosa court royal maung river 7 younger myoza wife festival prince two thado cavalry thadoe bhamo".split()
_MADE_SQL = f"""WITH l AS (SELECT p_partkey, {MADE!r} AS w FROM part),
  x AS (SELECT p_partkey AS k, [w[1 + p_partkey % {len(MADE)}], w[1 + (p_partkey * 5 + 3) % {len(MADE)}], w[1 + (p_partkey // 3) % {len(MADE)}], 'p' || p_partkey % 2] AS x, w FROM l),
  y AS (SELECT k, x, CASE k % 6 WHEN 0 THEN list_reverse(x) WHEN 1 THEN list_filter(x, lambda t: t NOT IN ('of', 'the')) WHEN 2 THEN list_transform(x, lambda t: CASE t WHEN 'city' THEN 'town' WHEN 'town' THEN 'city' WHEN 'campaign' THEN 'expedition' WHEN 'expedition' THEN 'campaign' ELSE t END)
    WHEN 3 THEN list_transform(x, lambda t: CASE t WHEN 'myoza' THEN 'myosa' WHEN 'thadoe' THEN 'thado' ELSE t END) WHEN 4 THEN [w[1 + (k + 1) % {len(MADE)}], x[2], x[3], x[4]] ELSE [array_to_string(x, '')] END AS y FROM x)"""
_V = lambda t: f"list_transform({t}, lambda t: CASE t {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in L.VARIANTS.items())} ELSE t END)"
_HAS = lambda t, words: f"list_has_any({t}, {list(words)!r})"
_BOTH = lambda words: f"({_HAS('x', words)} AND {_HAS('y', words)})"
_IN = lambda t, words: f"list_sort(list_distinct(list_filter({t}, lambda t: list_contains({list(words)!r}, t))))"
_NUM = lambda t: f"list_sort(list_distinct(list_filter({t}, lambda t: regexp_full_match(t, '[0-9]+'))))"
_UNLIKE = lambda f: f"(len({f('x')}) > 0 AND len({f('y')}) > 0 AND {f('x')} <> {f('y')})"
_OUT = lambda t, words: f"list_sort(list_filter({t}, lambda t: NOT list_contains({list(words)!r}, t)))"
_ONLY = lambda t, kind, without: f"({_HAS(t, kind)} AND NOT {_HAS(t, without)})"
_F09_SQL = f"""{_MADE_SQL} SELECT k, CASE
  WHEN list_contains({L.PERSONAL!r}, x[1]) AND list_contains({L.PERSONAL!r}, y[1]) AND list_sort(x) = list_sort(y) AND x <> y THEN 'personal_name_token_order_conflict'
  WHEN {_UNLIKE(_NUM)} THEN 'conflicting_numeric_values' WHEN {_UNLIKE(lambda t: _IN(t, L.NUMBERS))} THEN 'conflicting_number_or_ordinal_words'
  WHEN {" OR ".join(f"({_HAS('x', p)} AND {_HAS('y', q)}) OR ({_HAS('x', q)} AND {_HAS('y', p)})" for p, q in L.AXES)} THEN 'opposed_direction_side_or_relation'
  WHEN {_UNLIKE(lambda t: _IN(t, L.KINSHIP))} THEN 'conflicting_kinship_roles' WHEN {_HAS('x', L.HARD_GROUPS)} <> {_HAS('y', L.HARD_GROUPS)} THEN 'individual_or_entity_vs_explicit_group_or_unit'
  WHEN {_HAS('x', L.EVENTS)} <> {_HAS('y', L.EVENTS)} THEN 'entity_vs_event_or_action'
  WHEN ({_ONLY('x', L.PLACES, L.PERSONS)} AND {_ONLY('y', L.PERSONS, L.PLACES)}) OR ({_ONLY('y', L.PLACES, L.PERSONS)} AND {_ONLY('x', L.PERSONS, L.PLACES)}) THEN 'place_vs_person_or_office' END AS reason,
  coalesce(nullif(concat_ws(',', {", ".join(f"CASE WHEN {_HAS('x', words)} THEN '{name}' END" for name, words in L.TYPES.items())}, CASE WHEN len({_NUM('x')}) > 0 OR {_HAS('x', L.NUMBERS)} THEN 'quantity' END), ''), 'other') AS types FROM y"""
_ANCHOR = lambda words: f"len(list_filter(x, lambda t: NOT list_contains({sorted(words)!r}, t))) > 0"
_FREE = f"({_BOTH(['and'])} OR (({_BOTH(L.OBJECTS)} OR {_BOTH(L.EVENTS)} OR {_BOTH(L.PLACES)} OR {_BOTH(L.INSTITUTIONS)} OR ({_BOTH(L.GROUPS)} AND NOT {_HAS('x', L.PERSONS)} AND NOT {_HAS('y', L.PERSONS)})) AND NOT list_contains({L.PERSONAL!r}, x[1]) AND NOT list_contains({L.PERSONAL!r}, y[1])))"
_F10_SQL = f"""{_MADE_SQL} SELECT k, CASE WHEN x = y THEN 'exact_after_case_punctuation_and_spacing_normalization' WHEN array_to_string(x, '') = array_to_string(y, '') THEN 'exact_after_word_boundary_normalization'
  WHEN array_to_string({_V('x')}, '') = array_to_string({_V('y')}, '') THEN 'exact_after_curated_transliteration_normalization'
  WHEN list_sort(x) = list_sort(y) AND {_FREE} THEN 'same_normalized_tokens_in_different_order' WHEN list_sort({_V('x')}) = list_sort({_V('y')}) AND {_FREE} THEN 'same_tokens_after_curated_transliteration_normalization'
  WHEN ({_HAS('x', ['of', 'the'])} OR {_HAS('y', ['of', 'the'])}) AND {_OUT('x', ['of', 'the'])} = {_OUT('y', ['of', 'the'])} AND len({_OUT('x', ['of', 'the'])}) > 0 THEN 'same_tokens_after_removing_of_the'
  WHEN {_ANCHOR({*L.TITLES, *L.STOPWORDS, *L.GROUPS, *L.PERSONS, *L.PLACES})} AND {_OUT('x', ['city', 'town'])} = {_OUT('y', ['city', 'town'])} AND {_BOTH(['city', 'town'])} THEN 'named_city_town_wording_variant'
  WHEN {_ANCHOR({*L.TITLES, *L.STOPWORDS, *L.EVENTS, 'royal', 'military'})} AND {_OUT('x', ['campaign', 'expedition'])} = {_OUT('y', ['campaign', 'expedition'])} AND {_BOTH(['campaign', 'expedition'])} THEN 'named_campaign_expedition_wording_variant' END AS reason FROM y"""


def _made_pairs(spark, d):
    k, n = F.col("k"), len(MADE)
    word = lambda at: F.get(F.array(*map(F.lit, MADE)), (at % n).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    rows = rows.withColumn("x", F.array(word(k), word(k * 5 + 3), word(F.floor(k / 3)), F.concat(F.lit("p"), (k % 2).cast("string"))))
    swapped = lambda pairs: F.transform("x", lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in pairs for v in p]), t), t))
    y = (
        F.when(k % 6 == 0, F.reverse("x")).when(k % 6 == 1, F.filter("x", lambda t: ~t.isin("of", "the"))).when(k % 6 == 2, swapped([("city", "town"), ("town", "city"), ("campaign", "expedition"), ("expedition", "campaign")]))
        .when(k % 6 == 3, swapped([("myoza", "myosa"), ("thadoe", "thado")])).when(k % 6 == 4, F.concat(F.array(word(k + 1)), F.slice("x", 2, 3))).otherwise(F.array(F.array_join("x", "")))
    )
    return rows.withColumn("y", y)


@query("f09_vetoes", _F09_SQL)
def f09(spark, d):
    return _made_pairs(spark, d).select("k", contradiction(F.col("x"), F.col("y")).alias("reason"), F.array_join(types_of(F.col("x")), ",").alias("types"))


@query("f10_merge_reasons", _F10_SQL)
def f10(spark, d):
    return _made_pairs(spark, d).select("k", merge_reason(F.col("x"), F.col("y")).alias("reason"))


@query("x20_types", f"SELECT t AS type, count(*) AS n FROM (SELECT unnest(string_split(types, ',')) AS t FROM ({_F09_SQL}) q) r GROUP BY t")
def x20(spark, d):
    return _made_pairs(spark, d).select(F.explode(types_of(F.col("x"))).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query("f13_band_routing", oracle("SELECT claim_id, CASE WHEN s < 94 THEN CASE WHEN rule THEN 'auto' ELSE 'reject' END WHEN veto THEN 'reject' WHEN rule THEN 'auto' WHEN p >= 0.9 THEN 'auto' WHEN p >= 0.5 THEN 'review' ELSE 'reject' END AS decision, CASE WHEN s < 94 THEN CASE WHEN rule THEN 'rule' ELSE 'score' END WHEN veto THEN 'veto' WHEN rule THEN 'rule' ELSE 'model' END AS source FROM (SELECT claim_id, 80 + claim_id % 21 AS s, claim_id % 17 = 0 AS veto, claim_id % 5 = 0 AS rule, (claim_id % 100) / 100.0 AS p FROM claims) x", "claims"))
def f13(spark, d):
    c = F.col("claim_id")
    routed = band_route(80 + c % 21, F.when(c % 17 == 0, "veto"), F.when(c % 5 == 0, "rule"), (c % 100) / 100)
    return view(spark, d, "claims").select("claim_id", routed.alias("r")).select("claim_id", "r.decision", "r.source")


@query("f11_evidence_gate", oracle("SELECT count(*) FILTER (claim_id % 50 = 0 OR (claim_id % 100) / 100.0 >= 0.92 OR (claim_id % 91) / 91.0 >= 0.93 OR ((claim_id % 83) / 83.0 >= 0.68 AND (claim_id % 77) / 77.0 >= 0.8)) AS passed FROM claims", "claims"))
def f11(spark, d):
    c = F.col("claim_id")
    return view(spark, d, "claims").agg(F.count_if(evidence_gate((c % 100) / 100, (c % 91) / 91, (c % 83) / 83, (c % 77) / 77, c % 50 == 0)).alias("passed"))


@query("f12_lanes", oracle("SELECT lane, count(*) AS n FROM (SELECT CASE WHEN NOT m THEN NULL WHEN r AND p >= 0.5 AND c >= 0.6 THEN 'learned_role' WHEN o AND p >= 0.6 AND c >= 0.7 THEN 'reorder' WHEN g AND p >= 0.7 AND c >= 0.7 THEN 'orthographic' WHEN p >= 0.95 AND c >= 0.9 THEN 'general' END AS lane FROM (SELECT claim_id % 9 = 0 AS r, claim_id % 8 = 0 AS o, claim_id % 7 = 0 AS g, (claim_id % 100) / 100.0 AS p, (claim_id % 83) / 83.0 AS c, claim_id % 3 <> 0 AS m FROM claims) x) y GROUP BY lane", "claims"))
def f12(spark, d):
    c = F.col("claim_id")
    found = lane(c % 9 == 0, c % 8 == 0, c % 7 == 0, (c % 100) / 100, (c % 83) / 83, c % 3 != 0)
    return view(spark, d, "claims").groupBy(found.alias("lane")).agg(F.count("*").alias("n"))


@query("f18_not_a_proposition", "SELECT doc_id, CASE WHEN regexp_matches(text, '^[\\s\\d.,]+$') THEN 'number' WHEN len(text) < 40 THEN 'fragment' WHEN regexp_matches(text, '^[A-Z ]+$') THEN 'heading' WHEN regexp_matches(text, '^[0-9]+[.)]') THEN 'list' END AS reason FROM documents")
def f18(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.when(t.rlike(r"^[\s\d.,]+$"), "number").when(F.length(t) < 40, "fragment").when(t.rlike("^[A-Z ]+$"), "heading").when(t.rlike("^[0-9]+[.)]"), "list").alias("reason"))


@query("f19_code_remap", oracle("SELECT claim_id, coalesce(CASE WHEN page = 5 AND ordinal = 1 THEN 'E90' END, CASE WHEN page % 10 = 5 AND s_cat = 'E1' THEN 'E91' END, s_cat) AS code FROM claims", "claims"))
def f19(spark, d):
    exact = spark.createDataFrame([(5, 1, "E90")], "page int, ordinal int, x string")
    by_code = spark.createDataFrame([(p, "E1", "E91") for p in range(5, 105, 10)], "page int, s_cat string, y string")
    rows = view(spark, d, "claims").join(F.broadcast(exact), ["page", "ordinal"], "left").join(F.broadcast(by_code), ["page", "s_cat"], "left")
    return rows.select("claim_id", F.coalesce("x", "y", "s_cat").alias("code"))


@query("f22_label_shape", "SELECT o_orderpriority, regexp_matches(o_orderpriority, '_') OR regexp_full_match(o_orderpriority, '[A-Z0-9]+') AS tag_like, count(*) AS n FROM orders GROUP BY ALL")
def f22(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", (F.col("o_orderpriority").contains("_") | F.col("o_orderpriority").rlike("^[A-Z0-9]+$")).alias("tag_like")).agg(F.count("*").alias("n"))


@query("w06_word_budget")
def w06(spark, d):
    return word_budget(view(spark, d, "sentences").withColumn("words", F.regexp_count("text", F.lit(r"\S+"))), "volume", "sid", "words", 2000)
