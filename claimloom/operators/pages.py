"""Page text: line classes, page drops, debris, suspicious scans, markers and corpus audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.model import oracle, table, view
from claimloom.operators.joins import cosine_neighbours
from claimloom.registry import query
from claimloom.sources.files import quads, split_marked_volume

LAST_LINES, TOP_LINES = 14, 3


def classified_lines(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, value, reason``: why a line is no prose, or null.

    The first rule holds: blank, page number, header (one of the first lines without an end
    mark), footnotes (from the first note mark within the last lines on), no letters.
    """
    rows = pages.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    w = Window.partitionBy(key)
    order = w.orderBy("line")
    rows = rows.withColumn("n", F.count("*").over(w))
    note = ((F.col("line") >= F.col("n") - LAST_LINES) & F.col("value").rlike(r"^\s*(\[[0-9]+\]|\*|[0-9]+[.)])\s")).cast("int")
    rows = rows.withColumn("in_notes", F.max(note).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    v = F.trim("value")
    reason = (
        F.when(v == "", "blank").when(v.rlike(r"^[0-9၀-၉\s.-]+$"), "page_number").when((F.col("line") < TOP_LINES) & (F.length(v) < 60) & ~v.rlike("[.!?။]$"), "header")
        .when(F.col("in_notes"), "footnote").when(~v.rlike(r"\p{L}"), "no_letters")
    )
    return rows.select(key, "line", "value", reason.alias("reason"))


def page_class(lines: DataFrame, key: str) -> DataFrame:
    """``key, kind``: drop reasons of whole pages from their lines, or ``prose``."""
    kept = F.col("reason").isNull()
    facts = lines.groupBy(key).agg(F.count_if(kept).alias("prose_lines"), F.sum(F.when(kept, F.length("value")).otherwise(0)).alias("prose_chars"), F.count("*").alias("lines"), F.count_if(F.col("value").rlike(r"\.{4,}\s*[0-9]+\s*$")).alias("leaders"))
    kind = F.when(F.col("leaders") * 2 > F.col("lines"), "contents").when(F.col("prose_chars") < 40, "too_little_prose").when(F.col("prose_lines") == 0, "captions").otherwise("prose")
    return facts.select(key, kind.alias("kind"), "prose_lines", "prose_chars")


def debris_ranges(lines: DataFrame, key: str) -> DataFrame:
    """Removed lines as ``key, start, end, reason`` character ranges of the page."""
    before = F.coalesce(F.sum(F.length("value") + 1).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("start", before)
    return placed.where("reason is not null and reason <> 'blank'").select(key, "start", (F.col("start") + F.length("value")).alias("end"), "reason")


def removal_audit(pages: DataFrame, key: str, text: str, ranges: DataFrame) -> DataFrame:
    """Ranges that leave their page or overlap the one before; no rows is a clean audit."""
    w = Window.partitionBy(key).orderBy("start", "end")
    rows = ranges.join(pages.select(key, F.length(text).alias("_n")), key).withColumn("_before", F.lag("end").over(w))
    return rows.where("start < 0 or end > _n or start >= end or _before > start").select(key, "start", "end", "reason")


def applied_patches(lines: DataFrame, patches: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Lines after ``patches(key, line, expected, replacement)`` and the patches whose expectation fails; a null replacement removes."""
    both = lines.join(patches, [key, "line"], "left")
    bad = patches.join(lines.select(key, "line", "value"), [key, "line"], "left").where(~F.col("value").eqNullSafe(F.col("expected")))
    due = F.col("expected").isNotNull() & (F.col("value") == F.col("expected"))
    done = both.where(~(due & F.col("replacement").isNull())).withColumn("value", F.when(due, F.col("replacement")).otherwise(F.col("value")))
    return done.select(*lines.columns), bad


def suspicious(chars, letters, confidence) -> F.Column:
    """Empty, short, out of script or badly read; unknown confidence is no suspicion."""
    return (chars == 0) | (chars < 20) | (letters < 0.3 * chars) | F.coalesce(confidence < 0.6, F.lit(False))


@query("f14_line_classes", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) AS n FROM documents),
  m AS (SELECT *, max(CASE WHEN line >= n - 14 AND regexp_matches(value, '^\s*(\[[0-9]+\]|\*|[0-9]+[.)])\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS notes FROM l)
  SELECT doc_id, CAST(line AS INT) AS line, CASE WHEN trim(value) = '' THEN 'blank' WHEN regexp_matches(trim(value), '^[0-9\s.-]+$') THEN 'page_number' WHEN line < 3 AND len(trim(value)) < 60 AND NOT regexp_matches(trim(value), '[.!?]$') THEN 'header' WHEN notes = 1 THEN 'footnote' WHEN NOT regexp_matches(trim(value), '\p{L}') THEN 'no_letters' END AS reason FROM m""")
def f14(spark, d):
    return classified_lines(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "line", "reason")


_LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) AS n FROM documents),
  m AS (SELECT *, max(CASE WHEN line >= n - 14 AND regexp_matches(value, '^\s*(\[[0-9]+\]|\*|[0-9]+[.)])\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS notes FROM l),
  c AS (SELECT doc_id, line, value, CASE WHEN trim(value) = '' THEN 'blank' WHEN regexp_matches(trim(value), '^[0-9\s.-]+$') THEN 'page_number' WHEN line < 3 AND len(trim(value)) < 60 AND NOT regexp_matches(trim(value), '[.!?]$') THEN 'header' WHEN notes = 1 THEN 'footnote' WHEN NOT regexp_matches(trim(value), '\p{L}') THEN 'no_letters' END AS reason FROM m),
  r AS (SELECT * FROM (SELECT doc_id, coalesce(sum(len(value) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, len(value) AS size, reason FROM c) x WHERE reason IS NOT NULL AND reason <> 'blank')"""


@query("f15_page_classes", _LINES + r" SELECT doc_id, CASE WHEN 2 * count(*) FILTER (regexp_matches(value, '\.{4,}\s*[0-9]+\s*$')) > count(*) THEN 'contents' WHEN coalesce(sum(len(value)) FILTER (reason IS NULL), 0) < 40 THEN 'too_little_prose' WHEN count(*) FILTER (reason IS NULL) = 0 THEN 'captions' ELSE 'prose' END AS kind, count(*) FILTER (reason IS NULL) AS prose_lines, CAST(coalesce(sum(len(value)) FILTER (reason IS NULL), 0) AS BIGINT) AS prose_chars FROM c GROUP BY doc_id")
def f15(spark, d):
    return page_class(classified_lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query("f16_debris_ranges", _LINES + " SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS \"end\", reason FROM r")
def f16(spark, d):
    return debris_ranges(classified_lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query("f17_suspicious_pages", "SELECT doc_id, len(text) AS chars, len(text) < 20 OR len(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.3 * len(text) OR coalesce(doc_id % 10 < 1, false) AS suspicious FROM documents")
def f17(spark, d):
    flag = suspicious(F.length("text"), F.regexp_count("text", F.lit("[A-Za-z]")), F.when(F.col("doc_id") % 10 == 0, F.lit(0.5)))
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), flag.alias("suspicious"))


@query("q06_removal_audit", _LINES + """, t AS (SELECT * FROM r UNION ALL SELECT doc_id, start + 1, size, 'shifted' FROM r WHERE doc_id % 10 = 0 AND reason = 'footnote' UNION ALL SELECT doc_id, len(text) - 1, 5, 'beyond' FROM documents WHERE doc_id % 10 = 1),
  a AS (SELECT t.*, start + size AS stop, lag(start + size) OVER (PARTITION BY t.doc_id ORDER BY start, start + size) AS before, len(d.text) AS n FROM t JOIN documents d ON d.doc_id = t.doc_id)
  SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", reason FROM a WHERE start < 0 OR stop > n OR start >= stop OR before > start""")
def q06(spark, d):
    docs = table(spark, d, "documents")
    ranges = debris_ranges(classified_lines(docs, "doc_id", "text"), "doc_id")
    shifted = ranges.where("doc_id % 10 = 0 and reason = 'footnote'").select("doc_id", F.col("start") + 1, F.col("end") + 1, F.lit("shifted"))
    beyond = docs.where("doc_id % 10 = 1").select("doc_id", (F.length("text") - 1).alias("start"), (F.length("text") + 4).alias("end"), F.lit("beyond"))
    return removal_audit(docs, "doc_id", "text", ranges.union(shifted).union(beyond))


_PAGES = "SELECT volume || '.' || CAST(sid AS BIGINT) // 100 AS book, sid AS page, CASE WHEN sid % 50 = 40 THEN 'Index ' || text ELSE text END AS body FROM sentences"


@query("s08_marked_volume", oracle(f"SELECT book, page, len(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) AS size, max(CASE WHEN regexp_matches(body, '(?i)^\\s*index\\b') THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page) = 1 AS back FROM ({_PAGES}) x", "sentences"))
def s08(spark, d):
    sid = F.col("sid")
    body = F.when(sid % 50 == 40, F.concat(F.lit("Index "), "text")).otherwise(F.col("text"))
    book = F.concat("volume", F.lit("."), F.floor(sid / 100).cast("string"))
    marked = F.concat(F.lit("[[BOOK="), book, F.lit(" PAGE="), F.lpad(sid.cast("string"), F.greatest(F.lit(4), F.length(sid.cast("string"))), F.lit("0")), F.lit("]]\n"), body)
    rows = view(spark, d, "sentences").groupBy(book.alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sid", marked.alias("t")))), lambda x: x["t"]), "\n").alias("value"))
    pages = split_marked_volume(rows)
    return pages.select("book", F.col("page").cast("long").alias("page"), F.length(F.regexp_replace("body", r"^\s+|\s+$", "")).cast("long").alias("size"), F.col("back_matter").alias("back"))


@query("k03_quads", oracle("SELECT '<urn:claim:' || claim_id || '> <urn:claim:' || p || '> \"' || o || '\" <urn:claim:source> .' AS value FROM (SELECT claim_id, unnest(['subject', 'object']) AS p, unnest([subject, object]) AS o FROM claims) x", "claims"))
def k03(spark, d):
    return quads(view(spark, d, "claims"), "source", "claim_id", {"subject": "subject", "object": "object"})


@query("q01_reconstruction", "SELECT doc_id, sha256(text) AS digest FROM documents")
def q01(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    return lines.groupBy("doc_id").agg(F.sha2(joined, 256).alias("digest"))


@query("q02_decisions", oracle("SELECT claim_id, CASE WHEN decision = 'F' AND score < 20000 THEN 'annotated without support' WHEN decision = 'O' AND score > 400000 THEN 'skipped with support' END AS problem FROM claims WHERE (decision = 'F' AND score < 20000) OR (decision = 'O' AND score > 400000)", "claims"))
def q02(spark, d):
    problem = F.when((F.col("decision") == "F") & (F.col("score") < 20000), "annotated without support").when((F.col("decision") == "O") & (F.col("score") > 400000), "skipped with support")
    return view(spark, d, "claims").select("claim_id", problem.alias("problem")).where("problem is not null")


@query("q05_audit", oracle("SELECT 'claims' AS check_, count(*) > 0 AS ok, count(*) AS detail FROM claims UNION ALL SELECT 'unique ids', count(*) = count(DISTINCT claim_id), count(DISTINCT claim_id) FROM claims UNION ALL SELECT 'both ends', bool_and(subject IS NOT NULL AND object IS NOT NULL), count(*) FILTER (subject = object) FROM claims UNION ALL SELECT 'frequencies', (SELECT sum(frequency) FROM tags) = 2 * count(*), 2 * count(*) FROM claims", "claims", "tags"))
def q05(spark, d):
    c = view(spark, d, "claims")
    facts = c.agg(F.count("*").alias("n"), F.count_distinct("claim_id").alias("ids"), F.every(F.col("subject").isNotNull() & F.col("object").isNotNull()).alias("ends"), F.count_if(F.col("subject") == F.col("object")).alias("loops"))
    facts = facts.join(view(spark, d, "tags").agg(F.sum("frequency").alias("f")))
    row = lambda name, ok, detail: F.struct(F.lit(name).alias("check_"), ok.alias("ok"), detail.cast("long").alias("detail"))
    n = F.col("n")
    return facts.select(F.inline(F.array(row("claims", n > 0, n), row("unique ids", n == F.col("ids"), F.col("ids")), row("both ends", F.col("ends"), F.col("loops")), row("frequencies", F.col("f") == 2 * n, 2 * n))))


@query("q07_line_diff", "SELECT doc_id, line, 'deleted' AS state FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) x WHERE regexp_matches(value, '[0-9]')")
def q07(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    kept = raw.where(~F.col("value").rlike("[0-9]"))
    gone = raw.join(kept.select("doc_id", "line"), ["doc_id", "line"], "left_anti")
    return gone.select("doc_id", F.col("line").cast("long").alias("line"), F.lit("deleted").alias("state"))


@query("q08_merge_conformance", oracle(", x AS (SELECT claim_id, tag, parent, row_number() OVER (PARTITION BY parent, tag ORDER BY claim_id) AS k, EXISTS (SELECT 1 FROM tags t WHERE t.tag = y.tag) AS known FROM (SELECT claim_id, object AS tag, subject AS parent FROM claims) y) SELECT claim_id, CASE WHEN tag = parent THEN 'parent' WHEN NOT known THEN 'unknown' WHEN k > 1 THEN 'duplicate' END AS reason FROM x", "claims", "tags"))
def q08(spark, d):
    rows = view(spark, d, "claims").select("claim_id", F.col("object").alias("tag"), F.col("subject").alias("parent"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("parent", "tag").orderBy("claim_id")))
    rows = rows.join(view(spark, d, "tags"), "tag", "left")
    reason = F.when(F.col("tag") == F.col("parent"), "parent").when(F.col("frequency").isNull(), "unknown").when(F.col("k") > 1, "duplicate")
    return rows.select("claim_id", reason.alias("reason"))


def retrieval_recall(known: DataFrame, retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many known positives are eligible, how many of them were retrieved, and the share."""
    eligible = known.select(*keys).distinct()
    found = eligible.join(retrieved.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return found.agg(F.count("*").alias("eligible"), F.count("_hit").alias("found"), (F.count("_hit") / F.count("*")).alias("recall"))


def label_recall(rows: DataFrame, retrieved: DataFrame, item: str, label: str, every: int) -> DataFrame:
    """``retrieval_recall`` where an item's known positives are all others of its label and items divisible by ``every`` ask.

    Eligible pairs are counted from the sizes of labels and never made.
    """
    rows = rows.select(item, label).where(F.col(item).isNotNull() & F.col(label).isNotNull()).distinct()
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col(item) % every == 0).alias("asked"))
    eligible = sizes.agg(F.coalesce(F.sum(F.col("asked") * (F.col("n") - 1)), F.lit(0)).alias("eligible"))
    pairs = retrieved.select("a", "b").where(F.col("a") % every == 0).distinct()
    found = pairs.join(rows.toDF("a", "_l"), "a").join(rows.toDF("b", "_m"), "b").where("_l = _m").agg(F.count("*").alias("found"))
    return eligible.join(F.broadcast(found)).select("eligible", "found", F.try_divide(F.col("found"), F.col("eligible")).alias("recall"))


_RECALL = "SELECT x.vec_id AS a, y.vec_id AS b, x.label = y.label AS same, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, y.vec_id) AS k FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id"


@query("q09_retrieval_recall", f"SELECT count(*) AS eligible, count(*) FILTER (k <= 10) AS found, round(count(*) FILTER (k <= 10)::DOUBLE / count(*), 6) AS recall FROM ({_RECALL}) x WHERE same AND a % 10 = 0")
def q09(spark, d):
    e = table(spark, d, "embeddings")
    return label_recall(e, cosine_neighbours(e, "vec_id", 10, every=10), "vec_id", "label", 10).withColumn("recall", F.round("recall", 6))


@query("q11_evidence_exactness", "SELECT doc_id, contains(regexp_replace(text, '\\s', '', 'g'), regexp_replace(substr(text, 20, 30), '\\s', '', 'g')) AS exact FROM documents")
def q11(spark, d):
    compact = lambda c: F.regexp_replace(c, r"\s", "")
    return table(spark, d, "documents").select("doc_id", F.contains(compact(F.col("text")), compact(F.substring("text", 20, 30))).alias("exact"))


@query("q12_id_order", "SELECT conv_id, list(turn ORDER BY turn) = range(0, count(*)) OR list(turn ORDER BY turn) = range(1, count(*) + 1) AS in_order, bool_and(len(text) > 0) AS full_ FROM conversations GROUP BY conv_id")
def q12(spark, d):
    turns = F.sort_array(F.collect_list("turn"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t"), F.every(F.length("text") > 0).alias("full_"))
    start = F.sequence(F.lit(0).cast("long"), F.size("t").cast("long") - 1)
    return g.select("conv_id", ((F.col("t") == start) | (F.col("t") == F.transform(start, lambda x: x + 1))).alias("in_order"), "full_")
