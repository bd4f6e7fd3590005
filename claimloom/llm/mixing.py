"""Operator 4: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.plans.lineage import cut, fresh_name

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Sources up to this many rows are broadcast (some 10 MB).
BROADCAST_SOURCES = 100_000


def word_count(text) -> F.Column:
    """Number of words outside space and ``\\t-\\r``; null counts 0."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]")
    return F.size(F.array_remove(parts, "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets for ``(source, source_size)`` rows: shares by weight, filled up to ``most`` times each source.

    Weights repeat over sources in code-point order, null last. A source is full when its
    limit is within its part of what is left; sorted by limit per weight, the full sources
    are a prefix, so one pass of running sums gives what resharing round after round gives.
    The table has a row for each source; only that table is windowed.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight)
    rows = rows.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    whole = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "left": F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "weights_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("level", F.col("left") / F.col("weights_left"))
    rows = rows.withColumn("full", F.col("limit") <= F.col("weight") * F.col("level"))
    last = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "place", "level"))).over(every)["level"]
    return rows.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * last)).select(
        "source", "source_size", "target"
    )


def chance(doc_id, seed: str = SEED) -> F.Column:
    """A number in [0, 1) from the seed and the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _rates(slim: DataFrame, weights, share: float, most: float) -> DataFrame:
    """A row for each source: ``key``, ``source_size``, ``target``, ``rate``; broadcast while it has few rows."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = cut(source_targets(sizes, weights, share, most).select(F.col("source").alias("key"), "source_size", "target", rate.alias("rate")))
    return F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates


def _copies(seed: str, doc_id=None, rate=None) -> F.Column:
    doc_id, rate = F.col("doc_id") if doc_id is None else doc_id, F.col("rate") if rate is None else rate
    return (F.floor(rate) + (chance(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mix_sources(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """How often each document enters the mix.

    Returns the documents' ``doc_id`` with ``size``, ``source_size``, ``target``, ``taken``
    and ``copies``: ``floor(rate)`` copies and one more with the fraction as its chance, the
    rate being target / source_size. Null texts and texts without words have size 0 and
    copies by the same rule; a source without words has target 0 and no copies. Repeated
    rows count each, and rows of one id share their draw. Null sources are one source.
    Sizes are added up before the shuffle, so a hot source sends one row per task; the
    table of sources is broadcast up to ``BROADCAST_SOURCES`` rows and joined by shuffle beyond.
    """
    slim = cut(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rates = _rates(slim, weights, share, most)
    return (
        slim.join(rates, F.col("source").eqNullSafe(F.col("key")))
        .withColumn("copies", _copies(seed))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
    )


def emit_copies(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: the documents' own columns, each row as often as ``mix_sources`` counts.

    Rows taken 0 times go; null texts count 0 words, null ids share one draw, repeated rows
    are each taken as often. Extra columns stay as they are, whatever their names. An empty
    table gives no rows.
    """
    slim = cut(documents.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")))
    key, rate, copy = (fresh_name(documents.columns, n) for n in ("_mix_key", "_mix_rate", "_mix_copy"))
    rates = _rates(slim, weights, share, most).select(F.col("key").alias(key), F.col("rate").alias(rate))
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates
    joined = documents.join(rates, F.col("source").eqNullSafe(F.col(key)))
    copies = _copies(seed, F.col("doc_id"), F.col(rate)).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*(F.col(f"`{c}`") for c in documents.columns))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sources
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS lim FROM placed
), running AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
      - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    (SELECT sum(weight) FROM weighed)
      - coalesce(sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wleft
  FROM weighed
), levelled AS (
  SELECT *, lft / wleft AS lev, lim <= weight * (lft / wleft) AS is_full FROM running
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN lim ELSE weight * (
    SELECT lev FROM levelled WHERE NOT is_full ORDER BY lim / weight, place LIMIT 1) END AS target FROM levelled
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
  CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM rated
"""
