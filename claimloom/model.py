"""The claim-graph data model over the driver's tables.

Each view is one SELECT that Spark and DuckDB read alike, so an operator and the SQL that
checks it start from the same rows: claims (subject, relation, object, categories, volume,
pages, sentence), tags (entities with frequency) and sentences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A quarter of the claims lies among some 220 names at every size, one component; all others
#: lie among 16 names for each 64 orders, components that grow in number, some of them joined.
CLAIMS = """
SELECT o_orderkey AS claim_id, CAST(floor(o_orderkey / 4) AS BIGINT) AS sid, CAST(o_orderkey % 4 AS INT) AS ordinal,
  concat('vol', CAST(o_orderkey % 3 + 1 AS STRING)) AS volume, CAST(o_custkey % 97 + 1 AS INT) AS page,
  concat('n', CAST(sn AS STRING)) AS subject, o_orderpriority AS relation, concat('n', CAST(ob AS STRING)) AS object,
  concat('E', CAST(sn % 9 AS STRING)) AS s_cat, concat('R', substring(o_orderpriority, 1, 1)) AS r_cat,
  concat('E', CAST(ob % 9 AS STRING)) AS o_cat, o_orderstatus AS decision, o_totalprice AS score
FROM (SELECT *, CASE WHEN o_custkey % 4 = 0 THEN o_custkey % 211 ELSE 1000 + 16 * CAST(floor(o_orderkey / 64) AS BIGINT) + o_custkey % 16 END AS sn,
  CASE WHEN o_custkey % 4 = 0 THEN (o_orderkey * 7) % 223 ELSE 1000 + 16 * greatest(0, CAST(floor(o_orderkey / 64) AS BIGINT) - CASE WHEN o_orderkey % 181 = 0 THEN 1 ELSE 0 END) + (o_orderkey * 7) % 16 END AS ob FROM orders) o
"""
ENDS = f"""
SELECT claim_id, volume, page, 'subject' AS role, subject AS tag, object AS other, relation, score FROM ({CLAIMS}) c1
UNION ALL SELECT claim_id, volume, page, 'object' AS role, object AS tag, subject AS other, relation, score FROM ({CLAIMS}) c2
"""
TAGS = f"SELECT tag, count(*) AS frequency FROM ({ENDS}) e GROUP BY tag"
SENTENCES = "SELECT doc_id AS sid, concat('vol', CAST(doc_id % 3 + 1 AS STRING)) AS volume, CAST(doc_id % 97 + 1 AS INT) AS page, lang, source, text FROM documents"
VECTORS = "SELECT vec_id, concat('n', CAST(vec_id AS STRING)) AS tag, embedding, label FROM embeddings"
VIEWS = {"claims": CLAIMS, "ends": ENDS, "tags": TAGS, "sentences": SENTENCES, "vectors": VECTORS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the model as a DataFrame; only the columns in use reach the scan."""
    sources = {t: table(spark, sf_dir, t) for t in ("orders", "documents", "embeddings") if t in VIEWS[name]}
    text = VIEWS[name]
    for t in sources:
        text = text.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"FROM {t})", f"FROM {{{t}}})")
        text = text[: -len(t)] + f"{{{t}}}" if text.endswith(f"FROM {t}") else text
    return spark.sql(text, **sources)


def oracle(body: str, *views: str) -> str:
    """``body`` with the named views before it as CTEs."""
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    return f"WITH {heads}{',' if body.lstrip().startswith(',') else ''} {body.lstrip().removeprefix(',')}"
