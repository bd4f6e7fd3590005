"""The ``opN_`` queries with their production parameters, and ``pipeline``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from claimloom.llm import alignment, bpe, duplicates, licenses, mixing, packing, privacy, quality_rules, rules, secrets, topk, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(documents, quality_rules.trusted_texts(documents, table(spark, sf_dir, "labels")))


def op2_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark, sf_dir):
    return duplicates.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_personal_data(spark, sf_dir):
    return privacy.find_personal_data(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = rules.held_out(F.col("doc_id"), 5, 0)
    net = toxicity.train_from_labels(documents, labels.where(~held))
    scored = toxicity.score_toxicity(documents.select("doc_id", "text"), net)
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op7_rule_ensemble(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = rules.fit_from_labels(documents, labels.where(~rules.held_out(F.col("doc_id"), 3, 1)))
    scored = rules.score_quality(documents, model)
    return scored.select("doc_id", rules.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_bpe_round_trip(spark, sf_dir):
    coded = bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents")))
    told = F.array_join(F.col("ids").cast("array<string>"), ",")
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(told).alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def op13_tokenizer_alignment(spark, sf_dir):
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"))


def queries() -> dict:
    import corpus_pipeline

    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.op2_sql(), "op4_mixing": mixing.OP4_SQL, "op10_exact_top_k": topk.OP10_SQL}
