"""The pipeline's stages on a small corpus: what each must keep, drop and change."""

import pytest

import corpus_pipeline
from claimloom.llm import packing

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, toxicity int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    home, filler = tmp_path_factory.mktemp("corpus"), [f"word{k}" for k in range(60)]
    text = lambda i: " ".join(filler[(i * 7 + k * k) % 60] for k in range(40 + i % 30))
    rows = [(i, text(i) + (" crook vilest crook" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0, i) for i in range(120)]
    rows += [(500, rows[1][1], "en", "s1", 0, 1), (501, rows[1][1] + " tail", "en", None, 0, 2), (502, 'token = "0123456789abcdef0123456789abcdef" ' + " ".join(filler[(11 * k + 5) % 60] for k in range(55)), "en", "s0", 0, 3), (503, None, None, None, None, 4), (None, "no id here", "en", "s1", 0, 5)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return str(home), {r[0]: r for r in rows}


def test_stages(spark, corpus):
    home, rows = corpus
    docs = spark.read.parquet(f"{home}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "secrets", "mixing", "packing"]
    tame = corpus_pipeline.drop_toxic(spark, docs, home)
    assert tame.columns == docs.columns
    ids = {r.doc_id for r in tame.collect()}
    toxic = {i for i in range(0, 120, 5)}
    assert len(ids & toxic) <= 1 and len(set(rows) - toxic - ids) <= 1
    single = corpus_pipeline.one_of_each(spark, tame, home)
    kept = {r.doc_id for r in single.collect()}
    assert single.columns == docs.columns and {500, 501} & kept == set() and 1 in kept and {503, None} <= kept
    clean = {r.doc_id: r for r in corpus_pipeline.without_secrets(spark, single, home).collect()}
    assert set(clean) == kept and clean[502].text.startswith("[SECRET]") and clean[502].n_chars == len(clean[502].text) and clean[1].text == rows[1][1] and clean[503].text is None
    mixed = corpus_pipeline.mixed(spark, corpus_pipeline.without_secrets(spark, single, home), home)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= kept


def test_run_packs_what_is_mixed(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0]).collect()
    assert out and corpus_pipeline.ORACLE_SQL is None
    for k in {r.sequence_id for r in out}:
        parts, at = sorted((r.offset, r.length) for r in out if r.sequence_id == k), 0
        for offset, length in parts:
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
