"""Findings that the personal data and secret scans once dropped, and searches and links that once cost too much or were cut."""

import pickle
import time

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from claimloom.llm import duplicates, packing, privacy, secrets, text, topk, toxicity
from tests.llm.test_mixing_packing_duplicates import brute_components, near_corpus


@pytest.mark.parametrize("at", [" (at) ", "[at]"])
def test_digitless_addresses_with_at_spelled_out_are_spans(at):
    address = f"mira.kolb{at}example.org"
    text = f"write to {address} soon"
    tags = np.zeros(len(text), np.int8)
    tags[9 : 9 + len(address)] = 1
    assert privacy.model_spans(text, tags, []) == [("email", 9, 9 + len(address))]
    tags[:] = 0
    tags[0:8] = 1
    assert privacy.model_spans(text, tags, []) == []


def test_threshold_keeps_the_recall_even_under_a_half():
    rng, net = np.random.default_rng(1), secrets.CharNet()
    codes, marks = rng.integers(0, secrets.CLASSES, (400, secrets.WIDTH)), np.ones((400, secrets.WIDTH), np.float32)
    labels = (np.arange(400) % 2).astype(np.float32)
    net.calibrate(codes, marks, labels)
    assert net.threshold < 0.5 and (net.score(codes, marks)[labels == 1] >= net.threshold).mean() >= secrets.RECALL


def test_secret_recall_through_candidates():
    rows = [r for r in secrets.labelled_findings(800, 99) if r[3]]
    found = secrets.found_spans([t for t, *_ in rows], secrets.trained())
    hits = sum(any(s < b and a < e for _, s, e in every) for (_, a, b, _), (_, every) in zip(rows, found, strict=True))
    print("found end to end", hits, len(rows))
    assert hits / len(rows) >= 0.98


def unit_rows(n, width, seed):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)


def test_search_of_unskewed_vectors_is_not_slow():
    """400 queries on 8,192 vectors took 14.6 CPU seconds when each query read its lists alone."""
    rows = unit_rows(8192, 64, 2)
    start = time.process_time()
    found = topk.nra(rows[:400], np.arange(400), rows, np.arange(8192), 20)
    assert time.process_time() - start < 7
    whole = rows[:400] @ rows.T
    whole[np.arange(400), np.arange(400)] = -(1 << 40)
    for k, (ids, scores, _) in enumerate(found):
        best = np.lexsort((np.arange(8192), -whole[k]))[:20]
        assert ids.tolist() == best.tolist() and scores.tolist() == whole[k][best].tolist()


@pytest.mark.parametrize(("n", "scale", "k"), [(7000, 1, 20), (300, 1 << 14, 7), (4500, 1 << 20, 20), (19, 1, 20), (1, 1, 3)])
def test_search_over_several_lists_keeps_ties_and_wide_sums(n, scale, k):
    """Many equal rows, ids in any order, and sums in 32-bit floats, 64-bit floats and whole numbers."""
    rng = np.random.default_rng(n)
    rows, ids = unit_rows(n, 6, n) * scale, rng.permutation(3 * n)[:n]
    rows[rng.random(n) < 0.2] = rows[0]
    queries = min(n, 60)
    whole = rows[:queries] @ rows.T
    for q, (got, scores, _) in enumerate(topk.nra(rows[:queries], ids[:queries], rows, ids, k)):
        best = sorted((-int(s), int(i)) for s, i in zip(whole[q], ids, strict=True) if i != ids[q])[:k]
        assert [(-int(s), int(i)) for s, i in zip(scores, got, strict=True)] == best


@pytest.mark.parametrize("size", [4, 5])
def test_links_that_share_one_very_common_band_alone(spark, monkeypatch, size):
    """Such a band was cut by second bands, and pairs that share no second one were dropped."""
    for name, value in {"BLOCK": 3, "COMMON": 3, "band_keys": lambda register: np.array([7], np.int64)}.items():
        monkeypatch.setattr(duplicates, name, value)
    rows = near_corpus(size)
    rows += [(len(rows), rows[3][1]), (len(rows) + 1, None), (len(rows) + 2, "")]
    found = duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, size)


def test_linked_sets_share_a_rare_shingle():
    rng = np.random.default_rng(3)
    tokens = np.sort(rng.choice(1 << 40, 300, replace=False).astype(np.uint64))
    counts = rng.integers(2, 9, 300)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        own = rng.choice(np.concatenate([tokens, tokens + np.uint64(1)]), n, replace=False)
        other = np.concatenate([own[: -(-n * 9 // 10)], rng.integers(1 << 41, 1 << 42, n // 12).astype(np.uint64)])
        if duplicates._similar(np.sort(own), np.sort(other), 80):
            assert len(np.intersect1d(*(duplicates._prefix(np.sort(x), tokens, counts, 80) for x in (own, other))))


def test_a_worker_holds_one_model_at_a_time():
    path = packing.vocabulary_path()
    held = packing.encoder(path)
    assert packing.encoder(path) is held and len(text._WARM) == 1
    blob = pickle.dumps(toxicity.Toxicity())
    assert toxicity.scorer(blob) is toxicity.scorer(blob) and list(text._WARM) == [("scorer", blob)]
    text.let_go()
    assert not text._WARM


def test_stages_send_workers_small_batches(spark, tmp_path):
    """10,000 texts were one batch, however long, held on both sides of the socket."""
    spark.createDataFrame([(i, "word " * 10_000) for i in range(200)], "doc_id long, text string").repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.without_secrets(spark, docs, str(tmp_path))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["rows", "bytes"])

    found = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in found) == 200 and max(r.bytes for r in found) < 2 * (2 << 20)


def test_a_worker_gives_memory_back_before_it_loads_a_model(monkeypatch):
    """What scans without a model had freed stayed with the worker beside the next model."""
    text.let_go()
    given = []
    monkeypatch.setattr(text, "give_back", lambda: given.append(1))
    assert text.warm("model", lambda: len(given)) == 1 and text.warm("model", list) == 1 and given == [1]
    text._WARM.clear()
