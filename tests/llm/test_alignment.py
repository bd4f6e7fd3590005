"""Operator 13 against both libraries and a plain sweep."""

import functools
import hashlib
from collections import Counter

import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from claimloom.llm import alignment, bpe, queries
from claimloom.llm.packing import vocabulary_path
from tests.llm.test_bpe import ODD, made_texts

A_PATH, B_PATH = vocabulary_path(alignment.BYTE_VOCABULARY), vocabulary_path(alignment.PIECE_VOCABULARY)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B_PATH)


@functools.cache
def byte_tokens():
    return bpe.Vocabulary(A_PATH).bytes


def plain(libraries, rows):
    """Each row's result, by whole texts and dictionaries of ends."""
    a, b = libraries
    of_a = byte_tokens()
    docs, count = [], Counter()
    for doc_id, text in rows:
        groups, links = [], []
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        xs = [of_a[k] for k in x]
        ys = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not text or b"".join(xs) != (whole := (" " + text).encode()) or b"".join(ys) != whole:
            docs.append((doc_id, 0, 0, [], []))
            continue
        i = j = at_a = at_b = 0
        group = [], []
        while i < len(x) or j < len(y):
            if at_a <= at_b:
                at_a, i = at_a + len(xs[i]), i + 1
                group[0].append(x[i - 1])
            else:
                at_b, j = at_b + len(ys[j]), j + 1
                group[1].append(y[j - 1])
            if at_a == at_b:
                groups.append("|".join(",".join(map(str, g)) for g in group))
                links.append((x[i - 1], y[j - 1]))
                group = [], []
        assert group == ([], [])
        count.update(links)
        docs.append((doc_id, len(x), len(y), groups, links))
    best = Counter()
    for (_, k), n in count.items():
        best[k] = max(best[k], n)
    sha = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    key = lambda r: tuple(-1 if v is None else v for v in r)
    return sorted(((d, n, m, len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), sha(g)) for d, n, m, g, k in docs), key=key)


def run(frame):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in alignment.align_tokenizers(frame).collect()), key=lambda r: tuple(-1 if v is None else v for v in r))


LONG = "word élan  café\n日本 " * 800
ROWS = [(k, t) for k, t in enumerate([*ODD, *made_texts(250, 9), LONG, None, "<s> </s> <unk> <|endoftext|>", "a▁b", " ▁", "▁", "x" * 3000])] + [(3, "twice"), (3, "twice"), (None, "no id"), (None, None)]


def test_texts_of_any_kind(spark, libraries):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    assert run(frame) == plain(libraries, ROWS)


@pytest.mark.parametrize("span, step, remembered", [(64, 50, 10), (7, 1, 10**6), (1, 10**6, 10**6)])
def test_spans_steps_and_forgetting_change_nothing(spark, libraries, monkeypatch, span, step, remembered):
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 5000][::2] + [(9000, LONG[:3000])]
    pair, machine = alignment.Pair(A_PATH, B_PATH), None
    lengths = alignment.token_lengths(A_PATH, B_PATH)
    assert [x.tolist() for x in lengths] == [x.tolist() for x in pair.lengths]
    monkeypatch.setattr(alignment, "SPAN", span)
    monkeypatch.setattr(alignment, "STEP", step)
    digits = alignment.Digits(max(map(len, lengths)))
    # the encoder and the machine run in this process, so that the small settings hold
    runs, found = [], {}
    for uid, (doc_id, text) in enumerate(rows):
        both = pair([text or ""])[0]
        if both is None:
            runs.append((uid, doc_id, -1, 0, b""))
            continue
        for side in (0, 1):
            runs += [(uid, doc_id, s, side, part) for s, part in alignment.spans(both[side], pair.kinds[side], pair.lengths[side])]
    runs.sort(key=lambda r: (r[0], r[2], r[3]))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*runs[k : k + 13]), alignment._RUNS, strict=True)], schema=alignment._RUNS) for k in range(0, len(runs), 13)]
    machine = alignment.Machine(lengths, digits, True)
    for out in machine.read(batches):
        for uid, _, n_a, n_b, n_groups, n_links, links, sha, groups in out:
            d = found.setdefault(uid, [0, 0, 0, 0, 0, "", ""])
            for k, v in enumerate((n_a, n_b, n_groups, n_links, len(links))):
                d[k] += v
            d[5] += sha or ""
            d[6] += groups or ""
    for uid, row in enumerate(rows):
        _, n_a, n_b, n_groups, n_links, _, _, sha = plain(libraries, [row])[0]
        assert found[uid][:6] == [n_a, n_b, n_groups, n_links, n_links, sha]
        assert hashlib.sha256(found[uid][6].encode()).hexdigest() == sha or not found[uid][6]


def test_counts_without_a_broadcast(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    rows = ROWS[::5]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == plain(libraries, rows)


def test_empty_table_and_clashing_names(spark, libraries):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []
    frame = spark.createDataFrame([(1, "some text", 5, "u")], "doc_id int, text string, uid int, links string")
    assert run(frame) == plain(libraries, [(1, "some text")])


def test_query(spark, libraries):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted(tuple(r[c] for c in columns) for r in queries.op13_tokenizer_alignment(spark, folder).collect())
    assert got == plain(libraries, rows)
