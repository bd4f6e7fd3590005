"""Operator 12 against the library, a plain merge loop and the round trip."""

import hashlib
import random
import unicodedata

import numpy as np
import pytest
from tokenizers import Tokenizer

from claimloom.llm import bpe, queries
from claimloom.llm.packing import vocabulary_path

PATH = vocabulary_path(bpe.VOCABULARY)
ODD = ["", " ", "   ", "a", "a" * 5000, "abab" * 999, " x  y\n\n z\t", "it's we'll 'd", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "\u0000▁é x y　z \x1c\x1dq", "日本語 テキスト 한국어", "😀😀 🏳️‍🌈", "a  b  c \x85d", " \n" * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def made_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "a", "b", "the", " th", "é", "'s", "'", "9", "٣", "́", "א", "!", "?!", "\x1c", " ", "<|endoftext|>", "﻿", " zz" * 3]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def ids_of(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)]


def test_ids_and_decoded_texts_are_the_library_s(library):
    texts = ODD + made_texts(1500, 3)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(bpe.Encoder(PATH), texts) == want
    decode = bpe.Decoder(PATH)
    assert [decode(np.array(x, np.int64)) for x in want] == library.decode_batch(want, skip_special_tokens=False)
    for broken in ([200, 201, 5, 130], [50256, 99999], [240, 159], []):
        assert decode(np.array(broken, np.int64)) == library.decode(broken, skip_special_tokens=False)


def test_special_strings_can_be_plain_text(library):
    texts = ODD + made_texts(300, 4)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    assert ids_of(bpe.Encoder(PATH, special=False), texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_what_a_worker_forgets_and_small_indexes_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "INDEX_BYTES", 10)
    monkeypatch.setattr(bpe, "MANY", 2)
    encoder, texts = bpe.Encoder(PATH), ODD + made_texts(400, 5)
    got = [x for k in range(0, len(texts), 7) for x in ids_of(encoder, texts[k : k + 7])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("many", [0, 3, 10**9])
def test_pair_index_is_the_plain_merge_loop(vocabulary, monkeypatch, many):
    monkeypatch.setattr(bpe, "MANY", many)
    rng = random.Random(6)
    words = [bytes(rng.choice(b"aabbcdeinrst ") for _ in range(rng.randrange(1, 25))) for _ in range(400)]

    def plain(word):
        ids = [int(vocabulary.of_byte[b]) for b in word]
        while True:
            ranks = [vocabulary.rank.get(a << 32 | b, 10**9) for a, b in zip(ids, ids[1:], strict=False)]
            if not ranks or min(ranks) == 10**9:
                return ids
            k = ranks.index(min(ranks))
            ids[k : k + 2] = [vocabulary.merges[ranks[k]][2]]

    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_words(words, vocabulary)] == [plain(w) for w in words]


def test_cuts_and_classes_agree_with_the_library_s_words(vocabulary):
    for c in range(0x530):
        text = f"x{chr(c)}{chr(c)} {chr(c)}1"
        assert vocabulary.words([text])[0] == [bytes(map(vocabulary.alphabet.__getitem__, w)) for w, _ in vocabulary.cut_words(text)]
    for c in range(0x110000):
        if unicodedata.category(chr(c)) != "Cs" and len(bpe.chunks(text := f"a {chr(c)}b")) > 1:
            assert 1 in [at for _, (at, _) in vocabulary.cut_words(text)]


def test_rows_of_any_kind(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a b", "z"), (2, "a b", None), (2, "a b", None), (3, "y " * 200_000, "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = bpe.decode_ids(bpe.encode_texts(frame)).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((d or 0, t or "") for d, t, _ in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode_ids(bpe.encode_texts(empty)).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode_ids(nulls).first().decoded == ""


def test_query_gives_the_library_s_digests(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_bpe_round_trip(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert [got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256] == [len(ids), *digests]
