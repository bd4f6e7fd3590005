"""Operator 12: byte-level BPE encoding by a pair occurrence index, and decoding.

The words of a part of a partition lie one behind the other as byte symbols. An index maps
each mergeable pair to all its positions there. The ranks that occur are applied in
ascending order, each at all its positions at once; a merge takes the two symbols' pairs
with their neighbours out of use and enters the new symbol's pairs in their lists. Words
that a worker remembers are not laid out again.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.packing import vocabulary_path
from claimloom.llm.text import slices, warm

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of words that one pair index covers; a longer word has one of its own.
INDEX_BYTES = 1 << 20
#: Chunks and words whose ids a worker remembers.
REMEMBERED = 600_000
#: Texts are cut into chunks at single spaces before something visible, which no word crosses.
CUT = re.compile(r"(?<! )(?= \S)")
_UNEVEN = re.compile(r" (?:\s|$)").search
#: The word pattern of byte-level BPE vocabularies (fixed value).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: From U+0530 on, classes may differ between Unicode versions: the library cuts such chunks itself.
UNSETTLED = re.compile("[\u0530-\U0010ffff]").search
#: Positions of a pair from which on they are worked off as arrays.
MANY = 40


def chunks(text: str) -> list[str]:
    """The text in a row of chunks that no word crosses."""
    if _UNEVEN(text):
        return [c for c in CUT.split(text) if c]
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where visible, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary in the ``tokenizers`` JSON format."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before, added = told["model"], told["pre_tokenizer"] or {}, told["added_tokens"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or told["normalizer"] or not plain or odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        self.cut_words = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.alphabet = byte_alphabet()
        self.bytes = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in added)]))
        for token, k in model["vocab"].items():
            self.bytes[k] = bytes(map(self.alphabet.__getitem__, token)) if all(c in self.alphabet for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in added}
        for token, k in self.special.items():
            self.bytes[k] = token.encode()
        symbols = {b: model["vocab"][c] for c, b in self.alphabet.items()}
        self.of_byte = np.array([symbols[b] for b in range(256)], np.int32)
        self.merges, self.rank = [], {}
        made = dict.fromkeys(symbols.values(), -1)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ids = model["vocab"][left], model["vocab"][right], model["vocab"][left + right]
            if max(made.get(ids[0], rank), made.get(ids[1], rank)) >= rank or ids[2] in made:
                raise ValueError(f"{path}: merge {rank} does not follow from earlier ones")
            if self.bytes[ids[2]] != self.bytes[ids[0]] + self.bytes[ids[1]]:
                raise ValueError(f"{path}: merge {rank} changes bytes")
            made[ids[2]] = rank
            self.merges.append(ids)
            self.rank[ids[0] << 32 | ids[1]] = rank
        byte_of = np.full(len(self.bytes), -1)
        byte_of[self.of_byte] = np.arange(256)
        self.first_ranks = np.full((256, 256), -1, np.int32)
        for rank, (left, right, _) in enumerate(self.merges):
            if byte_of[left] >= 0 and byte_of[right] >= 0:
                self.first_ranks[byte_of[left], byte_of[right]] = rank
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)

        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], order.astype(np.int32)

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair (left id times 2^32 plus right id), -1 for none."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.key_ranks[at], -1)

    def words(self, found: list[str]) -> tuple[list[bytes], list[int]]:
        """All chunks' words in a row, as bytes, between which no merge happens, and each chunk's number of them."""
        if not UNSETTLED("".join(found)):
            cut = list(map(WORD.findall, found))
            return list(map(str.encode, itertools.chain.from_iterable(cut))), list(map(len, cut))
        cut = [[bytes(map(self.alphabet.__getitem__, w)) for w, _ in self.cut_words(c)] if UNSETTLED(c) else list(map(str.encode, WORD.findall(c))) for c in found]
        return list(itertools.chain.from_iterable(cut)), list(map(len, cut))


def merge_words(words: list[bytes], vocabulary: Vocabulary, kind: str = "<u4") -> list[bytes]:
    """Each word's ids as numbers of ``kind``, by one pair index over all of them.

    Long lists of positions are worked off as arrays, short ones one by one; both see the same memory.
    """
    sizes = np.array(list(map(len, words)), np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    stops = np.cumsum(sizes)
    n, merges, rank_of = len(data), vocabulary.merges, vocabulary.rank
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[stops - 1] = -1
    before[stops - sizes] = -1
    ranks = np.full(n, -1, np.int32)
    ranks[:-1] = vocabulary.first_ranks[data[:-1], data[1:]]
    ranks[after < 0] = -1
    index: dict[int, list] = {}
    active: list[int] = []

    def enter(ranks: np.ndarray, positions: np.ndarray) -> None:
        """Put positions into the lists of their pairs; rank -1 is no pair."""
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        if not len(order):
            return
        ranks, positions = ranks[order], positions[order].tolist()
        first = np.flatnonzero(np.diff(ranks, prepend=-1))
        for r, at, stop in zip(ranks[first].tolist(), first.tolist(), [*first[1:].tolist(), len(ranks)], strict=True):
            if r in index:
                index[r] += positions[at:stop]
            else:
                index[r] = positions[at:stop]
                heapq.heappush(active, r)

    enter(ranks, np.arange(n, dtype=np.int32))
    symbols, after, before = (array("i", x.tobytes()) for x in (vocabulary.of_byte[data], after, before))
    symbols_, after_, before_ = (np.frombuffer(x, np.int32) for x in (symbols, after, before))
    while active:
        rank = heapq.heappop(active)
        left, right, new = merges[rank]
        positions = index.pop(rank)
        if len(positions) > MANY and left != right:
            p = np.unique(positions)
            p = p[symbols_[p] == left]
            p = p[after_[p] >= 0]
            q = after_[p]
            p, q = p[symbols_[q] == right], q[symbols_[q] == right]
            symbols_[p], symbols_[q] = new, -1
            follow = after_[q]
            after_[p] = follow
            inner = follow >= 0
            before_[follow[inner]] = p[inner]
            p, follow, lead = p[inner], follow[inner], before_[p]
            lead = lead[lead >= 0]
            pairs = np.concatenate([np.int64(new) << 32 | symbols_[follow], symbols_[lead].astype(np.int64) << 32 | new])
            enter(vocabulary.ranks(pairs), np.concatenate([p, lead]))
            continue
        for p in sorted(positions):  # in order, since of three equal symbols the first two merge
            q = after[p]
            if symbols[p] != left or q < 0 or symbols[q] != right:
                continue  # a neighbour's merge came first
            symbols[p], symbols[q] = new, -1
            follow, lead = after[q], before[p]
            after[p] = follow
            if follow >= 0:
                before[follow] = p
                r = rank_of.get(new << 32 | symbols[follow])
                if r is not None:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(active, r)
                    index[r].append(p)
            if lead >= 0:
                r = rank_of.get(symbols[lead] << 32 | new)
                if r is not None:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(active, r)
                    index[r].append(lead)
    kept = symbols_ >= 0
    ids = symbols_[kept].astype(kind).tobytes()
    edges = [0, *(np.dtype(kind).itemsize * np.cumsum(kept)[stops - 1]).tolist()] if n else [0]
    return [ids[a:b] for a, b in itertools.pairwise(edges)]


def trimmed(known: dict, fresh: set, wanted: set) -> tuple[dict, set]:
    """``known``, or its first half where ``fresh`` is too much beside it, and what of ``wanted`` it lacks."""
    if len(known) + len(fresh) <= REMEMBERED:
        return known, fresh
    known = dict(itertools.islice(known.items(), REMEMBERED // 2))  # those met first are the common ones
    return known, wanted.difference(known)


class Encoder:
    """Ids of texts as bytes of numbers of ``kind``, remembering chunks and words up to a fixed number."""

    def __init__(self, path: str, special: bool = True, kind: str = "<u4", vocabulary: Vocabulary | None = None):
        self.vocabulary, self.kind = vocabulary or Vocabulary(path), kind
        self.special = {t: np.array([k], kind).tobytes() for t, k in self.vocabulary.special.items()} if special else {}
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, names)) + ")").split
        self.chunks: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def ids_of(self, found: list[str]) -> list[bytes]:
        """The ids of each of these chunks, none of them empty."""
        words, counts = self.vocabulary.words(found)
        distinct = set(words)
        self.words, new = trimmed(self.words, distinct.difference(self.words), distinct)
        new, at = list(new), 0
        while at < len(new):
            stop, size = at + 1, len(new[at])
            while stop < len(new) and size + len(new[stop]) <= INDEX_BYTES:
                size += len(new[stop])
                stop += 1
            self.words.update(zip(new[at:stop], merge_words(new[at:stop], self.vocabulary, self.kind), strict=True))
            at = stop
        ids = list(map(self.words.__getitem__, words))
        stops = [0, *np.cumsum(counts).tolist()]
        return [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in itertools.pairwise(stops)]

    def learn(self, wanted: set[str]) -> None:
        """Have the ids of all these chunks at hand."""
        self.chunks, fresh = trimmed(self.chunks, wanted.difference(self.chunks), wanted)
        fresh = [c for c in fresh if c]
        self.chunks.update(zip(fresh, self.ids_of(fresh), strict=True))
        self.chunks[""] = b""

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [self.split_special(t) if any(s in t for s in self.special) else [t] for t in texts]
        cut = [[[p] if p in self.special else chunks(p) for p in of_text] for of_text in parts]
        wanted = set().union(*(found for of_text in cut for found in of_text))
        if self.special:
            wanted.difference_update(self.special)
        self.learn(wanted)
        self.chunks.update(self.special)
        ids = self.chunks.__getitem__
        return [b"".join(map(ids, itertools.chain.from_iterable(of_text) if len(of_text) > 1 else of_text[0])) for of_text in cut]


def encode_texts(documents: DataFrame, path: str | None = None, special: bool = True) -> DataFrame:
    """``doc_id, ids`` for each row: the ids of its whole text as ``tokenizers`` gives them without special tokens added.

    Null and empty texts have no ids. With ``special`` the special tokens' own strings in a
    text are those tokens, as in the library; otherwise they are ordinary text. Repeated
    rows, null ids and rows of one id with several texts are encoded row by row; other
    columns, whatever their names, are not read. An empty table gives no rows. ``path``
    names the vocabulary file, which must exist on every executor.
    """
    path = path or vocabulary_path(VOCABULARY)

    def encode(batches):
        encoder = warm(("byte bpe", path, special), lambda: Encoder(path, special))
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids = encoder([t or "" for t in batch.column(1).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids array<int>")


class Decoder:
    """Texts of ids, by one gather from the vocabulary's bytes."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.bytes = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        self.lengths = vocabulary.lengths
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.lengths))]  # the library passes over ids that it does not have
        sizes = self.lengths[ids]
        stops = np.cumsum(sizes)
        at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.starts[ids] - stops + sizes, sizes)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the text of each row's ids, special tokens kept; bytes that are no UTF-8 become U+FFFD.

    Null or empty ids give the empty text; ids outside the vocabulary are passed over.
    """
    path = path or vocabulary_path(VOCABULARY)

    def decode(batches):
        decoder = warm(("byte decoder", path), lambda: Decoder(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [decoder(np.zeros(0, np.int64) if x is None else x) for x in part.column(1).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded string")
