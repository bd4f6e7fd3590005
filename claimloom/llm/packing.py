"""Operator 8: hierarchical residual best-fit packing of tokenised documents."""

from __future__ import annotations

import itertools
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.text import slices, warm
from claimloom.plans.lineage import cut

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Items that one task packs, and nodes whose underfull bins meet in one node of the next round.
LEAF_ITEMS = 20_000
FAN_IN = 8
#: A bin with at most this much room left is emitted where it is.
NEARLY_FULL = 8
#: A round that joins fewer than one in so many of its bins is the last.
STALLED = 200
#: Distinct words whose ids a worker remembers.
REMEMBERED = 700_000
#: White space that the tokenizer drops and never joins over: a text's ids are its words' ids in a row.
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Punctuation that may be cut from a word's end; none of it starts a contraction or closes a special token.
_TAIL = ".,!?;:*#$%&|"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids by ``tokenizers``, word by word, remembering words up to a fixed number.

    The tokenizer lower-cases and always cuts between an ASCII letter or digit and the
    punctuation after it, so a word's ids are those of its lower-cased stem and of its tail.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _parts(self, word: str) -> tuple[str, str]:
        if not word.isascii() or "<" in word:
            return word, ""
        stem = word.rstrip(_TAIL)
        if not stem or not stem[-1].isalnum():
            return word.lower(), ""
        return stem.lower(), word[len(stem) :]

    def _learn(self, fresh: list[str]) -> None:
        known, parts = self.known, [self._parts(w) for w in fresh]
        new = list({p for pair in parts for p in pair if p and p not in known})
        for word, encoding in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[word] = np.asarray(encoding.ids, "<u4").tobytes()
        known[""] = b""
        for word, (stem, tail) in zip(fresh, parts, strict=True):
            known[word] = known[stem] + known[tail]

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        found = _WORD.findall(text)
        fresh = list(set(found).difference(self.known))
        if fresh:
            if len(self.known) + 2 * len(fresh) > REMEMBERED:  # the words met first are the common ones
                self.known = dict(itertools.islice(self.known.items(), REMEMBERED // 2))
                fresh = list(set(found).difference(self.known))
            self._learn(fresh)
        return b"".join(map(self.known.__getitem__, found))


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, which later tasks of the same worker find warm until another operator lets it go."""
    return warm(("encoder", path), lambda: WordEncoder(path))


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and ``uid`` for each piece of at most ``capacity`` tokens.

    A null or empty text is the end id alone. ``path`` names the vocabulary file; it must
    exist on every executor.
    """
    path = path or vocabulary_path()
    end = np.asarray([end_id], "<u4").tobytes()
    shape = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def encode(batches):
        words = encoder(path)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                data = words(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 5, shape, strict=True)], schema=shape)

    pieces = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encode, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    return cut(pieces.withColumn("uid", F.monotonically_increasing_id()))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first: indices of each bin's items. Ties keep the given order."""
    room = 0  # bit r is set while a bin with r free is open
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fits = room >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                room &= ~(1 << free)
            bins[b].append(k)
            free -= size
        else:
            b, free = len(bins), capacity - size
            bins.append([k])
        if free:
            open_bins[free].append(b)
            room |= 1 << free
    return bins


_BIN = "done boolean, node long, bin long, length long, uids array<long>, offsets array<int>"


def _pack_node(level: int, capacity: int, nearly_full: int):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "bin"], ascending=[False, True], kind="stable")
        node = int(items["node"].iloc[0])
        lengths, uids, offsets = items["length"].to_numpy(), items["uids"].tolist(), items["offsets"].tolist()
        rows = []
        for k, members in enumerate(best_fit(lengths, capacity)):
            base = np.concatenate([[0], np.cumsum(lengths[members])])
            at = [np.asarray(offsets[m]) + base[i] for i, m in enumerate(members)]
            full = base[-1] >= capacity - nearly_full
            name = (level << 56) | (node << 28) | k
            rows.append((full, node, name, int(base[-1]), np.concatenate([uids[m] for m in members]), np.concatenate(at).astype("int32")))
        return pd.DataFrame(rows, columns=["done", "node", "bin", "length", "uids", "offsets"])

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, leaf_items: int = LEAF_ITEMS, fan_in: int = FAN_IN, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """``uid, sequence_id, offset`` for every piece of ``pieces(uid, length)``.

    Leaves get some ``leaf_items`` pieces each by hash and pack them by best fit. Nearly
    full bins are emitted, and so is a bin that even the smallest waiting bin does not fit
    into; the others go on as items to a node that ``fan_in`` nodes share, round after round
    until one node is left. A node that would get more than ``leaf_items`` bins is split, so
    no task holds more (give or take the hash's spread); where nodes can then shrink no
    further, rounds go on over newly dealt nodes while they still join bins.
    """
    nodes = max(1, -(-pieces.count() // leaf_items))
    items = pieces.select(
        F.pmod(F.xxhash64("uid"), F.lit(nodes)).alias("node"), F.col("uid").alias("bin"), "length", F.array("uid").alias("uids"), F.array(F.lit(0)).alias("offsets")
    )
    emitted, level, before = None, 0, None
    while True:
        bins = cut(items.groupBy("node").applyInPandas(_pack_node(level, capacity, nearly_full), _BIN))
        waiting, least = bins.where("not done").agg(F.count("*"), F.min("length")).first()
        if waiting:
            closed = F.col("done") | (F.col("length") + F.lit(least) > capacity)
            waiting = bins.where(~closed).count()
        last = nodes == 1 or not waiting or (before is not None and before - waiting < before // STALLED)
        done = bins if last else bins.where(closed)
        emitted = done if emitted is None else emitted.union(done)
        if last:
            break
        fewer, level = -(-nodes // fan_in), level + 1
        split = -(-waiting // leaf_items)
        before = waiting if split >= nodes else None
        nodes = min(nodes, max(fewer, split))
        node = F.col("node") % nodes if nodes == fewer else F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(nodes))
        items = bins.where(~closed).select(node.alias("node"), "bin", "length", "uids", "offsets")
    placed = emitted.select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip("uids", "offsets")).alias("at"))
    return placed.select(F.col("at.uids").alias("uid"), "sequence_id", F.col("at.offsets").cast("long").alias("offset"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Documents as packed sequences: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Every row of ``documents`` is packed, repeated rows and null ids too; null and empty
    texts are one end token. Offsets in a sequence are gapless from 0. An empty table
    gives no rows.
    """
    pieces = token_pieces(documents, capacity, path)
    return pieces.join(pack_pieces(pieces, capacity), "uid").drop("uid")
