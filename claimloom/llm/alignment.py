"""Operator 13: alignment of two tokenizers by an event sweep.

Each token of either side ends at a byte offset of its text. These end events of both sides
are put together, dealt by document and sorted by offset; a machine reads them in a stream
and keeps, besides its counters and a running digest, only the tokens since the last offset
at which both sides ended. Such an offset closes a group and links the two tokens that end
there. Events travel in runs: a row holds one side's events within one span of offsets.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import bpe
from claimloom.llm.packing import vocabulary_path
from claimloom.llm.text import slices, warm
from claimloom.plans.lineage import checkpoint_dir, cut, delete_folder

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose events make one row.
SPAN = 1 << 16
#: Bytes of text that are encoded together, and bytes of runs that the machine reads together.
SLICE, STEP = 2 << 20, 1 << 20
#: Linked id pairs up to which their counts are broadcast. One token's bytes end the other's, so the
#: vocabularies bound them: some 800,000 for 50,000 and 32,000 ids, however long the table is.
BROADCAST_PAIRS = 4_000_000
REMEMBERED = 400_000


class PieceEncoder:
    """Ids of chunks by ``sentencepiece``; pieces must not hold a space mark behind another character."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.bytes = [bytes([int(self.model.id_to_piece(k)[3:5], 16)]) if self.model.is_byte(k) else self.model.id_to_piece(k).replace("▁", " ").encode() for k in ids]
        if any(b" " in b.lstrip(b" ") for b in self.bytes):
            raise ValueError(f"{path}: pieces that hold several words")
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)

    def __call__(self, chunks: list[str]) -> list[list[int]]:
        """Of chunks that begin with a space, which the model adds itself."""
        return self.model.encode([c[1:] for c in chunks], num_threads=1)


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


class Pair:
    """Both sides' ids of texts, remembering chunks up to a fixed number.

    The byte-level side's tokens always join to the text's bytes: its vocabulary is checked
    when it is read. The other side's are compared chunk by chunk.
    """

    def __init__(self, byte_path: str, piece_path: str):
        self.b = PieceEncoder(piece_path)
        vocabulary = bpe.Vocabulary(byte_path)
        self.lengths = vocabulary.lengths, self.b.lengths
        self.kinds = tuple(_kind(len(x)) for x in self.lengths)
        self.a = bpe.Encoder(byte_path, special=False, kind=self.kinds[0], vocabulary=vocabulary)
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.uneven: set[str] = set()

    def learn(self, wanted: set[str]) -> None:
        fresh = wanted.difference(self.known_a)
        if len(self.known_a) + len(fresh) > REMEMBERED:
            self.known_a, self.known_b = (dict(itertools.islice(known.items(), REMEMBERED // 2)) for known in (self.known_a, self.known_b))
            self.uneven &= self.known_a.keys()
            fresh = wanted.difference(self.known_a)
        fresh = list(fresh)
        self.known_a.update(zip(fresh, self.a.ids_of(fresh), strict=True))
        letters, of_b, pieces = self.kinds[1][1:].replace("u2", "H").replace("u4", "I"), self.b.bytes.__getitem__, self.b(fresh)
        self.known_b.update((c, array(letters, p).tobytes()) for c, p in zip(fresh, pieces, strict=True))
        self.uneven.update(c for c, p in zip(fresh, pieces, strict=True) if b"".join(map(of_b, p)) != c.encode())

    def __call__(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """For each text the ids of both sides over space and text; None where the text is empty or their bytes are not that."""
        found = [bpe.chunks(" " + t) if t else [] for t in texts]
        found = [chunks if not chunks or chunks[0] else chunks[1:] for chunks in found]
        self.learn(set().union(*found))
        of_a, of_b, uneven = self.known_a.__getitem__, self.known_b.__getitem__, self.uneven
        bad = [not t or (uneven and not uneven.isdisjoint(chunks)) for t, chunks in zip(texts, found, strict=True)]
        return [None if b else (b"".join(map(of_a, chunks)), b"".join(map(of_b, chunks))) for b, chunks in zip(bad, found, strict=True)]


_RUNS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("span", pa.int64()), ("side", pa.int32()), ("ids", pa.binary())])


def spans(data: bytes, kind: str, lengths: np.ndarray) -> list[tuple[int, bytes]]:
    """A text's ids in runs, with the number of the span that each run's tokens end in."""
    ids = np.frombuffer(data, kind)
    span = (np.cumsum(lengths[ids]) - 1) // SPAN
    edges = [0, *(np.flatnonzero(np.diff(span)) + 1).tolist(), len(ids)]
    return [(int(span[a]), ids[a:b].tobytes()) for a, b in itertools.pairwise(edges)]


def end_events(documents: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``uid, doc_id, span, side, ids``: the end events of both sides (0 is A, 1 is B) in runs.

    A run holds the tokens of one side that end within one span of ``SPAN`` bytes, in order;
    each ends as many bytes behind the one before as its id has. A text without tokens is one
    run without events.
    """

    def encode(batches):
        pair = warm(("alignment", byte_path, piece_path), lambda: Pair(byte_path, piece_path))
        for batch in (part for whole in batches for part in slices(whole, 2, SLICE)):
            rows, texts = [], [t or "" for t in batch.column(2).to_pylist()]
            for uid, doc_id, text, both in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, pair(texts), strict=True):
                if both is None:
                    rows.append((uid, doc_id, -1, 0, b""))
                elif 4 * len(text) < SPAN:
                    rows += [(uid, doc_id, 0, 0, both[0]), (uid, doc_id, 0, 1, both[1])]
                else:
                    rows += [(uid, doc_id, span, side, part) for side in (0, 1) for span, part in spans(both[side], pair.kinds[side], pair.lengths[side])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _RUNS, strict=True)], schema=_RUNS)

    named = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return named.mapInArrow(encode, "uid long, doc_id long, span long, side int, ids binary")


class Digits:
    """Ids as text with the mark before each, as rows of bytes that end in zeros."""

    MARKS = (b"", b";", b",", b"|")

    def __init__(self, n: int):
        words = [str(k).encode() for k in range(n)]
        self.table = np.stack([np.array([m + w for w in words], f"S{1 + len(str(n))}").view(np.uint8).reshape(n, -1) for m in self.MARKS])
        self.sizes = np.array(list(map(len, words)), np.int64)

    def __call__(self, marks: np.ndarray, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The text, and where each id's part of it ends."""
        chars = self.table[marks, ids]
        return chars[chars != 0].tobytes(), np.cumsum(self.sizes[ids] + (marks > 0))


@dataclass
class State:
    """What the machine knows of the document it is in: the events since the last common end, the digest, and whether it had any group."""

    uid: int
    doc_id: int | None
    digest: object = field(default_factory=hashlib.sha256)
    begun: bool = False
    open: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # ids of A, of B

    def told(self) -> str:
        return self.digest.hexdigest() if self.begun else ""


_SWEPT = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("links", pa.list_(pa.int64())), ("groups_sha256", pa.string()), ("groups", pa.string())])
_SWEPT_DDL = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, links array<long>, groups_sha256 string, groups string"


class Machine:
    """Reads runs in the order of uid, span and side; emits rows that add up to each document's counts, links and groups."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], digits: Digits, with_groups: bool):
        self.lengths, self.digits, self.with_groups = lengths, digits, with_groups
        self.kinds = tuple(_kind(len(x)) for x in lengths)
        self.state: State | None = None
        self.held: list[tuple] = []

    def step(self, rows: list[tuple]) -> list[tuple]:
        """Runs of whole spans, in order; the last document may go on in the next step."""
        out, state = [], self.state
        if state and rows[0][0] != state.uid:
            out.append((state.uid, state.doc_id, 0, 0, 0, 0, [], state.told(), None))
            state = None
        state = state or State(rows[0][0], rows[0][1])
        uids = np.array([r[0] for r in rows], np.int64)
        first = np.flatnonzero(np.diff(uids, prepend=uids[0] - 1))
        doc_of_row = np.cumsum(np.diff(uids, prepend=uids[0]) != 0)
        n_docs, side_of = len(first), np.array([r[3] for r in rows])
        ids, docs, counts, ends = [], [], [], []
        for side in (0, 1):
            at = np.flatnonzero(side_of == side).tolist()
            new = np.frombuffer(b"".join([rows[k][4] for k in at]), self.kinds[side])
            sizes = np.array([len(rows[k][4]) for k in at], np.int64) // np.dtype(self.kinds[side]).itemsize
            doc = np.repeat(doc_of_row[at], sizes)
            kept = state.open[side]
            ids.append(np.concatenate([kept, new.astype(np.int64)]))
            docs.append(np.concatenate([np.zeros(len(kept), np.int64), doc]))
            counts.append(np.bincount(doc, minlength=n_docs))
            ends.append(np.cumsum(self.lengths[side][ids[side]]))
        # both sides of a whole document have as many bytes, so ends can be counted on over all documents of the step
        here = np.zeros((2, 1 + max(int(e[-1]) if len(e) else 0 for e in ends)), bool)
        for side in (0, 1):
            here[side, ends[side]] = True
        cut_a, cut_b = np.flatnonzero(here[1, ends[0]]), np.flatnonzero(here[0, ends[1]])
        links = ids[0][cut_a] << 32 | ids[1][cut_b]
        link_doc = docs[0][cut_a]
        text, text_at = self._text(ids, docs, cut_a, cut_b, state.begun)
        n_links = np.bincount(link_doc, minlength=n_docs)
        edges = np.concatenate([[0], np.cumsum(n_links)])
        for d in range(n_docs):
            row = rows[first[d]]
            if d:
                state = State(row[0], row[1])
            a, b = edges[d], edges[d + 1]
            part = text[text_at[a] : text_at[b]]
            state.digest.update(part)
            state.begun |= bool(b > a)
            groups = part.decode() if self.with_groups else None
            out.append((row[0], row[1], int(counts[0][d]), int(counts[1][d]), int(b - a), int(b - a), links[a:b], state.told() if d < n_docs - 1 else None, groups))
        state.open = tuple(x[c[-1] + 1 :] if len(c) else x for x, c in zip(ids, (cut_a, cut_b), strict=True))
        self.state = state
        return out

    def _text(self, ids, docs, cut_a, cut_b, begun: bool) -> tuple[bytes, np.ndarray]:
        """The groups' text, ``a1,a2|b1;a3|b2``, and where each group of it begins (one more place at the end)."""
        if not len(cut_a):
            return b"", np.zeros(1, np.int64)
        n_a, n_b = cut_a[-1] + 1, cut_b[-1] + 1
        before_a, before_b = np.concatenate([[0], cut_a + 1]), np.concatenate([[0], cut_b + 1])
        first_a, first_b = np.zeros(n_a + 1, np.int64), np.zeros(n_b + 1, np.int64)
        first_a[before_a], first_b[before_b] = 1, 1
        group_a, group_b = np.cumsum(first_a[:-1]) - 1, np.cumsum(first_b[:-1]) - 1
        merged, marks = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, 2, np.int64)
        merged[np.arange(n_a) + before_b[group_a]] = ids[0][:n_a]
        merged[np.arange(n_b) + before_a[group_b + 1]] = ids[1][:n_b]
        starts = before_a[:-1] + before_b[:-1]
        new_doc = np.diff(docs[0][cut_a], prepend=0 if begun else -1) != 0
        marks[starts] = np.where(new_doc, 0, 1)
        marks[before_a[1:] + before_b[:-1]] = 3
        text, stops = self.digits(marks, merged)
        return text, np.concatenate([np.where(starts > 0, stops[starts - 1], 0), stops[-1:]])

    def read(self, batches):
        for batch in batches:
            sizes = np.cumsum([0 if x is None else len(x) for x in batch.column(4).to_pylist()])
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP, side="right")))
                rows = self.held + list(zip(*(c.to_pylist() for c in batch.slice(at, stop - at).columns), strict=True))
                # the other side of the last span may come with the next rows
                last = len(rows) - sum(r[0] == rows[-1][0] and r[2] == rows[-1][2] for r in rows[-2:])
                self.held = rows[last:]
                if last:
                    yield self.step(rows[:last])
                at = stop
        if self.held:
            yield self.step(self.held)
        if self.state:
            yield [(self.state.uid, self.state.doc_id, 0, 0, 0, 0, [], self.state.told(), None)]


def token_lengths(byte_path: str, piece_path: str) -> tuple[np.ndarray, np.ndarray]:
    """The number of bytes of each token of both sides."""
    return bpe.Vocabulary(byte_path).lengths, PieceEncoder(piece_path).lengths


def sweep(events: DataFrame, lengths: tuple[np.ndarray, np.ndarray], with_groups: bool = False) -> DataFrame:
    """Rows that add up to each document (``uid``): counts, ``links`` (A id times 2^32 plus B id), and on one row its ``groups_sha256``.

    ``with_groups`` gives the groups' own text, too, in the order of the rows.
    """
    held = events.sparkSession.sparkContext.broadcast(lengths)  # a number a token

    def read(batches):
        most = max(map(len, held.value))
        digits = warm(("digits", most), lambda: Digits(most))
        for rows in Machine(held.value, digits, with_groups).read(batches):
            columns = list(zip(*rows, strict=True))
            offsets = np.concatenate([[0], np.cumsum(list(map(len, columns[6])))]).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.asarray(x, np.int64) for x in columns[6]])))
            yield pa.RecordBatch.from_arrays([links if f.name == "links" else pa.array(c, f.type) for c, f in zip(columns, _SWEPT, strict=True)], schema=_SWEPT)

    return events.repartition("uid").sortWithinPartitions("uid", "span", "side").mapInArrow(read, _SWEPT_DDL)


def link_counts(swept: DataFrame) -> DataFrame:
    """``link, times, best``: how many links hold each id pair, and whether no other pair of its B id has more."""
    counts = swept.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("times"))
    b_id = F.col("link").bitwiseAND(F.lit((1 << 32) - 1))
    counts = cut(counts.withColumn("b_id", b_id))
    most = counts.groupBy("b_id").agg(F.max("times").alias("most"))
    return counts.join(most, "b_id").select("link", "times", (F.col("times") == F.col("most")).cast("long").alias("best"))


def align_tokenizers(documents: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``documents``.

    Text is space and text by the byte-level vocabulary (A) and text by the piece model (B),
    special tokens' strings being plain text. Null and empty texts, and texts whose tokens'
    bytes are not those of space and text (a U+2581 in it, say), have no tokens: zeros and an
    empty ``groups_sha256``. Repeated rows and rows of one or a null id are each aligned, and
    their links all count. Other columns, whatever their names, are not read. An empty table
    gives no rows. Both files must exist on every executor.
    """
    spark = documents.sparkSession
    byte_path, piece_path = byte_path or vocabulary_path(BYTE_VOCABULARY), piece_path or vocabulary_path(PIECE_VOCABULARY)
    home = f"{checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    sweep(end_events(documents, byte_path, piece_path), token_lengths(byte_path, piece_path)).drop("groups").write.option("compression", "zstd").parquet(home)
    swept = spark.read.parquet(home)
    counts = cut(link_counts(swept))
    known = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    links = swept.select("uid", F.explode("links").alias("link")).join(known, "link").groupBy("uid").agg(F.sum("best").alias("n_best"), F.sum("times").alias("count_sum"))
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    whole = swept.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256")).join(links, "uid", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    out = cut(whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))
    delete_folder(spark, home)
    return out
