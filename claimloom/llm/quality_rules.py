"""Operator 1: quality rules by the hashed n-gram log-likelihood ratio of trusted target and raw corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.text import U64, column_bytes, grams, mix, slices, word_hashes, words

#: Buckets of both multinomials; the tables that reach the driver and the tasks have this many rows.
BUCKETS = 1 << 16
#: Bytes in an n-gram.
GRAM = 4
#: Mean log-likelihood ratio per n-gram below which a document goes.
THRESHOLD = -0.2
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Trusted ids up to this many are broadcast; beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def gram_buckets(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte n-gram that lies within one document, and each document's first n-gram's index."""
    if len(data) < gram:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = np.zeros(len(data) - gram + 1, U64)
    for k in range(gram):
        code = (code << U64(8)) | data[k : len(data) - gram + 1 + k]
    bucket = (mix(code) & U64(buckets - 1)).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - gram + 1, 0)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(firsts[-1]) + np.repeat(offsets[:-1] - firsts[:-1], counts)
    return bucket[at], firsts


def bucket_counts(texts: DataFrame, gram: int = GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Counts over all rows' n-grams, added up in the tasks before they meet."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            total += np.bincount(gram_buckets(*column_bytes(batch.column(0)), gram, buckets)[0], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.bucket] = row.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """ln(target share / raw share) of each bucket, both smoothed by one n-gram a bucket of the raw shape."""
    base = (raw + 1) / (raw + 1).sum()
    return np.log((target + len(raw) * base) / (target.sum() + len(raw)) / base).astype(np.float32)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each document."""
    starts, lengths, firsts = words(data, offsets)
    inside = np.zeros(len(data) + 1, np.int64)
    lead = (data & 0xC0) != 0x80
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    np.cumsum(lead & ~space, out=inside[1:])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    hashes, _ = word_hashes(data, offsets)
    dup, repeat = [], []
    for k in range(len(offsets) - 1):
        lines = [x for x in data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
        dup.append(len(lines) - len(set(lines)))
        own = hashes[firsts[k] : firsts[k + 1]]
        covered = np.zeros(len(own), bool)
        if len(own) > 3:
            _, back, times = np.unique(grams(own, 3), return_inverse=True, return_counts=True)
            again = times[back] > 1
            for shift in range(3):
                covered[shift : shift + len(again)] |= again
        repeat.append(int(covered.sum()))
    return {
        "n_words": np.diff(firsts),
        "word_chars": inside[offsets[1:]] - inside[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": np.array(repeat, np.int64),
    }


def trusted_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the documents that ``labels.quality`` marks 1."""
    ids = labels.where("quality = 1").select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return documents.join(ids, "doc_id", "left_semi").select("text")


def quality_rules(documents: DataFrame, target: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, buckets: int = BUCKETS) -> DataFrame:
    """Base counts, the ratio and the verdict for each row of ``documents``.

    ``target`` has the trusted ``text``; the raw multinomial is ``documents`` itself, every
    row of it. The ratio is the mean over a document's n-grams, so length does not matter;
    a text without n-grams (null, empty, very short) has ratio 0 and fails by its words.
    With an empty target the ratio is 0 everywhere. Returns ``doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio``; repeated rows and
    null ids keep a row each.
    """
    table = log_ratio(bucket_counts(target, gram, buckets), bucket_counts(documents, gram, buckets))
    shape = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64())])

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            data, offsets = column_bytes(batch.column(1))
            counts = base_counts(data, offsets)
            bucket, firsts = gram_buckets(data, offsets, gram, buckets)
            summed = np.concatenate([[0.0], np.cumsum(table[bucket], dtype=np.float64)])
            ratio = (summed[firsts[1:]] - summed[firsts[:-1]]) / np.maximum(np.diff(firsts), 1)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])
            columns = [batch.column(0), *counts.values(), failed, ~failed & (ratio >= threshold), np.round(ratio, 9)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    sql = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, sql)
