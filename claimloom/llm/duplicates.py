"""Operator 3: near duplicates by HyperMinHash registers, bands and exact verification.

A text's distinct shingles are hashed to 64 bits. The first bits choose a bucket; of each
bucket's smallest remainder a register keeps the number of leading zeros and the
``MANTISSA`` bits after the first one. Bands over the registers give candidates; registers
give a collision-corrected Jaccard estimate, and what may reach the threshold is verified on
the full sets. Only texts that meet another in some band are read a second time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.text import LOWER, U64, column_bytes, let_go, mix, shingle_set, slices, word_hashes
from claimloom.operators.components import connected_components
from claimloom.plans.lineage import cut, fresh_name, sweep

BUCKET_BITS = 8
MANTISSA = 10
#: 42 bands of 6 registers: a pair of similarity 0.8 escapes all with chance 3e-6, one of 0.9 with 2e-14.
BAND = 6
#: Standard errors by which an estimate must miss the threshold for a pair to be left unverified.
SIGMAS = 4.5
#: Ids up to this many are broadcast to fetch their texts; beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Members that meet one copy of a hub, and members in a block of the closing comparison.
HUB_ROWS = 256
BLOCK = 1024
#: Members of unlike labels from which a band's members are dealt by their rarest shingles instead.
COMMON = 16 * BLOCK
#: Shingles whose counts are known where rare ones are chosen; the choice loses nothing whatever they are.
ORDERED = 200_000
#: Rows of one key from which its part of a join is broadcast.
MANY = 1000
#: Registers that the closing comparison looks at first.
FIRST = 64


def registers(sorted_set: np.ndarray, bucket_bits: int = BUCKET_BITS, mantissa: int = MANTISSA) -> np.ndarray:
    """HyperMinHash registers of a sorted set of 64-bit hashes; 0 marks an empty bucket.

    A register is ``1 + (leading zeros << mantissa | inverted mantissa)`` of the bucket's
    smallest remainder, so equal registers mean equal leading bits.
    """
    m = 1 << bucket_bits
    edges = np.arange(m, dtype=U64) << U64(64 - bucket_bits)
    at = np.searchsorted(sorted_set, edges)
    stop = np.append(at[1:], len(sorted_set))
    full = at < stop
    rest = (sorted_set[np.minimum(at, len(sorted_set) - 1)] << U64(bucket_bits)) | U64((1 << bucket_bits) - 1)
    zeros = 53 - np.frexp((rest >> U64(11)).astype(np.float64))[1]
    after = (rest << (zeros + 1).astype(U64)) >> U64(64 - mantissa)
    value = 1 + ((zeros.astype(np.int64) << mantissa) | ((1 << mantissa) - 1 - after.astype(np.int64)))
    return np.where(full, value, 0).astype(np.uint16)


def band_keys(register: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each band; an empty bucket borrows the next full one's register and number."""
    m = len(register)
    full = np.flatnonzero(register)
    owner = full[np.searchsorted(full, np.arange(m)) % len(full)]
    value = mix((owner.astype(U64) << U64(16)) | register[owner].astype(U64))[: m // band * band].reshape(-1, band)
    key = np.arange(m // band, dtype=U64)
    for k in range(band):
        key = mix(key * U64(0x9E3779B97F4A7C15) + value[:, k])
    return np.unique(key).view(np.int64)


def chance_matches(n, sizes, buckets: int, mantissa: int = MANTISSA):
    """Registers of two unrelated sets that are expected to agree, by HyperMinHash's approximation."""
    return 0.169919487159739 * buckets * 2.0**-mantissa * 4 * (n / buckets) * (sizes / buckets) / (n / buckets + sizes / buckets) ** 2


def estimate(mine: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray, mantissa: int = MANTISSA) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of one register row against others, less the expected chance collisions, and their standard error at 0.8."""
    buckets = len(mine)
    used = np.maximum((others > 0) | (mine > 0), False).sum(1)
    same = ((others == mine) & (mine > 0)).sum(1)
    guess = np.clip((same - chance_matches(n, sizes, buckets, mantissa)) / np.maximum(used, 1), 0, 1)
    return guess, np.sqrt(0.16 / np.maximum(used, 1))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _sets(text_column, shingle: int):
    data, offsets = column_bytes(text_column)
    hashes, firsts = word_hashes(LOWER[data], offsets)
    for k in range(len(offsets) - 1):
        yield shingle_set(hashes[firsts[k] : firsts[k + 1]], shingle)


def sketch(documents: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, print, register`` of each row; ``print`` identifies the whole set and is null for empty ones."""
    shape = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print", pa.binary()), ("register", pa.binary())])

    def run(batches):
        let_go()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sizes, prints, kept = [], [], []
            for full in _sets(batch.column(1), shingle):
                sizes.append(len(full))
                prints.append(hashlib.blake2b(full.tobytes(), digest_size=16).digest() if len(full) else None)
                kept.append(registers(full).tobytes() if len(full) else None)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=shape)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, print binary, register binary"
    )


def band_rows(rows: DataFrame) -> DataFrame:
    """``band, doc_id`` for each band of each ``doc_id, register`` row."""

    def run(batches):
        for batch in batches:
            keys = [band_keys(np.frombuffer(r, np.uint16)) for r in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys]) if keys else []
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(ids, pa.int64())], names=["band", "doc_id"])

    return rows.select("doc_id", "register").mapInArrow(run, "band long, doc_id long")


def full_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, hashes``: the whole sorted set of each row."""
    shape = pa.schema([("doc_id", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        let_go()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets = [s.tobytes() for s in _sets(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], schema=shape)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, hashes binary")


def _may_link(hub: tuple, sizes: np.ndarray, registers_: np.ndarray, percent: int) -> np.ndarray:
    """Which rows may reach the threshold with the hub ``(id, size, registers)`` by their estimates."""
    guess, error = estimate(hub[2], registers_, hub[1], sizes)
    return (guess >= percent / 100 - SIGMAS * error) & (100 * np.minimum(sizes, hub[1]) >= percent * np.maximum(sizes, hub[1]))


def promising(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(hub, salt, doc)`` those whose corrected estimates do not rule them out; each salt gets a copy of its hub."""
    one = sketches.select(F.col("doc_id").alias("hub"), F.col("n_shingles").alias("n1"), F.col("register").alias("r1"))
    one = pairs.select("hub", "salt").distinct().join(one, "hub")
    two = sketches.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n2"), F.col("register").alias("r2"))

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n1, n2 = (batch.column(i).to_numpy().astype(float) for i in (3, 5))
            r1, r2 = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (4, 6))
            used, same = ((r1 > 0) | (r2 > 0)).sum(1), ((r1 == r2) & (r1 > 0)).sum(1)
            guess = (same - chance_matches(n1, n2, r1.shape[1])) / np.maximum(used, 1)
            ok = (guess >= percent / 100 - SIGMAS * np.sqrt(0.16 / np.maximum(used, 1))) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1, 2)], names=["hub", "salt", "doc"])

    return pairs.join(two, "doc").join(one, ["hub", "salt"]).select("hub", "salt", "doc", "n1", "r1", "n2", "r2").mapInArrow(run, "hub long, salt long, doc long")


def _join_keys(rows: DataFrame, info: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``info``, a row for each key with its number of rows ``n``, which stays out.

    Keys of over ``MANY`` rows are broadcast while they are few, so that none of them pulls
    its rows into one task; beyond that AQE has to split the shuffle join.
    """
    common = cut(info.where(F.col("n") > MANY).drop("n"))
    if not 0 < common.count() <= BROADCAST_IDS:
        return rows.join(info.drop("n"), key)
    rest = rows.join(F.broadcast(common.select(key)), key, "left_anti").join(info.where(F.col("n") <= MANY).drop("n"), key)
    return rows.join(F.broadcast(common), key).unionByName(rest)


def dealt(pairs: DataFrame) -> DataFrame:
    """``hub, salt, doc``: a hub's pairs dealt over as many salts as ``HUB_ROWS`` rows each need."""
    counts = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("doc"), "salts").alias("salt")
    return _join_keys(pairs, counts.withColumn("salts", F.ceil(F.col("n") / HUB_ROWS)), "hub").select("hub", salt, "doc")


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents in ``ids(doc_id)``; few ids are sent to the texts, many meet them in a shuffle."""
    ids = cut(ids.select("doc_id").distinct())
    few = ids.count() <= BROADCAST_IDS
    return documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(hub, salt, doc)`` those whose full sets verify, as ``src, dst``.

    Each hub and salt gets one copy of the hub's set, read first, and members stream past it.
    """
    members = pairs.join(sets.withColumnRenamed("doc_id", "doc"), "doc").select("hub", "salt", F.lit(1).alias("role"), "doc", "hashes")
    hubs = pairs.select("hub", "salt").distinct().join(sets.withColumnRenamed("doc_id", "hub"), "hub").select("hub", "salt", F.lit(0).alias("role"), F.col("hub").alias("doc"), "hashes")

    def run(batches):
        hub, key = [], None
        for batch in batches:
            found = []
            for h, salt, role, doc, hashes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                full = np.frombuffer(hashes, U64)
                if role == 0:
                    hub, key = [*hub, full] if key == (h, salt) else [full], (h, salt)
                elif key == (h, salt) and any(_similar(x, full, percent) for x in hub):
                    found.append((h, doc))
            src, dst = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return hubs.union(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role").mapInArrow(run, "src long, dst long")


def _runs(batches):
    """Columns of each run of rows with one (band, left, right), numbers as arrays, the others as lists.

    Rows come sorted by the key; a run may span batches, and holds two blocks at most.
    """
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {f.name: c.to_numpy(zero_copy_only=False) if pa.types.is_integer(f.type) else c.to_pylist() for f, c in zip(batch.schema, batch.columns, strict=True)}
        keys = np.stack([columns[k] for k in ("band", "left", "right")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for at, stop in zip(cuts, cuts[1:], strict=False):
            part = {k: v[at:stop] for k, v in columns.items()}
            if held and any(held[0][k][0] != part[k][0] for k in ("band", "left", "right")):
                yield _joined(held)
                held = []
            held.append(part)
    if held:
        yield _joined(held)


def _joined(parts: list[dict]) -> dict:
    if len(parts) == 1:
        return parts[0]
    return {k: np.concatenate([p[k] for p in parts]) if isinstance(v, np.ndarray) else [x for p in parts for x in p[k]] for k, v in parts[0].items()}


def _two_blocks(run: dict) -> list[np.ndarray]:
    """Row numbers of the run's left and right block, each id's texts once."""
    out, texts = [], run.get("register") or run["hashes"]
    for b in (run["left"][0], run["right"][0]):
        own = np.flatnonzero(run["block"] == b)
        if len(np.unique(run["doc_id"][own])) < len(own):
            own = np.array(list({(run["doc_id"][k], texts[k]): k for k in own.tolist()}.values()))
        out.append(own)
    return out


def _by_blocks(rows: DataFrame, function, names: str) -> DataFrame:
    """``function(run)``'s columns for every pair of blocks; runs stream past, two blocks at a time."""
    shape = pa.schema([(n, pa.int64()) for n in names.split()])

    def work(batches):
        kept, size = [], 0
        for run in _runs(batches):
            found = function(run)
            if len(found[0]):
                kept.append(found)
                size += len(found[0])
            if size > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*kept, strict=True)], schema=shape)
                kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*kept, strict=True)], schema=shape)

    key = ("band", "left", "right")
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(work, ", ".join(f"`{n}` long" for n in names.split()))


def _equal_bytes(row: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In how many of ``FIRST`` bytes each of ``rows`` agrees with ``row``, eight at a time."""
    lanes = (rows == row).view(U64).sum(1, dtype=U64)
    return ((lanes * U64(0x0101010101010101)) >> U64(56)).astype(np.int64)


_PLACE = ("band", "doc_id", "label", "block", "left", "right")


def _flag(percent: int):
    """Rows of a pair of blocks whose texts may link with one of another label; never more than it was given.

    A byte of each of ``FIRST`` registers rules most pairs out, leniently; the whole registers
    decide about the others.
    """
    least = percent / 100
    floor = FIRST * (least - SIGMAS * np.sqrt(least * (1 - least) / FIRST))

    def work(run):
        one, two = _two_blocks(run)
        if not len(one) or not len(two):
            return [np.zeros(0, np.int64)] * len(_PLACE)
        full = np.frombuffer(b"".join(run["register"]), np.uint16).reshape(len(run["doc_id"]), -1)
        small = (np.ascontiguousarray(full[:, :: full.shape[1] // FIRST]) * np.uint16(40503) >> np.uint16(8)).astype(np.uint8)
        sizes, labels, filled = run["n_shingles"].astype(float), run["label"], (full > 0).mean(1)
        found = np.zeros(len(labels), bool)
        for k in one.tolist():
            ok = (labels[two] != labels[k]) & (100 * np.minimum(sizes[two], sizes[k]) >= percent * np.maximum(sizes[two], sizes[k]))
            at = two[ok]
            if not len(at):
                continue
            # few full buckets say little, so only well filled pairs are judged by their first registers
            same = _equal_bytes(small[k], small[at])
            at = at[(np.minimum(filled[at], filled[k]) <= 0.99) | (same >= floor)]
            at = at[_may_link((None, sizes[k], full[k]), sizes[at], full[at], percent)] if len(at) else at
            if len(at):
                found[k] = found[at] = True
        return [run[c][found] for c in _PLACE]

    return work


def _across(percent: int):
    """Verified links between texts of unlike labels in a pair of blocks; a spanning forest of them is enough.

    Shared shingles of a text with all of the other block are counted through the block's
    postings, so every intersection is exact.
    """

    def work(run):
        one, two = _two_blocks(run)
        out, root = [], {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        if len(one) and len(two):
            sets = [np.frombuffer(run["hashes"][k], U64) for k in two.tolist()]
            sizes, labels, ids = np.array([len(x) for x in sets]), run["label"], run["doc_id"]
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            for k in one.tolist():
                own = np.frombuffer(run["hashes"][k], U64)
                begin, stop = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
                counts = stop - begin
                at = np.arange(counts.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
                shared = np.bincount(owner[at], minlength=len(sets))
                for j in np.flatnonzero((labels[two] != labels[k]) & (100 * shared >= percent * (len(own) + sizes - shared))).tolist():
                    a, b = find(int(labels[k])), find(int(labels[two[j]]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((int(ids[k]), int(ids[two[j]])))
        return [np.array(c, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2

    return work


def _unlike(members: DataFrame) -> DataFrame:
    """``band, main, n_main, n_rest``: each band's commonest label, and the members with it and without."""
    tally = members.groupBy("band", "label").agg(F.count("*").alias("n"))
    top = tally.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    return top.select("band", F.col("top.label").alias("main"), F.col("top.n").alias("n_main"), (F.col("all") - F.col("top.n")).alias("n_rest"))


def _of_several(members: DataFrame, least: int) -> DataFrame:
    """Of ``band, doc_id, label`` the bands with ``least`` or more members of unlike labels; of bands with equal members one is enough."""
    mixed = members.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("mark"))
    mixed = mixed.where(f"a <> b and n >= {least}").groupBy("n", "mark").agg(F.min("band").alias("band"))
    return members.join(mixed.select("band"), "band", "left_semi").select("band", "doc_id", "label")


def _token_counts(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``ORDERED`` commonest shingles of ``sets``, sorted, and in how many of them each is.

    They only order a text's shingles: a shingle that is not among them counts as rare.
    """

    def run(batches):
        for batch in batches:
            tokens = [np.frombuffer(h, np.int64) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else [], pa.int64())], names=["token"])

    counts = sets.select("hashes").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    rows = counts.orderBy(F.desc("n"), "token").limit(ORDERED).collect()
    tokens, n = np.array([r.token for r in rows], np.int64).view(U64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _prefix(full: np.ndarray, tokens: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, of which two sets that reach the threshold share one.

    If ``s`` is the first shingle that two linked sets share, in one order of all shingles,
    at least ``percent`` of each set's shingles come no earlier, so ``s`` is among each set's
    first ``n - ceil(n * percent / 100) + 1``.
    """
    at = np.minimum(np.searchsorted(tokens, full), max(0, len(tokens) - 1))
    weight = np.where(tokens[at] == full, counts[at], 0) if len(tokens) else np.zeros(len(full), np.int64)
    return full[np.lexsort((full, weight))[: len(full) + 1 - -(-len(full) * percent // 100)]]


def _finer(members: DataFrame, documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``members`` with bands of over ``COMMON`` unlike members cut by rare shingles, which loses no link.

    All members of such bands are dealt anew by the rarest shingles of their full sets, see
    ``_prefix``; blocks take what is still common then, whatever its size.
    """
    common = cut(_unlike(members).where(F.col("n_rest") > COMMON).select("band"))
    if common.isEmpty():
        return members
    many = F.broadcast(common) if common.count() <= BROADCAST_IDS else common
    labels = cut(members.join(many, "band", "left_semi").select("doc_id", "label").distinct())
    sets = full_sets(texts_of(documents, labels), shingle)
    tokens, counts = _token_counts(sets)

    def run(batches):
        for batch in batches:
            found = [_prefix(np.frombuffer(h, U64), tokens, counts, percent).view(np.int64) if h else np.zeros(0, np.int64) for h in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found]) if found else []
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64()), pa.array(ids, pa.int64())], names=["band", "doc_id"])

    again = sets.mapInArrow(run, "band long, doc_id long").distinct().join(labels, "doc_id").select("band", "doc_id", "label")
    return cut(members.join(many, "band", "left_anti").union(_of_several(again, 2)))


def closing_links(bands: DataFrame, labels: DataFrame, sketches: DataFrame, documents: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """Links that no star found: all pairs of unlike components that share a band, or None if none can be.

    Bands whose members are all in one component are done, and so are bands of two, whose only
    pair was the star. In the others the commonest
    label's members need no comparison among themselves; the rest meet everyone in blocks of
    ``BLOCK``, first by registers, then those that may link by their full sets. Very common
    bands are dealt finer first, by shingles of which linked texts must share one. Nothing is
    dropped and no task gets an unbounded group.
    """
    labelled = bands.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    members = cut(_of_several(labelled, 3))
    members = _finer(members, documents, shingle, percent)
    rows = _join_keys(members, _unlike(members).withColumn("n", F.col("n_main") + F.col("n_rest")), "band")
    rows = rows.withColumns({"is_main": F.col("label") == F.col("main"), "k_main": F.ceil(F.col("n_main") / BLOCK), "k_rest": F.ceil(F.col("n_rest") / BLOCK)})
    rows = rows.withColumn("block", F.when(F.col("is_main"), F.pmod(F.xxhash64("doc_id"), "k_main")).otherwise(F.col("k_main") + F.pmod(F.xxhash64("doc_id"), F.col("k_rest"))))
    rest = F.sequence(F.col("k_main"), F.col("k_main") + F.col("k_rest") - 1)
    everyone = F.sequence(F.lit(0).cast("long"), F.col("k_main") + F.col("k_rest") - 1)
    rows = rows.withColumn("mate", F.explode(F.when(F.col("is_main"), rest).otherwise(everyone)))
    rows = rows.select("band", "doc_id", "label", "block", F.least("block", "mate").alias("left"), F.greatest("block", "mate").alias("right"))
    known = sketches.select("doc_id", "n_shingles", "register")
    flagged = cut(_by_blocks(rows.join(known, "doc_id"), _flag(percent), " ".join(_PLACE)))
    if flagged.isEmpty():
        return None
    sets = full_sets(texts_of(documents, flagged), shingle)
    return _by_blocks(flagged.join(sets, "doc_id"), _across(percent), "src dst")


def _of_one_id(rows: DataFrame, twice: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst`` links between the nodes of all texts of each repeated id."""
    few = twice.count() <= BROADCAST_IDS
    texts = rows.select("doc_id", "print").join(F.broadcast(twice) if few else twice, "doc_id", "left_semi").distinct().join(nodes, "print")
    least = texts.groupBy("doc_id").agg(F.min("node").alias("dst"), F.max("node").alias("most")).where("dst <> most")
    return texts.join(least, "doc_id").where("node <> dst").select(F.col("node").alias("src"), "dst").distinct()


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of ``documents``: ``doc_id, n_shingles, component_id, kept``.

    Documents whose sets of ``shingle``-word shingles (A-Z lower-cased) have a Jaccard
    similarity of ``percent`` / 100 or more are linked; ``component_id`` is the smallest
    doc_id reachable and ``kept`` marks the document that has it. Shorter texts are one
    shingle; texts without words are linked with nothing. Equal sets are one node from the
    start, so copies never multiply. Rows that repeat a doc_id are one document, whose texts
    are all linked; a null doc_id has a null component and is kept. An empty table gives no
    rows.
    """
    rows = cut(sketch(documents, shingle))
    nodes = cut(rows.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node")))
    single = rows.where("print is not null").join(nodes.select("print", F.col("node").alias("doc_id")), ["print", "doc_id"], "left_semi")
    twice = cut(rows.where("print is not null and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    repeated = not twice.isEmpty()
    if repeated:  # each text of an id once, however often its row is repeated
        single = cut(single.dropDuplicates(["print", "doc_id"]))
    sketches = single if repeated else rows
    bands = band_rows(single)  # keys are cheap to make again and take more room than the registers
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("hub <> last").drop("last")
    bands = cut(_join_keys(bands, cut(shared), "band"))
    stars = cut(bands.where("hub <> doc_id").select("hub", F.col("doc_id").alias("doc")).distinct())
    likely = cut(promising(dealt(stars), sketches, percent))
    ids = likely.select(F.col("hub").alias("doc_id")).union(likely.select("doc"))
    sets = full_sets(texts_of(documents, ids), shingle)
    sets = cut(sets.dropDuplicates(["doc_id", "hashes"]) if repeated else sets)
    links = verify(likely, sets, percent)
    links = cut(links.union(_of_one_id(rows, twice, nodes)) if repeated else links)
    del shared, stars, likely, ids, sets  # their copies go with them
    sweep(documents.sparkSession)
    labels = cut(connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("label")))
    more = closing_links(bands.select("band", "doc_id"), labels, sketches, documents, shingle, percent)
    joined = labels.select(F.col("doc_id").alias("node"), F.col("label").alias("component"))
    more = cut(more) if more is not None else None
    if more is not None and not more.isEmpty():
        joined = connected_components(labels.select(F.col("doc_id").alias("src"), F.col("label").alias("dst")).union(more))
    classes = nodes.join(joined, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    found = rows.select("doc_id", "n_shingles", "print").join(classes, "print", "left")
    found = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents' own columns for one row of each component of near duplicates.

    The row whose doc_id names the component stays, and one of rows that repeat it; rows
    without a doc_id all stay, texts without words too. Only ids of what goes meet the texts.
    An empty table gives no rows.
    """
    found = near_duplicates(documents, shingle, percent)
    own = fresh_name(documents.columns, "_gone")
    gone = cut(found.where(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct())
    twice = cut(documents.where("doc_id is not null").select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    few = gone.count() <= BROADCAST_IDS
    stay = documents.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(own), "left_anti")
    if twice.isEmpty():
        return stay
    single = stay.join(twice, "doc_id", "left_anti").select(*documents.columns)
    return single.unionByName(stay.join(twice, "doc_id", "left_semi").select(*documents.columns).dropDuplicates(["doc_id"]))
