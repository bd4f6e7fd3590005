"""Operator 6: toxicity by a bidirectional GRU with attention pooling over character and word inputs."""

from __future__ import annotations

import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.text import let_go, mix, slices, warm

#: Labelled documents that the fit may see; the smallest hashes of their ids are taken.
SAMPLE = 6_000
WINDOW, STRIDE = 64, 48
HIDDEN = 8
WORD_ROWS, GRAM_ROWS, WORD_DIM, GRAM_DIM = 1 << 15, 1 << 16, 4, 8
INPUT = WORD_DIM + 2 * GRAM_DIM
#: Bytes of a character gram, and of the anchored beginnings beside them.
GRAM, BEGINNINGS = 4, (6, 8)
#: A fit takes ``EPOCHS`` rounds, and more on few documents until it has made ``LEAST_STEPS``.
EPOCHS, LEAST_STEPS, BATCH, RATE, TABLE_RATE = 5, 160, 64, 0.01, 0.02
#: Share of words whose own row is hidden in a training step, so that characters must do.
HIDE = 0.5
#: Distinct words whose projections a worker remembers.
REMEMBERED = 200_000
EDGES = ".,;:!?\"'()[]{}|*#$%&<>"


def normal(word: str) -> str:
    return word.strip(EDGES).lower()


def indices(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's row, all words' gram rows end to end and each word's first one.

    Grams are the runs of ``GRAM`` bytes of ``^word$`` and its beginnings; a shorter word is
    one gram. All words are hashed side by side.
    """
    if not vocabulary:
        return (np.zeros(0, np.int64),) * 3
    parts = [b"^%b$" % w.encode("utf-8", "surrogatepass") for w in vocabulary]
    sizes = np.array([len(x) for x in parts])
    data = np.frombuffer(b"".join(parts) + bytes(max(BEGINNINGS)), np.uint8).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes

    def hashed(at: np.ndarray, length: int, seed: int) -> np.ndarray:
        value = np.full(len(at), seed, np.uint64)
        for k in range(length):
            value = value * np.uint64(0x100000001B3) + data[at + k]
        return mix(value)

    counts = np.maximum(sizes - GRAM + 1, 1)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    short = np.repeat(sizes < GRAM, counts)
    rows = hashed(np.repeat(begins, counts) + place, GRAM, 1)
    if short.any():
        rows[short] = hashed(begins[sizes < GRAM], GRAM - 1, 2)
    owner = np.repeat(np.arange(len(parts)), counts)
    for length in BEGINNINGS:
        long = np.flatnonzero(sizes > length)
        rows, owner = np.concatenate([rows, hashed(begins[long], length, length)]), np.concatenate([owner, long])
    order = np.argsort(owner, kind="stable")
    letters = np.arange(sizes.sum()) - np.repeat(begins, sizes)
    whole = np.add.reduceat((data[: sizes.sum()] + np.uint64(1)) * mix(letters.astype(np.uint64) + np.uint64(77)), begins)
    return (mix(whole) % np.uint64(WORD_ROWS)).astype(np.int64), (rows[order] % np.uint64(GRAM_ROWS)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(parts)))


class Toxicity:
    """Tables of word and character-gram embeddings, two GRUs, attention and a logistic output."""

    def __init__(self, seed: int = 6):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"ew": (0.1 * rng.normal(size=(WORD_ROWS, WORD_DIM))).astype(np.float32), "eg": (0.1 * rng.normal(size=(GRAM_ROWS, GRAM_DIM))).astype(np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(INPUT, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": f(2 * HIDDEN), "o": f(2 * HIDDEN), "c": np.array([-2.0], np.float32)}

    # inputs -----------------------------------------------------------------
    def inputs(self, index, hidden: np.ndarray | None = None) -> np.ndarray:
        """One row for each word: its own embedding (0 where ``hidden``), and the mean and maximum of its grams'."""
        words, flat, starts = index
        if not len(words):
            return np.zeros((0, INPUT), np.float32)
        counts, grams = np.diff(np.append(starts, len(flat)))[:, None], self.p["eg"][flat]
        own = self.p["ew"][words]
        if hidden is not None:
            own = own * ~hidden[:, None]
        return np.concatenate([own, np.add.reduceat(grams, starts) / counts, np.maximum.reduceat(grams, starts)], 1).astype(np.float32)

    # recurrence -------------------------------------------------------------
    def run(self, projected: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction over ``projected[t, n, 3H]``; padding passes the state on."""
        steps, n, _ = projected.shape
        h, u = np.zeros((n, HIDDEN), np.float32), self.p[f"U{d}"]
        states, saved = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, hu = projected[t], h @ u
            zr = 0.5 * np.tanh(0.5 * (x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])) + 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep:
                saved.append((t, h, zr, new, hu[:, 2 * HIDDEN :]))
            h = h + mask[t][:, None] * (1 - z) * (new - h)
            states[t] = h
        return states, saved

    def pool(self, states: np.ndarray, mask: np.ndarray):
        """Logits of windows and what the gradient needs of their attention."""
        e = np.where(mask > 0, states @ self.p["a"], -1e9)
        w = np.exp(e - e.max(0))
        w = w * (mask > 0)
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = (w[:, :, None] * states).sum(0)
        return pooled @ self.p["o"] + self.p["c"][0], w, pooled

    def logits(self, projections: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """``projections[word, 6H]`` already hold both directions' inputs; ``ids[t, n]`` choose rows."""
        part = projections[ids]
        forward, _ = self.run(part[:, :, : 3 * HIDDEN], mask, "f", False)
        backward, _ = self.run(part[:, :, 3 * HIDDEN :], mask, "b", False)
        return self.pool(np.concatenate([forward, backward], 2), mask)[0]

    def project(self, inputs: np.ndarray) -> np.ndarray:
        return np.concatenate([inputs @ self.p["Wf"] + self.p["bf"], inputs @ self.p["Wb"] + self.p["bb"]], 1).astype(np.float32)

    # training ---------------------------------------------------------------
    def gradients(self, index, ids, mask, owner, labels, hidden=None):
        """Of the mean loss of documents, each judged by its highest window."""
        x = self.inputs(index, hidden)
        states, saved = {}, {}
        for d in "fb":
            states[d], saved[d] = self.run((x @ self.p[f"W{d}"] + self.p[f"b{d}"])[ids], mask, d, True)
        both = np.concatenate([states["f"], states["b"]], 2)
        logit, w, pooled = self.pool(both, mask)
        order = np.lexsort((-logit, owner))
        top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        p = 1 / (1 + np.exp(-logit[top]))
        y = labels[owner[top]]
        dl = np.zeros(len(logit), np.float32)
        dl[top] = (p - y) / len(top)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("ew", "eg")}
        g["o"], g["c"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * self.p["o"]
        dw = (dpool[None] * both).sum(2)
        de = w * (dw - (w * dw).sum(0))
        g["a"] = np.einsum("tn,tnh->h", de, both)
        dboth = w[:, :, None] * dpool[None] + de[:, :, None] * self.p["a"]
        dx = np.zeros_like(x)
        for d, part in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[:, :, HIDDEN:])):
            u, dh = self.p[f"U{d}"], np.zeros((ids.shape[1], HIDDEN), np.float32)
            flat = np.empty((*ids.shape, 3 * HIDDEN), np.float32)
            for t, h, zr, new, hn in reversed(saved[d]):
                dh = dh + part[t]
                m, z, r = mask[t][:, None], zr[:, :HIDDEN], zr[:, HIDDEN:]
                dn = dh * m * (1 - z) * (1 - new * new)
                dz = -dh * m * (new - h) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                flat[t] = np.concatenate([dz, dr, dn], 1)
                through = np.concatenate([dz, dr, dn * r], 1)
                g[f"U{d}"] += h.T @ through
                dh = dh * (1 - m * (1 - z)) + through @ u.T
            rows = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(rows, ids.ravel(), flat.reshape(-1, 3 * HIDDEN))
            g[f"W{d}"], g[f"b{d}"] = x.T @ rows, rows.sum(0)
            dx += rows @ self.p[f"W{d}"].T
        words, flat, starts = index
        counts = np.diff(np.append(starts, len(flat)))
        mean, most = dx[:, WORD_DIM : WORD_DIM + GRAM_DIM] / counts[:, None], dx[:, WORD_DIM + GRAM_DIM :]
        highest = self.p["eg"][flat] == np.repeat(x[:, WORD_DIM + GRAM_DIM :], counts, 0)
        own = dx[:, :WORD_DIM] if hidden is None else dx[:, :WORD_DIM] * ~hidden[:, None]
        tables = {"ew": (words, own), "eg": (flat, np.repeat(mean, counts, 0) + highest * np.repeat(most, counts, 0))}
        return g, tables, float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean())

    def fit(self, documents: list[np.ndarray], vocabulary: list[str], labels: np.ndarray, seed: int = 5) -> None:
        """Learn from documents, given as places in the vocabulary.

        A document is judged by its highest window, so a step looks at all windows of its
        documents, whatever their number, and takes the gradient through the highest ones.
        """
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        batches = max(1, len(documents) // BATCH)
        words, flat, starts = indices(vocabulary)
        stops = np.append(starts[1:], len(flat))

        def part_of(parts):
            """The index of the parts' own words, and the parts as places in it."""
            used, back = np.unique(np.concatenate([np.zeros(1, np.int32), *parts]), return_inverse=True)
            counts = stops[used] - starts[used]
            begin = np.cumsum(counts) - counts
            index = (words[used], flat[np.repeat(starts[used] - begin, counts) + np.arange(counts.sum())], begin)
            return index, np.split(back[1:], np.cumsum([len(x) for x in parts])[:-1])

        for _ in range(max(EPOCHS, -(-LEAST_STEPS // batches))):
            for rows in np.array_split(rng.permutation(len(documents)), batches):
                index, own = part_of([documents[r] for r in rows])
                parts = self.highest(self.project(self.inputs(index)), own)
                index, own = part_of([documents[r][a:b] for r, (a, b) in zip(rows, parts, strict=True)])
                ids, mask = padded(own)
                g, tables, _ = self.gradients(index, ids, mask, np.arange(len(rows)), labels[rows], rng.random(len(index[0])) < HIDE)
                step += 1
                for k, grad in g.items():
                    first[k] += 0.1 * (grad - first[k])
                    second[k] += 0.01 * (grad * grad - second[k])
                    self.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                for k, (at, grad) in tables.items():
                    touched, back = np.unique(at, return_inverse=True)
                    total = np.zeros((len(touched), grad.shape[1]), np.float32)
                    np.add.at(total, back, grad)
                    second[k][touched] += total * total
                    self.p[k][touched] -= TABLE_RATE * total / (np.sqrt(second[k][touched]) + 1e-6)

    def highest(self, projections: np.ndarray, documents: list[np.ndarray]) -> list[tuple[int, int]]:
        """Begin and end of each document's window with the highest logit."""
        jobs = [(k, a, b) for k, d in enumerate(documents) for a, b in spans(len(d))]
        best: dict[int, tuple] = {}
        for at in range(0, len(jobs), 1024):
            part = jobs[at : at + 1024]
            ids, mask = padded([documents[k][a:b] for k, a, b in part])
            for (k, a, b), value in zip(part, self.logits(projections, ids, mask).tolist(), strict=True):
                if k not in best or value > best[k][0]:
                    best[k] = (value, a, b)
        return [best[k][1:] for k in range(len(documents))]


def spans(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover all of ``n`` words; no words give one empty window."""
    return [(a, min(a + WINDOW, n)) for a in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


def padded(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(1, max(map(len, parts), default=1))
    ids, mask = np.zeros((longest, len(parts)), np.int64), np.zeros((longest, len(parts)), np.float32)
    for k, part in enumerate(parts):
        ids[: len(part), k] = part
        mask[: len(part), k] = 1
    return ids, mask


def train(rows) -> Toxicity:
    """A network that learns from all ``(text, label)`` rows; texts are kept as word numbers only."""
    place, documents, labels = {"": 0}, [], []
    for text, label in rows:
        documents.append(np.array([place.setdefault(normal(w), len(place)) for w in text.split()], np.int32))
        labels.append(label)
    net = Toxicity()
    if len(set(labels)) < 2:
        net.p["o"][:] = 0
        net.p["c"][:] = 4.0 if labels and labels[0] else -4.0
        return net
    net.fit(documents, list(place), np.array(labels, np.float32))
    return net


class Scorer:
    """Scores texts; remembers the projections of distinct words up to a fixed number."""

    def __init__(self, net: Toxicity):
        self.net, self.place = net, {}
        self.rows = np.zeros((0, 6 * HIDDEN), np.float32)
        self.used = 0

    def look_up(self, words: list[str]) -> np.ndarray:
        """The row of each word's projections; the words met first, the common ones, stay when there are too many."""
        fresh = set(words).difference(self.place)
        if self.used + len(fresh) > REMEMBERED and self.used:
            self.used = min(self.used, REMEMBERED // 2)
            self.place = dict(itertools.islice(self.place.items(), self.used))
            fresh = set(words).difference(self.place)
        if fresh:
            fresh = list(fresh)
            new = self.net.project(self.net.inputs(indices([normal(w) for w in fresh])))
            if self.used + len(new) > len(self.rows):
                grown = np.empty((max(self.used + len(new), 2 * len(self.rows), 1024), 6 * HIDDEN), np.float32)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : self.used + len(new)] = new
            self.place.update(zip(fresh, range(self.used, self.used + len(fresh)), strict=True))
            self.used += len(fresh)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A score for each text: its highest window's; ``spans`` of all texts are laid out side by side."""
        own = [t.split() for t in texts]
        sizes = np.array([len(t) for t in own], np.int64)
        flat = self.look_up([*itertools.chain.from_iterable(own), ""])
        counts = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
        owner = np.repeat(np.arange(len(texts)), counts)
        start = STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
        length = np.minimum(WINDOW, sizes[owner] - start)
        start += np.repeat(np.cumsum(sizes) - sizes, counts)
        order, out = np.argsort(-length, kind="stable"), np.full(len(texts), -np.inf)
        for at in range(0, len(order), 1024):
            rows = order[at : at + 1024]
            steps = np.arange(max(1, length[rows[0]]))[:, None]
            mask = steps < length[rows]
            ids = flat[np.where(mask, start[rows] + steps, len(flat) - 1)]
            np.maximum.at(out, owner[rows], self.net.logits(self.rows, ids, mask.astype(np.float32)))
        return 1 / (1 + np.exp(-out))


def scorer(blob: bytes) -> Scorer:
    return warm(("scorer", blob), lambda: Scorer(pickle.loads(blob)))


def train_from_labels(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """Train on at most ``sample`` labelled documents, those whose ids hash lowest; ids with two labels are left out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("_y2"))
    known = known.where("y = _y2").select(F.col("doc_id").alias("_id"), "y")
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    own = documents.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    rows = own.groupBy("_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).orderBy(F.xxhash64("_id"), "_id")
    return train((r.text, r.y) for r in rows.toLocalIterator())


def score_toxicity(documents: DataFrame, net: Toxicity, column: str = "toxicity") -> DataFrame:
    """The documents' own columns with ``column`` (0 to 1), all windows of each whole text scored where the rows are.

    A column of that name that the documents have already is replaced; choose another name to keep it.

    Null and empty texts are scored as one empty window, which gives the bias alone.
    Repeated rows score alike; an empty table gives no rows.
    """
    documents = documents.drop(column)
    shipped = documents.sparkSession.sparkContext.broadcast(pickle.dumps(net))  # a fixed size, whatever the input
    names = documents.columns
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches):
        score = scorer(shipped.value)
        try:
            for batch in batches:
                for part in slices(batch, names.index("text")):
                    values = score([t or "" for t in part.column(names.index("text")).to_pylist()]) if part.num_rows else np.zeros(0)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(values, 9), pa.float64())], names=[*part.schema.names, column])
        finally:  # later stages use the same worker
            score = batch = part = values = None  # noqa: F841
            let_go()

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField(column, DoubleType())]))
