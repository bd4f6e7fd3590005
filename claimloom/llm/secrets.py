"""Operator 9: secret scans by a character convolutional network over every candidate and its context."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.text import Taken, slices

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A candidate is any such run; every base finding is one too.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters of context on each side, of the candidate in one window, and between windows of a longer one.
CONTEXT, BODY, STRIDE = 20, 40, 20
WIDTH = BODY + 2 * CONTEXT
#: Share of held-out secrets that the threshold must keep, and of other findings that may lie over it.
RECALL, OTHERS = 0.99, 0.002
#: Made findings that the network learns from.
FINDINGS = 9000
#: Common syllables of four languages, from which the made prose and compound words come.
SYLLABLES = "the an tion er re lich keit ment aux des ción os en is at ou ing and that ver sch ach eau que ent ble ist ung che ein pre con dis ness ful wh th str pf tz ß ü ä é ñ le la de un por ado ida nte mos ais oux heit ge be zu mit nd st ll ed ly or on in of a e i o u s t n r m der die das ich och eit ure age oir ette ian ado eño illa ista"
CLASSES = 100
FILTERS, SPAN, EMBED = 24, 5, 8


def _codes(text: str) -> np.ndarray:
    """A class for each character: printable ASCII its own, controls and blanks one, other letters one."""
    raw = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where((raw >= 33) & (raw < 127), raw - 32, np.where(raw < 33, 95, 96))


def windows(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class codes and inside marks of the windows over ``text[start:end]``; together they cover all of it."""
    codes, marks = [], []
    for at in range(start, max(end - STRIDE, start + 1), STRIDE) if end - start > BODY else (start,):
        stop = min(at + BODY, end)
        code, mark = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.float32)
        left = max(0, at - CONTEXT)
        part = _codes(text[left : stop + CONTEXT])
        begin = CONTEXT - (at - left)
        code[begin : begin + len(part)] = part[: WIDTH - begin]
        mark[CONTEXT : CONTEXT + stop - at] = 1
        codes.append(code)
        marks.append(mark)
    return np.stack(codes), np.stack(marks)


class CharNet:
    """Embedding, one convolution, max pooling inside and outside the candidate, a logistic output."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(np.prod(s[:-1])), s).astype(np.float32)
        self.p = {"e": rng.normal(0, 0.5, (CLASSES, EMBED)).astype(np.float32), "k": scale(SPAN * (EMBED + 1), FILTERS), "b": np.zeros(FILTERS, np.float32), "w": scale(2 * FILTERS, 1)[:, 0], "c": np.zeros(1, np.float32)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, codes, marks):
        x = np.concatenate([self.p["e"][codes], marks[:, :, None]], 2)
        n, width, depth = x.shape
        places = width - SPAN + 1
        cols = np.lib.stride_tricks.as_strided(x, (n, places, SPAN * depth), (x.strides[0], x.strides[1], x.strides[2])).reshape(n * places, -1)
        h = np.maximum(cols @ self.p["k"] + self.p["b"], 0).reshape(n, places, FILTERS)
        inside = marks[:, SPAN // 2 : SPAN // 2 + places, None]
        pools = []
        for gate in (inside, 1 - inside):
            gated = h * gate
            at = gated.argmax(1)
            pools.append((at, np.take_along_axis(gated, at[:, None], 1)[:, 0]))
        pooled = np.concatenate([pools[0][1], pools[1][1]], 1)
        return pooled @ self.p["w"] + self.p["c"][0], (cols, pools, pooled, x.shape)

    def gradients(self, codes, marks, labels):
        z, (cols, pools, pooled, (n, width, depth)) = self.forward(codes, marks)
        dz = ((1 / (1 + np.exp(-z)) - labels) / n).astype(np.float32)
        g = {"w": pooled.T @ dz, "c": dz.sum(keepdims=True)}
        places = width - SPAN + 1
        dh = np.zeros((n, places, FILTERS), np.float32)
        for side, (at, value) in enumerate(pools):
            part = dz[:, None] * self.p["w"][None, side * FILTERS : (side + 1) * FILTERS] * (value > 0)
            np.add.at(dh, (np.arange(n)[:, None], at, np.arange(FILTERS)[None]), part)
        flat = dh.reshape(n * places, FILTERS)
        g["k"], g["b"] = cols.T @ flat, flat.sum(0)
        dx = np.zeros((n, width, depth), np.float32)
        back = (flat @ self.p["k"].T).reshape(n, places, SPAN, depth)
        for s in range(SPAN):
            dx[:, s : s + places] += back[:, :, s]
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], codes, dx[:, :, :EMBED])
        return g

    def fit(self, codes, marks, labels, epochs: int = 6, batch: int = 128, rate: float = 0.004, seed: int = 3):
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
                step += 1
                for k, g in self.gradients(codes[rows], marks[rows], labels[rows]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def calibrate(self, codes, marks, labels, owner=None, recall: float = RECALL):
        """Platt scaling on held-out findings, then a threshold that keeps ``recall`` of the secrets.

        A finding's logit is its highest window's. Platt's smoothed targets keep the scale
        finite where the two kinds are apart. Of the thresholds that keep the recall the highest
        is the quantile of the secrets; where all but ``OTHERS`` of the other findings lie
        under it, the threshold goes half way to them (in logits), so that keys unlike the made
        ones have room.
        """
        z = np.concatenate([self.forward(codes[i : i + 256], marks[i : i + 256])[0] for i in range(0, len(codes), 256)]).astype(np.float64)
        if owner is not None:
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            z, labels = np.maximum.reduceat(z, first), labels[first]
        yes = int((labels == 1).sum())
        target = np.where(labels == 1, (yes + 1) / (yes + 2), 1 / (len(labels) - yes + 2))
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = p * (1 - p) + 1e-6
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()]))
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        self.slope, self.shift = float(a), float(b)
        kept, others = np.sort(a * z[labels == 1] + b), np.sort(a * z[labels != 1] + b)
        least = kept[int((1 - recall) * len(kept))]
        below = others[min(len(others) - 1, int((1 - OTHERS) * len(others)))] if len(others) else least
        self.threshold = float(1 / (1 + np.exp(-(least + min(below, least)) / 2)))

    def score(self, codes, marks):
        parts = [self.forward(codes[i : i + 256], marks[i : i + 256])[0] for i in range(0, len(codes), 256)]
        return 1 / (1 + np.exp(-(self.slope * np.concatenate(parts).astype(np.float64) + self.shift)))


def labelled_findings(n: int = FINDINGS, seed: int = 17) -> list[tuple[str, int, int, int]]:
    """``(text, start, end, label)``: made findings in made prose, half of them secrets.

    Secrets are random keys of the usual alphabets, letters alone too, with or without an
    assignment before them. The others are hard ones: compound and camel-case words,
    identifiers, paths, dates, numbers, number groups, rules of repeated characters, some of
    them assigned too.
    """
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(np.array(list(s))[rng.integers(0, len(s), k)])
    one = lambda xs: xs[int(rng.integers(0, len(xs)))]
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = SYLLABLES.split()
    word = lambda least=1, most=4: "".join(one(syllables) for _ in range(rng.integers(least, most)))
    plain = lambda *size: word(*size).encode("ascii", "ignore").decode()
    prose = lambda: " ".join(word() for _ in range(rng.integers(0, 8)))
    names = ["password", "secret", "token", "api_key", "apikey", "auth", "key", "credential", "bearer", "private_key", "TOKEN", "Secret"]

    def secret() -> str:
        size = int(rng.integers(20, 64))
        kinds = [
            lambda: pick(lower + upper + digit, size), lambda: pick("0123456789abcdef", size), lambda: pick("0123456789ABCDEF", size), lambda: pick(lower + upper + digit + "+/", size) + "=" * int(rng.integers(0, 3)),
            lambda: "AKIA" + pick(upper + digit, 16), lambda: pick(lower + digit, 3) + "_" + pick(lower + upper + digit, size), lambda: pick(lower + upper, size), lambda: pick(upper + "234567", size), lambda: pick(lower, size), lambda: pick(lower + upper + digit + "-_", size),
        ]
        return one(kinds)()

    def other() -> str:
        kinds = [
            lambda: pick(digit, int(rng.integers(16, 20))), lambda: plain(5, 10) + pick(digit, 2), lambda: "/".join([*(plain() for _ in range(4)), pick(digit, 2), "index"]), lambda: f"20{pick(digit, 2)}-0{pick('123456789', 1)}-{pick('12', 1)}{pick(digit, 1)}-{plain()}-report",
            lambda: pick(upper + digit + "-=_/+", 1) * int(rng.integers(16, 50)) + one(["1", ""]), lambda: one("_-").join([*(plain() for _ in range(4)), one([pick(digit, 1), ""])]), lambda: "-".join(pick(digit, 4) for _ in range(int(rng.integers(4, 7)))),
            lambda: plain(5, 12), lambda: plain(5, 12).capitalize(), lambda: plain(5, 10).upper(), lambda: "".join(plain(1, 3).capitalize() for _ in range(int(rng.integers(3, 7)))), lambda: "/".join(plain(1, 3) for _ in range(int(rng.integers(4, 8)))), lambda: one("_-").join(plain(1, 3) for _ in range(int(rng.integers(4, 8)))), lambda: plain(5, 12),
        ]
        body = one(kinds)()
        return body if len(body) >= 16 else body + "-section-" + pick(digit, 2)

    out = []
    for k in range(n):
        label = k % 2
        body = secret() if label else other()
        if label:
            lead = one(names) + one(["=", ": ", ' = "', "='", " "]) if rng.random() < 0.6 else ""
        else:
            lead = one(["id=", "path: ", "see ", "no. ", "name: ", "class "]) if rng.random() < 0.4 else ""
        before = prose() + (" " if rng.random() < 0.9 else "\n") + lead
        out.append((before + body + one(['" ', " ", "\n", ". ", ""]) + prose(), len(before), len(before) + len(body), label))
    return out


@functools.lru_cache(2)
def trained(n: int = FINDINGS, seed: int = 17) -> CharNet:
    """The network fitted on four fifths of the labelled findings and calibrated on the rest."""
    rows = labelled_findings(n, seed)
    parts = [windows(t, a, b) for t, a, b, _ in rows]
    codes, marks = (np.concatenate([p[i] for p in parts]) for i in range(2))
    labels = np.concatenate([np.full(len(p[0]), r[3], np.float32) for p, r in zip(parts, rows, strict=True)])
    owner = np.concatenate([np.full(len(p[0]), k) for k, p in enumerate(parts)])
    net, held = CharNet(), owner % 5 == 4
    net.fit(codes[~held], marks[~held], labels[~held])
    net.calibrate(codes[held], marks[held], labels[held], owner[held])
    return net


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' findings by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for run in RUN.finditer(text) for m in HEX.finditer(text, *run.span())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list) -> list[tuple[int, int]]:
    """Every run and every base finding, whole."""
    return sorted({*(m.span() for m in RUN.finditer(text)), *((a, b) for _, a, b in base)})


def found_spans(texts: list[str], net: CharNet) -> list[tuple[list, list]]:
    """For each text its base spans and all spans; the model's stay clear of the base's."""
    bases = [base_spans(t) for t in texts]
    jobs = [(k, a, b) for k, t in enumerate(texts) for a, b in candidates(t, bases[k])]
    scores: dict[tuple, float] = {}
    for at in range(0, len(jobs), 512):
        part = jobs[at : at + 512]
        views = [windows(texts[k], a, b) for k, a, b in part]
        score = net.score(np.concatenate([v[0] for v in views]), np.concatenate([v[1] for v in views]))
        ends = np.cumsum([len(v[0]) for v in views])
        scores |= {job: float(score[e - len(v[0]) : e].max()) for job, v, e in zip(part, views, ends, strict=True)}
    out, taken = [(base, list(base)) for base in bases], list(map(Taken, bases))
    for (k, a, b), score in scores.items():
        if score >= net.threshold and not taken[k](a, b):
            out[k][1].append(("model", a, b))
    return [(base, sorted(every, key=lambda s: (s[1], KINDS.index(s[0])))) for base, every in out]


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _scan(documents: DataFrame, columns: str, shape: pa.Schema, make):
    net = trained()

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [make(t, base, every) for t, (base, every) in zip(texts, found_spans(texts, net), strict=True)]
                arrays = [part.column(0), *(pa.array([r[i] for r in rows], shape[i + 1].type) for i in range(len(shape) - 1))]
                yield pa.RecordBatch.from_arrays(arrays, schema=shape)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns)


def scan_secrets(documents: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row.

    Spans are ``kind:start:end`` in code points, end exclusive: the rules' (assign, access,
    hex) and the network's own (model). A null text is empty: no spans, the hash of the
    empty string. Repeated rows and null ids keep a row each; an empty table gives none.
    """

    def make(_, base, every):
        kinds = [s[0] for s in base]
        return (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))

    shape = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
    return _scan(documents, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", shape, make)


def redact(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """``text`` with each maximal stretch of spans replaced by ``mark``."""
    out, at, reach = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= reach:
            out += [text[at:a], mark]
        at = reach = max(reach, b)
    return "".join([*out, text[at:]])


def redact_secrets(documents: DataFrame) -> DataFrame:
    """The documents' own columns with every found secret replaced in ``text`` and ``n_chars`` (where there) counted anew.

    Null texts stay null and empty ones empty; null ids, repeated rows and extra columns stay
    as they are; an empty table gives no rows. Texts are scanned where the rows are, without
    a shuffle.
    """
    names = documents.columns
    net = trained()

    def run(batches):
        for batch in batches:
            for part in slices(batch, names.index("text")):
                texts = part.column(names.index("text")).to_pylist()
                found = found_spans([t or "" for t in texts], net)
                done = [t if t is None else redact(t, every) for t, (_, every) in zip(texts, found, strict=True)]
                arrays = list(part.columns)
                arrays[names.index("text")] = pa.array(done, part.schema.field("text").type)
                if "n_chars" in names:
                    counts = [o if t is None else len(t) for t, o in zip(done, part.column(names.index("n_chars")).to_pylist(), strict=True)]
                    arrays[names.index("n_chars")] = pa.array(counts, part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return documents.mapInArrow(run, documents.schema)
