"""Operator 5: personal data by a character-level bidirectional LSTM with CRF transitions.

Overlapping windows give emissions for their characters. A document's emissions are joined
over all its windows, fading from one to the next where they overlap, and its best tag path
is found over the whole of them. Most stretches cannot gain by leaving tag 0, whatever the
transitions; two running sums find the others exactly, and only those are searched.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.text import Taken, slices

KINDS = ("email", "ip", "card", "phone")
#: What stands before and after the @ of an e-mail; runs are taken whole, so long ones are read once.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Spellings of @ in addresses that the rules do not know.
AT = re.compile(r"\(at\)|\[at\]")
TAGS = 1 + len(KINDS)
HIDDEN = 8
#: Characters of a window at most, and that neighbours share at least.
WINDOW, OVERLAP = 768, 32
CLASSES, PAD = 98, 97
#: Windows that run side by side, and characters of texts that are decoded together (one text at least).
BATCH = 2048
DECODED = BATCH * WINDOW
#: Bytes of text whose windows are sorted together.
TOGETHER = 32 << 20
#: Made sentences that the network learns from.
SENTENCES = 3600
EDGE = " \t\n\r.,;:!?()[]|\"'*#$%&"


_CODE = np.r_[np.full(32, 95), np.arange(95), 96].astype(np.int16)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of LOCAL's characters, @ and a dotted host, each character read once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        host = HOST.match(text, at + 1)
        if host:
            start = done + len(text[done:at].rstrip(LOCAL))
            if start < at:
                out.append((start, host.end()))
        # what comes next begins behind this match or, failing one, behind this @
        done = out[-1][1] if out and out[-1][1] > at else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' findings, by kind as listed, then start."""
    out = [("email", *span) for span in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def codes(text: str) -> np.ndarray:
    """A class for each code point: printable ASCII its own, blanks one, all others one."""
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 127)]


def windows(n: int) -> list[tuple[int, int]]:
    """Windows of nearly one length over ``n`` characters, neighbours sharing ``OVERLAP`` or more."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    count = -(-(n - OVERLAP) // (WINDOW - OVERLAP))
    size = -(-(n + (count - 1) * OVERLAP) // count)
    return [(a, a + size) for a in (round(k * (n - size) / (count - 1)) for k in range(count))]


class Tagger:
    """Two LSTMs over characters, emissions of five tags and transitions between them."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.normal(size=s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {"x": (0.5 * rng.normal(size=(2, CLASSES, 4 * HIDDEN))).astype(np.float32), "u": f(2, HIDDEN, 4 * HIDDEN), "e": f(2 * HIDDEN, TAGS), "b": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        self.p["x"][:, :, :HIDDEN] += 1.0
        self.p["b"][0] = 2.0
        self.p["t"] += 2.0 * np.eye(TAGS, dtype=np.float32)
        self.seal()

    def seal(self) -> None:
        """Order is forget gate, input gate, output gate, cell. Padding leaves empty states."""
        self.p["x"][:, PAD, : 3 * HIDDEN], self.p["x"][:, PAD, 3 * HIDDEN :] = -30.0, 0.0
        half = np.ones(4 * HIDDEN, np.float32)
        half[: 3 * HIDDEN] = 0.5
        self.table, self.step = self.p["x"] * half, self.p["u"] * half
        # for scoring, characters side by side; states are kept doubled, which the weights make up for
        self.rows = np.ascontiguousarray(self.table.transpose(0, 2, 1))
        self.across = np.ascontiguousarray(self.step.transpose(0, 2, 1) * 0.5)
        self.out = np.ascontiguousarray(self.p["e"].reshape(2, HIDDEN, TAGS).transpose(0, 2, 1) * 0.5)

    def states(self, ids: np.ndarray, keep: bool = False):
        """``ids[t, n]`` to states ``[t, 2, n, H]``; the second direction is stored in reading order too."""
        steps, n = ids.shape
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        out, saved = np.empty((steps, 2, n, HIDDEN), np.float32), []
        a = np.empty((2, n, 4 * HIDDEN), np.float32)
        for t in range(steps):
            np.matmul(h, self.step, out=a)
            a[0] += self.table[0].take(ids[t], 0)
            a[1] += self.table[1].take(ids[steps - 1 - t], 0)
            np.tanh(a, out=a)
            gates = a[:, :, : 3 * HIDDEN]
            gates += 1.0
            gates *= 0.5
            before = c
            c = gates[:, :, :HIDDEN] * c + gates[:, :, HIDDEN : 2 * HIDDEN] * a[:, :, 3 * HIDDEN :]
            tc = np.tanh(c)
            new = gates[:, :, 2 * HIDDEN :] * tc
            if keep:
                saved.append((h, before, a.copy(), tc))
            h = new
            out[t, 0], out[steps - 1 - t, 1] = h[0], h[1]
        return out, saved

    def emissions(self, states: np.ndarray) -> np.ndarray:
        return states[:, 0] @ self.p["e"][:HIDDEN] + states[:, 1] @ self.p["e"][HIDDEN:] + self.p["b"]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Emissions ``[t, tag, n]`` of ``ids[t, n]``: what ``emissions(states(ids))`` gives, laid out for speed."""
        steps, n = ids.shape
        ids, cut = ids.astype(np.intp), 3 * HIDDEN
        h, c, tc = (np.zeros((2, HIDDEN, n), np.float32) for _ in range(3))
        a, g = np.empty((2, 4 * HIDDEN, n), np.float32), np.empty((4 * HIDDEN, n), np.float32)
        e, own = np.zeros((steps, TAGS, n), np.float32), np.empty((2, TAGS, n), np.float32)
        e += self.p["b"][:, None]
        for t in range(steps):
            np.matmul(self.across, h, out=a)
            for d, at in ((0, ids[t]), (1, ids[steps - 1 - t])):
                np.take(self.rows[d], at, axis=1, out=g, mode="clip")
                a[d] += g
            np.tanh(a, out=a)
            a[:, :cut] += 1.0
            c *= a[:, :HIDDEN]
            a[:, cut:] *= a[:, HIDDEN : 2 * HIDDEN]
            c += a[:, cut:]
            c *= 0.5
            np.tanh(c, out=tc)
            np.multiply(a[:, 2 * HIDDEN : cut], tc, out=h)
            np.matmul(self.out, h, out=own)
            e[t] += own[0]
            e[steps - 1 - t] += own[1]
        return e

    def doubtful(self, lead: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which places of texts laid end to end may lie off tag 0 on a best path.

        ``lead`` is, at each place, no less than what the best other tag's emission is ahead of
        tag 0's. A stretch off tag 0 gains at most the sum of its leads and of the best inner
        transition's, less what entering and leaving cost; at a text's ends it saves one of
        these. The best stretch through each place is two running sums.
        """
        t = self.p["t"].astype(np.float64)
        inner, enter, leave, stay = t[1:, 1:].max(), t[0, 1:].max(), t[1:, 0].max(), t[0, 0]
        gain = lead + (inner - stay)
        first, last = starts, np.append(starts[1:], len(lead)) - 1
        gain[first] += stay - enter
        gain[last] += stay - leave

        def running(g, begins):
            total = np.concatenate([[0.0], np.cumsum(np.abs(g))])
            wall = np.zeros(len(g))
            wall[begins[1:]] = -np.diff(total[begins]) - 1.0  # no stretch gains by reaching over a text's beginning
            sums = np.concatenate([[0.0], np.cumsum(g + wall)])
            return sums[1:] - np.minimum.accumulate(sums[:-1] + wall)

        through = running(gain, first) + running(gain[::-1], len(lead) - 1 - last[::-1])[::-1] - gain
        return through > inner + stay - enter - leave - 1e-3

    def paths(self, lead: np.ndarray, starts: np.ndarray, emissions) -> np.ndarray:
        """Best tags of texts laid end to end; ``emissions(a, b)`` gives those of a stretch of places."""
        tags = np.zeros(len(lead), np.int8)
        if not len(lead):
            return tags
        off = self.doubtful(lead, starts)
        edge = np.zeros(len(lead) + 1, bool)
        edge[starts] = edge[-1] = True
        begin = np.flatnonzero(off & (edge[:-1] | ~np.concatenate([[False], off[:-1]]))).tolist()
        stop = (np.flatnonzero(off & (edge[1:] | ~np.concatenate([off[1:], [False]]))) + 1).tolist()
        order = sorted(range(len(begin)), key=lambda k: begin[k] - stop[k])
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            lengths = np.array([stop[k] - begin[k] for k in rows])
            e = np.zeros((lengths[0], len(rows), TAGS), np.float32)
            for j, k in enumerate(rows):  # beyond a stretch lies tag 0 or nothing
                e[: lengths[j], j] = emissions(begin[k], stop[k])
                e[0, j] += 0 if edge[begin[k]] else self.p["t"][0]
                e[lengths[j] - 1, j] += 0 if edge[stop[k]] else self.p["t"][:, 0]
            best = self.viterbi(e, lengths)
            for j, k in enumerate(rows):
                tags[begin[k] : stop[k]] = best[: lengths[j], j]
        return tags

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        steps, n, _ = e.shape
        score, back = e[0].copy(), np.zeros((steps, n, TAGS), np.int8)
        for k in range(1, steps):
            paths = score[:, :, None] + self.p["t"][None]
            back[k] = paths.argmax(1)
            alive = (k < lengths)[:, None]
            score = np.where(alive, paths.max(1) + e[k], score)
            back[k] = np.where(alive, back[k], np.arange(TAGS))
        tags = np.zeros((steps, n), np.int8)
        at = score.argmax(1)
        for k in range(steps - 1, -1, -1):
            tags[k] = at
            at = back[k][np.arange(n), at]
        return np.where(np.arange(steps)[:, None] < lengths[None], tags, 0)

    # training ---------------------------------------------------------------
    def gradients(self, ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray):
        """Of the mean negative log-likelihood of the tag paths."""
        states, saved = self.states(ids, True)
        e, (steps, n), t = self.emissions(states).astype(np.float64), ids.shape, self.p["t"].astype(np.float64)
        live = np.arange(steps)[:, None] < lengths[None]
        log_sum = lambda v, axis: np.log(np.exp(v - v.max(axis, keepdims=True)).sum(axis)) + v.max(axis)
        alpha, beta = np.empty((steps, n, TAGS)), np.zeros((steps, n, TAGS))
        alpha[0] = e[0]
        for k in range(1, steps):
            alpha[k] = np.where(live[k][:, None], log_sum(alpha[k - 1][:, :, None] + t, 1) + e[k], alpha[k - 1])
        total = log_sum(alpha[-1], 1)
        g_t = np.zeros_like(t)
        for k in range(steps - 2, -1, -1):
            nxt = t[None] + (e[k + 1] + beta[k + 1])[:, None, :]
            beta[k] = np.where(live[k + 1][:, None], log_sum(nxt, 2), beta[k + 1])
            pair = np.exp(alpha[k][:, :, None] + nxt - total[:, None, None]) * live[k + 1][:, None, None]
            g_t += pair.sum(0)
            np.add.at(g_t, (tags[k][live[k + 1]], tags[k + 1][live[k + 1]]), -1.0)
        g_e = np.exp(alpha + beta - total[None, :, None]) * live[:, :, None]
        rows = np.nonzero(live)
        g_e[rows[0], rows[1], tags[rows]] -= 1.0
        g_e, g_t = (g_e / n).astype(np.float32), (g_t / n).astype(np.float32)
        g = {"t": g_t, "b": g_e.sum((0, 1)), "e": np.concatenate([np.einsum("tnh,tnk->hk", states[:, d], g_e) for d in range(2)])}
        g["u"], g["x"] = np.zeros_like(self.p["u"]), np.zeros_like(self.p["x"])
        d_states = np.stack([g_e @ self.p["e"][:HIDDEN].T, g_e @ self.p["e"][HIDDEN:].T], 1)
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        for k in range(steps - 1, -1, -1):
            h, before, a, tc = saved[k]
            f, i, o, z = (a[:, :, j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
            dh = dh + np.stack([d_states[k, 0], d_states[steps - 1 - k, 1]])
            dc = dc + dh * o * (1 - tc * tc)
            flat = np.concatenate([dc * before * f * (1 - f), dc * z * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - z * z)], 2)
            for d, at in ((0, ids[k]), (1, ids[steps - 1 - k])):
                g["u"][d] += h[d].T @ flat[d]
                np.add.at(g["x"][d], at, flat[d])
            dh, dc = flat @ self.p["u"].transpose(0, 2, 1), dc * f
        g["x"][:, PAD] = 0
        return g, float((total - self._path(e, t, tags, live)).mean())

    @staticmethod
    def _path(e, t, tags, live):
        at = np.take_along_axis(e, tags[:, :, None].astype(np.int64), 2)[:, :, 0] * live
        return at.sum(0) + (t[tags[:-1], tags[1:]] * live[1:]).sum(0)

    def fit(self, rows: list[tuple[str, list]], epochs: int = 8, batch: int = 60, rate: float = 0.02, seed: int = 8) -> None:
        rng, step = np.random.default_rng(seed), 0
        total = epochs * max(1, len(rows) // batch)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                ids, lengths = side_by_side([codes(rows[r][0]) for r in part])
                tags = np.zeros(ids.shape, np.int64)
                for k, r in enumerate(part):
                    for kind, a, b in rows[r][1]:
                        tags[a:b, k] = 1 + KINDS.index(kind)
                step += 1
                grads, _ = self.gradients(ids, tags, lengths)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= rate * (1 - 0.9 * step / total) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                self.seal()


def side_by_side(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts])
    ids = np.full((max(1, lengths.max(initial=1)), len(parts)), PAD, np.int16)
    for k, p in enumerate(parts):
        ids[: len(p), k] = p
    return ids, lengths


def labelled_spans(n: int = SENTENCES, seed: int = 23) -> list[tuple[str, list]]:
    """``(text, spans)``: made prose with personal data in several spellings, and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(s[i] for i in rng.integers(0, len(s), k))
    one = lambda xs: xs[int(rng.integers(0, len(xs)))]
    digits, lower, hexes = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    syllables = ["the", "an", "tion", "er", "re", "lich", "keit", "ment", "aux", "des", "ción", "os", "en", "is", "ä", "ñ", "THE", "Ou", "ING"]
    word = lambda: "".join(one(syllables) for _ in range(int(rng.integers(1, 4)))) + one(["", "", "", "", ",", ".", "!!", "###", " |"])
    name = lambda: pick(lower, int(rng.integers(2, 9)))

    def card():
        body = pick("123456789", 1) + pick(digits, 14)
        body += next(c for c in digits if luhn(body + c))
        sep = one(["", "", " ", "-", "."])
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def personal(kind):
        if kind == "email":
            host = one([".", "."]).join([name(), one(["com", "org", "net", "de", "example.com"])])
            return name() + one(["", ".", "_", "."]) + one([name(), pick(digits, 2)]) + one(["@", "@", "@", " @ ", " (at) ", "[at]"]) + host
        if kind == "ip":
            return ".".join(str(int(rng.integers(0, 256))) for _ in range(4)) + one(["", "", "", ":" + pick(digits, 4)])
        if kind == "card":
            return card()
        area, mid, end = pick(digits, 3), pick(digits, 3), pick(digits, 4)
        return one([f"+{one('1234')} ({area}) {mid}-{end}", f"+{pick('123456789', 2)} {area} {mid} {end}", f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"+{pick('123456789', 2)}{area}{mid}{end}"])

    def decoy():
        return one([pick(digits, int(rng.integers(1, 7))), f"20{pick(digits, 2)}-0{pick('123456789', 1)}-{pick('12', 1)}{pick(digits, 1)}", f"{pick(digits, 1)}.{pick(digits, 1)}", f"{pick(digits, 1)}.{pick(digits, 1)}.{pick(digits, 1)}", f"{pick(digits, 2)}.{pick(digits, 2)}%", f'token = "{pick(hexes, 40)}"', f"${pick(digits, 3)},{pick(digits, 3)}", pick(hexes, 32), f"@{name()}", f"{pick(digits, 4)}-{pick(digits, 2)}", "#" + pick(digits, 5), "Version 2.0.", "CC BY-NC 4.0."])

    out = []
    for _ in range(n):
        text, found = "", []
        for _ in range(int(rng.integers(4, 18))):
            draw = rng.random()
            if draw < 0.16:
                kind = one(KINDS)
                part = personal(kind)
                found.append((kind, len(text), len(text) + len(part)))
                text += part + one(["", "", ".", ",", "!!", "%%%"])
            else:
                text += decoy() if draw < 0.28 else word()
            text += one([" ", " ", " ", "\n"])
        out.append((text, found))
    return out


@functools.lru_cache(1)
def trained() -> Tagger:
    """Deterministic: the same network in every driver and every run."""
    tagger = Tagger()
    tagger.fit(labelled_spans())
    return tagger


@functools.lru_cache(64)
def _ramp(n: int) -> np.ndarray:
    """Weights over ``n`` shared characters for the later window; reversed for the earlier one."""
    return ((np.arange(n) + 1) / (n + 1)).astype(np.float32)


class Emissions:
    """Emissions of all windows of some texts laid end to end.

    Where two windows overlap, the weight passes evenly from the one to the next. ``lead`` is
    the weighted lead of the best tag over tag 0, never less than the weighted emissions' own.
    """

    def __init__(self, texts: list[str], tagger: Tagger):
        self.begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.lead = np.zeros(self.begins[-1])
        own, cuts = [codes(t) for t in texts], [windows(len(t)) for t in texts]
        self.places = [(int(self.begins[k]) + a, int(self.begins[k]) + b, (w[i - 1][1] if i else a) - a, b - (w[i + 1][0] if i + 1 < len(w) else b)) for k, w in enumerate(cuts) for i, (a, b) in enumerate(w)]
        self.starts = [p[0] for p in self.places]
        self.views: list = [None] * len(self.places)
        parts = [own[k][a:b] for k, w in enumerate(cuts) for a, b in w]
        order = sorted(range(len(parts)), key=lambda w: -len(parts[w]))
        for at in range(0, len(order), BATCH):
            now = order[at : at + BATCH]
            e = tagger.scores(side_by_side([parts[w] for w in now])[0])
            lead = e[:, 1].copy()
            for k in range(2, TAGS):
                np.maximum(lead, e[:, k], out=lead)
            lead = np.ascontiguousarray((lead - e[:, 0]).T)
            for j, w in enumerate(now):
                self.views[w] = e[:, :, j]
                a, b, before, after = self.places[w]
                row = lead[j, : b - a]
                row[:before] *= _ramp(before)
                row[b - a - after :] *= _ramp(after)[::-1]
                self.lead[a:b] += row

    def __call__(self, start: int, stop: int) -> np.ndarray:
        out = np.zeros((stop - start, TAGS), np.float32)
        for w in range(max(0, bisect.bisect_right(self.starts, start) - 2), bisect.bisect_left(self.starts, stop)):
            a, b, before, after = self.places[w]
            lo, hi = max(a, start), min(b, stop)
            if lo < hi:
                place = np.arange(lo, hi)
                weight = np.minimum(np.minimum((place - a + 1) / (before + 1), (b - place) / (after + 1)), 1.0)
                out[lo - start : hi - start] += self.views[w][lo - a : hi - a] * weight[:, None].astype(np.float32)
        return out


def tag_texts(texts: list[str], tagger: Tagger) -> list[np.ndarray]:
    """Tags of every character of every text, each text decoded as a whole."""
    out = [np.zeros(0, np.int8)] * len(texts)
    width = [w[0][1] - w[0][0] if w else 0 for w in (windows(len(t)) for t in texts)]
    order = sorted((k for k, t in enumerate(texts) if t), key=lambda k: -width[k])
    while order:
        size = np.cumsum([len(texts[k]) for k in order])
        now = order[: max(1, int(np.searchsorted(size, DECODED, side="right")))]
        order = order[len(now) :]
        found = Emissions([texts[k] for k in now], tagger)
        tags = tagger.paths(found.lead, found.begins[:-1], found)
        for k, a, b in zip(now, found.begins, found.begins[1:], strict=False):
            out[k] = tags[a:b]
    return out


def model_spans(text: str, tags: np.ndarray, base: list) -> list[tuple[str, int, int]]:
    """Runs of one tag, trimmed; runs that touch a rule's span or hold no digit and no @, in any spelling, are left out."""
    if not tags.any():
        return []
    cuts = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    out, taken = [], Taken(base)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if not tags[a]:
            continue
        run = text[a:b]
        a, b = int(a) + len(run) - len(run.lstrip(EDGE.replace("(", ""))), int(b) - len(run) + len(run.rstrip(EDGE))
        if b - a >= 7 and (any(c.isdigit() or c == "@" for c in text[a:b]) or AT.search(text, a, b)) and not taken(a, b):
            out.append((KINDS[int(tags[a]) - 1], a, b))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def found_spans(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """Base spans and all spans of each text, both by kind as listed, then start."""
    out = []
    for text, tags in zip(texts, tag_texts(texts, tagger), strict=True):
        base = base_spans(text)
        every = sorted(base + model_spans(text, tags, base), key=lambda s: (KINDS.index(s[0]), s[1]))
        out.append((base, every))
    return out


def find_personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row.

    Counts and hash are the rules'; ``spans`` holds theirs and the network's. A null text is
    empty: no spans, the hash of the empty string. Repeated rows and null ids keep a row
    each; an empty table gives none. All characters of all texts pass the network.
    """
    tagger = trained()
    shape = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, TOGETHER):  # many texts at once leave windows of like length side by side
                rows = []
                for base, every in found_spans([t or "" for t in part.column(1).to_pylist()], tagger):
                    kinds = [s[0] for s in base]
                    rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], shape[i + 1].type) for i in range(len(shape) - 1))], schema=shape)

    sql = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, sql)
