"""Secret scan: base patterns, and a character convolutional network over every other candidate.

Candidates are long runs of key-like characters, and whatever follows a key-like name, of any length; what a base
span covers is cut from them. The network sees a window of the candidate and its
surrounding characters: embedded characters, one convolution, ReLU, maximum over the positions, and a logistic layer,
all in numpy. Overlapping windows cover a run to its end, and one more starts at each part between '=' and '/'; the
highest score counts. The network is trained on labelled findings: some made by rule, and those of a bounded sample of
the documents, where base spans are secrets and other candidates are not. Platt scaling on findings held out, cut into
windows as a scan cuts them, calibrates it; each kind of candidate (long runs, values of key-like names) has a threshold
of its own, the highest one that keeps the wanted recall on those that no base pattern covers, so that the recall of the
whole scan is that at least. Shorter runs without such a name are not looked at.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# names are searched by their stem and then read on, each character once
_STEM = re.compile(r"pass(?:word|wd|phrase|code)?|pwd|secret|token|key|bearer|credential|auth(?:orization)?", re.IGNORECASE)
_REST = re.compile(r"(s?)([A-Za-z0-9_-]*)")
_ASSIGNED = re.compile(r"""["'\])]*[ \t]*(?:[:=]|->)[:=>]?[ \t]*(?:(?:bearer|basic)[ \t]+)?""", re.IGNORECASE)
_SPACED = re.compile(r"[ \t]+(?:(?:is|was)[ \t]+)?", re.IGNORECASE)
_LOGIN = re.compile(r"://[^\s/:@]*+:([^\s/@]++)@")
_VALUE = re.compile(r"""(["'`])((?:(?!\1)[^\n])+)\1|\S+""")
_PART = re.compile("[^=/]+")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")

#: Words of letters, short numbers and repeats of one character, joined by marks: what a second rule calls harmless.
_HARMLESS = re.compile(r"[-_/=+]*+(?:(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,8}+|([^-_/=+])\1*+)(?:[-_/=+]++|$))*+")

LEAST = 16  #: characters of a candidate
SLICE = 4096  #: windows that are scored at a time
BEFORE, INSIDE, AFTER = 24, 40, 8
STEP = INSIDE // 2  #: between the windows of a long run
WIDTH = BEFORE + INSIDE + AFTER
CHARS, EMBED, FILTERS, KERNEL = 98, 8, 24, 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns, leftmost non-overlapping per kind, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # runs of hex digits are maximal either way, so asking for 32 at once only skips short ones
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def window(text: str, start: int, end: int) -> bytes:
    """The candidate and its context as a fixed number of character codes; the candidate starts at BEFORE."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    inside = text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    return (before + inside + text[end : end + AFTER].ljust(AFTER, "\0")).encode("latin-1", "replace")


RUN, VALUE = 0, 1  #: kinds of candidates


def cuts(text: str, start: int, end: int, kind: int = RUN) -> list[tuple[int, int, int, int, int]]:
    """Windows of a run: (start and end of what the network sees, start and end of the parts that it touches, kind)."""
    parts = [m.span() for m in _PART.finditer(text, start, end)]
    heads, tails = [p[0] for p in parts], [p[1] for p in parts]
    seen = {(s, min(s + INSIDE, end)) for s in (*range(start, max(start + 1, end - INSIDE + STEP), STEP), *heads)}
    seen.update((s, e) for s, e in parts if LEAST <= e - s < INSIDE)
    out = []
    for s, e in sorted(seen):
        head, tail = bisect_right(heads, s) - 1, bisect_left(tails, e)
        first = heads[head] if head >= 0 and s < tails[head] else s
        out.append((s, e, first, tails[tail] if tail < len(parts) and heads[tail] < e else e, kind))
    return out


def values(text: str) -> list[tuple[int, int]]:
    """What follows key-like names, and passwords inside URLs: quoted text, or a whole word without the marks around it."""
    out, at = [m.span(1) for m in _LOGIN.finditer(text)], 0
    while m := _STEM.search(text, at):
        rest = _REST.match(text, m.end())
        at = rest.end()
        link = _ASSIGNED.match(text, at) or (None if rest[2] else _SPACED.match(text, at))
        if link and (value := _VALUE.match(text, link.end())):
            s, e = value.span(2) if value[1] else value.span()
            if not value[1]:
                e -= len(value[0]) - len(value[0].rstrip("\"'`()[]{}<>,;."))
                s += len(value[0]) - len(value[0].lstrip("\"'`()[]{}<>"))
            if s < e:
                out.append((s, e))
    return out


def without(start: int, end: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What is left of a span outside sorted base spans."""
    out = []
    for s, _, e in found:
        if s < end and start < e:
            if start < s:
                out.append((start, s))
            start = e
    return [*out, (start, end)] if start < end else out


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The windows of all candidates of a text with these base spans; one that is of both kinds is there twice."""
    out = []
    for m in CANDIDATE.finditer(text):
        for s, e in without(*m.span(), found):
            if e - s >= LEAST:
                out += cuts(text, s, e)
    for value in values(text):
        for s, e in without(*value, found):
            out += cuts(text, s, e, VALUE)
    return list(dict.fromkeys(out))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_CODE = np.full(256, 97, np.int64)
_CODE[0], _CODE[10] = 0, 96
_CODE[32:127] = np.arange(1, 96)


def codes(windows: list[bytes]) -> np.ndarray:
    return _CODE[np.frombuffer(b"".join(windows), np.uint8)].reshape(len(windows), WIDTH)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class CharNet:
    """embedding (characters + inside/outside flag) -> convolution -> ReLU -> max -> logistic."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.3, (CHARS, EMBED)).astype(np.float32)
        self.conv = r.normal(0, 0.15, (KERNEL * (EMBED + 1), FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.2, FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.scale, self.offset, self.thresholds = 1.0, 0.0, np.full(2, 0.5)

    def _forward(self, x: np.ndarray):
        flag = np.zeros((len(x), WIDTH, 1), np.float32)
        flag[:, BEFORE : BEFORE + INSIDE] = 1
        e = np.concatenate((self.embed[x], flag), axis=2)
        columns = np.concatenate([e[:, j : WIDTH - KERNEL + 1 + j] for j in range(KERNEL)], axis=2)
        z = columns @ self.conv + self.bias
        top = z.argmax(axis=1)
        high = np.take_along_axis(z, top[:, None], axis=1)[:, 0]
        return columns, top, high, np.maximum(high, 0) @ self.out + self.shift[0]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.004) -> None:
        r, params = np.random.default_rng(3), [self.embed, self.conv, self.bias, self.out, self.shift]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
                columns, top, high, logit = self._forward(xb)
                d = ((1 / (1 + np.exp(-logit))) - yb) / len(xb)
                d_high = (d[:, None] * self.out) * (high > 0)
                picked = columns[np.arange(len(xb))[:, None], top]  # batch x filters x columns
                d_conv = np.einsum("bf,bfc->cf", d_high, picked)
                d_cols = (d_high[:, :, None] * self.conv.T).reshape(len(xb), FILTERS, KERNEL, EMBED + 1)[..., :EMBED]
                at_char = np.take_along_axis(xb, (top[:, :, None] + np.arange(KERNEL)).reshape(len(xb), -1), axis=1)
                d_embed = np.zeros_like(self.embed)
                np.add.at(d_embed, at_char.ravel(), d_cols.reshape(-1, EMBED))
                grads = [d_embed, d_conv, d_high.sum(0), np.maximum(high, 0).T @ d, d.sum(keepdims=True)]
                t += 1
                for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)] or [np.zeros(0)])

    def calibrate(self, z: np.ndarray, y: np.ndarray, kinds: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps, then for each kind the highest threshold that keeps the recall, and asks for no more
        than even odds: lines differ from those of the findings. z: -inf where nothing was scored."""
        every, scored = z, np.isfinite(z)
        secret = y == 1
        z, y = z[scored].astype(float), y[scored]
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        loss = lambda q: (np.logaddexp(0, q[0] * z + q[1]) - target * (q[0] * z + q[1])).sum()
        at = np.array([self.scale, self.offset])
        for _ in range(50):
            p = _sigmoid(at[0] * z + at[1])
            g, w = p - target, np.maximum(p * (1 - p), 1e-6)
            hess = np.array([[w @ (z * z) + 1e-3, w @ z], [w @ z, w.sum() + 1e-3]])
            step = np.linalg.solve(hess, [g @ z, g.sum()])
            # well separated findings make whole steps overshoot
            at = next((q for q in (at - step / 2**i for i in range(20)) if loss(q) < loss(at)), at)
        self.scale, self.offset = float(at[0]), float(at[1])
        for kind in (RUN, VALUE):
            ranked = np.sort(_sigmoid(self.scale * every[secret & (kinds == kind)] + self.offset))
            if len(ranked):
                self.thresholds[kind] = min(0.5, ranked[int((1 - recall) * len(ranked))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.logits(x) + self.offset)


_BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Forms of lines that hold a secret, and of lines that hold a harmless long token: fixed values.
SECRET_FORMS = [
    "password: {}", 'secret = "{}"', "API_KEY={}", "Authorization: Bearer {}", "auth_token='{}'", "private key {}",
    "aws_secret_access_key = {}", 'client_secret: "{}"', "https://user:{}@db.internal/main", "export TOKEN={}",
    '"credential": "{}"', "pwd={}", "x-api-key: {}", "access key is {}", "ssh pass {}", "session_key -> {}",
]
HARMLESS_FORMS = [
    "commit {}", "md5 {}", "sha256: {}", "see /usr/share/{}/index", "version {}", "file {}.png", "order no {}",
    "isbn {}", "request id {}", "img src={}", "the {} of", "class {} extends", "call {}()", "etag {}", "figure {}", "uuid {}",
]


def generated_findings(n: int = 4000, seed: int = 5, forms: list[str] = SECRET_FORMS) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, is_secret), half of them secrets, made by rule from forms."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    body = lambda letters, low, high: "".join(r.choice(letters) for _ in range(r.randint(low, high)))
    for i in range(n):
        secret, short = i % 2, False
        if secret:
            value = r.choice((body(_BASE62, 18, 44), body(_BASE62 + "+/", 22, 60) + "=", body("0123456789abcdef", 24, 64), "ghp_" + body(_BASE62, 30, 36), "sk_live_" + body(_BASE62, 20, 30), "xoxb-" + body("0123456789", 10, 12) + "-" + body(_BASE62, 18, 24)))
            line = r.choice(forms)
            if r.random() < 0.15:
                value = body(_BASE62[:52], 16, 24)
            elif short := r.random() < 0.2:  # beside its name only, without which it is no secret
                value = r.choice((body(_BASE62 + "!#$%&*", 6, 15), word() + body("0123456789", 1, 3) + body("xyz!_", 1, 2)))
        else:
            value = r.choice((body("0123456789abcdef", 20, 40), "_".join((word(), word(), word())) + body("0123456789", 1, 3), "-".join((word(), word(), body("0123456789", 4, 8), word())), body("0123456789", 16, 24), word() + word().title() + word().title() + body("0123456789", 1, 2) + word()))
            line = r.choice(HARMLESS_FORMS)
            if r.random() < 0.4:  # long words, names and rules, and plain words after a key-like name
                value = r.choice((lambda: body(_BASE62[26:52], 2, 6) + word() + word() + word(), lambda: "-".join((word(), word(), word(), word())), lambda: word().title() + word().title() + word().title() + word().title(), lambda: r.choice("-=_x*") * r.randint(16, 80)))()
                if r.random() < 0.3:
                    line, value = r.choice(("the token {} was", "password is {}", "a key {} in", "secret: {}", "pass {}", "auth {}")), word()
        if r.random() < 0.3 and not short:  # in one run with a path or a name before it, or a path after it
            path = "/".join(r.choice((word, word, lambda: body(_BASE62[26:36] + _BASE62[52:], 4, 9)))() for _ in range(r.randint(1, 9)))
            named = "_".join(word().upper() for _ in range(r.randint(2, 7)))
            line = line.replace("{}", r.choice((f"https://{word()}.com/{path}/{{}}", f"/{path}/{{}}", f"{path}/{{}}/{word()}/{word()}", f"{named}={{}}")))
        text = " ".join(word() for _ in range(r.randint(0, 5))) + r.choice((" ", "\n", ". ", "")) + line
        start = text.index("{}")
        if r.random() < 0.2 and not short:
            text = text.upper().replace(" ", "!! ")
            start = text.index("{}")
        out.append((text.replace("{}", value) + r.choice(("", "\n", " ", ", ")) + " ".join(word() for _ in range(r.randint(0, 4))), start, start + len(value), secret))
    return out


SAMPLE_ROWS = 400  #: documents whose findings are learned from, at most
A_ROW = 2  #: findings of each kind and document that are learned from, at most
AROUND = 200  #: characters kept on either side of a finding


def sampled_findings(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, int, int, int]]:
    """Labelled findings of a bounded sample of documents, chosen by a hash of their ids: base spans are secrets (of an
    assignment its value), and candidates that a second rule calls harmless are none. What neither rule knows has no
    label and is not learned from. The scan itself reads all documents."""
    columns = "text string, start int, stop int, secret int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int, int]] = []
            for text in batch.column(0).to_pylist():
                text = text or ""
                found = base_spans(text)
                own = [(s if k else ASSIGN.match(text, s).start(2), e, 1) for s, k, e in found]
                for spans in (own, [(s, e, 0) for s, e, *_ in candidates(text, found) if _HARMLESS.fullmatch(text, s, e)]):
                    for s, e, secret in spans[:A_ROW]:
                        low = max(0, s - AROUND)
                        out.append((text[low : e + AROUND], s - low, e - low, secret))
            data = [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(data, kinds, strict=True)], names=["text", "start", "stop", "secret"])

    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = chosen.select("text").mapInArrow(run, columns).collect()  # rows * 2 * A_ROW at most
    return sorted((r["text"], r["start"], r["stop"], r["secret"]) for r in found)


def train(findings: list[tuple[str, int, int, int]], recall: float = 0.98) -> CharNet:
    """findings: a bounded list; every fifth is held out for the calibration and the thresholds."""
    y = np.array([f[3] for f in findings], np.float32)
    held = np.arange(len(y)) % 10 < 2
    windows, labels = [], []
    for text, start, end, secret in (f for f, h in zip(findings, held, strict=True) if not h):
        windows.append(window(text, start, end))
        labels.append(secret)
        others = [f for f in base_spans(text) if not (f[0] < end and start < f[2])]
        for s, e, *_ in candidates(text, []):
            shared = min(e, end) - max(s, start)
            # a window that holds but a little of the value is neither, nor is one that holds another secret
            # what lies beside the finding has no label of its own, unless it is harmless by rule
            if (_HARMLESS.fullmatch(text, s, e) if shared <= 0 else not secret or shared >= min(end - start, STEP)) and (s, e) != (start, end) and not any(f[0] < e and s < f[2] for f in others):
                windows.append(window(text, s, e))
                labels.append(secret if shared > 0 else 0)
    net = CharNet()
    net.fit(codes(windows), np.array(labels, np.float32))
    best, known, kinds = np.full(len(y), -np.inf), np.zeros(len(y), bool), np.zeros(len(y), int)
    for i in np.flatnonzero(held):
        text, start, end, _ = findings[i]
        found = base_spans(text)
        known[i] = any(f[0] <= start and end <= f[2] for f in found)
        own = [(window(text, s, e), kind) for s, e, _, _, kind in candidates(text, found) if s < end and start < e]
        if own:
            best[i] = net.logits(codes([w for w, _ in own])).max()
            kinds[i] = max(kind for _, kind in own)
    # secrets that a base pattern finds are not the network's; those that no candidate holds count as missed
    mine = held & ~known
    net.calibrate(best[mine], y[mine], kinds[mine], recall)
    return net


def scan(texts: list[str], net: CharNet) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: (start, kind, end)."""
    spans, windows, where, hits = [], [], [], {}

    def score() -> None:
        for (i, s, e, kind), p in zip(where, net.scores(codes(windows)), strict=True):
            if p >= net.thresholds[kind]:
                hits.setdefault(i, []).append((s, e))
        windows.clear(), where.clear()

    for i, text in enumerate(texts):
        found = base_spans(text)
        spans.append(found)
        for s, e, first, last, kind in candidates(text, found):
            windows.append(window(text, s, e))
            where.append((i, first, last, kind))
            if len(windows) == SLICE:
                score()
    if windows:
        score()
    for i, found in hits.items():
        spans[i] = sorted(spans[i] + [(s, 3, e) for s, e in merged(found)])
    return spans


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, net: CharNet) -> DataFrame:
    """One row per input row: doc_id, counts by kind, digest of the base spans, all spans.

    Reads ``doc_id`` and ``text`` only; null counts as empty and has no spans. Positions count code points. Repeated
    rows are scanned alike; an empty table gives no rows. A batch holds 64 MB of text at most, or one text.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            every = [found for at in range(0, len(texts), 200) for found in scan(texts[at : at + 200], net)]
            n = [[sum(s[1] == k for s in found) for found in every] for k in range(4)]
            base = [hashlib.sha256(_joined(s for s in found if s[1] < 3).encode()).hexdigest() for found in every]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in n), pa.array(base, pa.string()), pa.array(map(_joined, every), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, SCHEMA)
