"""Secrets in texts: fixed rules, and a character convolutional network over every candidate and its surroundings.

The rules (assignments, access keys, long hex) always stand. The network adds spans: a candidate is a maximal run of
``[A-Za-z0-9+/_.=-]`` with a digit and at least ``MIN_RUN`` characters once full stops and hyphens at its ends are gone.
Each candidate is read whole, in pieces of ``PIECE`` bytes, with ``BEFORE`` and ``AFTER`` bytes around it; its score is its
highest piece's. Candidates that overlap a rule's span are scored too, but add no span.

Labelled findings are those of the rules in at most about ``SAMPLE`` documents (chosen by hash of the id), other candidates of
these documents as ordinary ones, and made ones in real surroundings: tokens of public formats and ordinary identifiers of
public formats (``made_findings``). Every finding is also put into other surroundings, so that a value can speak for itself. Two thirds fit the network, one third calibrates it (a logistic curve on its score) and sets a threshold for each
shape of candidate: the most precise one that keeps ``RECALL`` of the calibration findings.

A null or empty text has no spans; texts of any length are read whole. Rows that repeat an id or a text are scanned one by
one, equal texts alike; spans that start together are ordered by kind. An empty table gives no rows, and a model of the made
findings alone. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import settle, small_batches

MIN_RUN = 12
PIECE, BEFORE, AFTER = 48, 24, 8
WIDTH = BEFORE + PIECE + AFTER
#: Documents whose findings are labelled examples, about; at most twice as many.
SAMPLE = 20_000
#: Labelled examples of a kind at most.
EXAMPLES = 2_000
RECALL = 0.95
KINDS = ("assign", "access", "hex", "model")

# The rules of the query's contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Every match of ASSIGN holds one of these, in small letters.
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

_ALL = string.ascii_letters + string.digits + "+/_.=-"


def _table(chars: str) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(chars.encode())] = True
    return held


_IN_RUN, _IN_HEX, _IS_DIGIT = _table(_ALL), _table("0123456789abcdef"), _table(string.digits)
#: Byte to symbol: ASCII as it is, 128 for other bytes; 129 stands beyond the text.
_SYMBOL = np.minimum(np.arange(256), 128).astype(np.int16)
OUTSIDE, SYMBOLS = 129, 130
#: A symbol before, within and after the candidate is not the same.
_REGION = np.repeat([0, SYMBOLS, 2 * SYMBOLS], [BEFORE, PIECE, AFTER]).astype(np.int16)


def runs(data: np.ndarray, held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``held`` with ``least`` bytes or more."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = held[data]
    turns = np.flatnonzero(np.diff(inside))
    start, end = turns[::2], turns[1::2]
    long = end - start >= least
    return start[long], end[long]


class Scan:
    """The texts of a batch as one line of bytes, with the rules' spans and the candidates of all."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        # a line feed is in no run, so none leads from a text to the next
        self.data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.last = self.first + sizes - 1
        # code points before each byte
        points = np.cumsum((self.data & 0xC0) != 0x80)
        self.points = np.append(0, points)
        self.spans: list[tuple[int, int, int, int]] = []
        start, end = runs(self.data, _IN_HEX, MIN_HEX)
        self._rule(2, start, end)
        for d, (text, r) in enumerate(zip(texts, raw, strict=True)):
            if b"AKIA" in r:
                self._matches(1, d, [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS])
            low = r.lower()
            if any(w in low for w in WORDS):
                self._matches(0, d, [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN])
        start, end = runs(self.data, _IN_RUN, MIN_RUN)
        digits = np.append(0, np.cumsum(_IS_DIGIT[self.data]))
        start, end = (x[digits[end] > digits[start]] for x in (start, end))
        start, end = self._trim(start, end)
        self.start, self.end, self.doc = start, end, self._docs(start)

    def _docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def _trim(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, drop = start.copy(), end.copy(), _table(".-")
        while len(move := np.flatnonzero((end > start) & drop[self.data[np.maximum(end - 1, 0)]])):
            end[move] -= 1
        while len(move := np.flatnonzero((end > start) & drop[self.data[np.minimum(start, len(self.data) - 1)]])):
            start[move] += 1
        long = end - start >= MIN_RUN
        return start[long], end[long]

    def _rule(self, kind: int, start: np.ndarray, end: np.ndarray) -> None:
        doc = self._docs(start)
        base = self.points[self.first[doc]] if len(doc) else doc
        for d, a, b in zip(doc.tolist(), (self.points[start] - base).tolist(), (self.points[end] - base).tolist(), strict=True):
            self.spans.append((d, a, kind, b))

    def _matches(self, kind: int, doc: int, spans: list[tuple[int, int]]) -> None:
        self.spans += [(doc, a, kind, b) for a, b in spans]

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end of every candidate; the latter in code points of their text."""
        base = self.points[self.first[self.doc]] if len(self.doc) else self.doc
        return self.doc, self.points[self.start] - base, self.points[self.end] - base

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """A row of symbols for each piece of each candidate, and the candidate it belongs to."""
        pieces = -(-(self.end - self.start) // PIECE)
        owner = np.repeat(np.arange(len(pieces)), pieces)
        at = self.start[owner] + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        return self._symbols(at, np.minimum(at + PIECE, self.end[owner]), self.doc[owner]), owner

    def surroundings(self) -> np.ndarray:
        """A row of symbols for one place of each text that isn't empty, chosen by its bytes; nothing stands at the place."""
        held = np.flatnonzero(self.last > self.first)
        place = [zlib.crc32(self.data[a:b].tobytes()) % (b - a) for a, b in zip(self.first[held].tolist(), self.last[held].tolist(), strict=True)]
        at = self.first[held] + np.array(place, np.int64)
        return self._symbols(at, at, held)

    def _symbols(self, at: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
        offset = np.arange(WIDTH)
        spot = at[:, None] - BEFORE + offset
        # what follows stands behind the piece's end, however short the piece is
        spot[:, BEFORE + PIECE:] = end[:, None] + offset[:AFTER]
        low, high = self.first[doc][:, None], self.last[doc][:, None]
        gone = (spot < low) | (spot >= high)
        gone[:, BEFORE:BEFORE + PIECE] |= spot[:, BEFORE:BEFORE + PIECE] >= end[:, None]
        symbols = _SYMBOL[self.data[np.where(gone, 0, spot)]]
        symbols[gone] = OUTSIDE
        return symbols


def by_rules(candidates: tuple[np.ndarray, np.ndarray, np.ndarray], spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Whether a rule's span overlaps the candidate."""
    doc, start, end = candidates
    held: dict[int, list[tuple[int, int]]] = {}
    for d, a, _, b in spans:
        held.setdefault(d, []).append((a, b))
    return np.array([any(a < e and s < b for a, b in held.get(d, ())) for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)], bool)


def shapes(windows: np.ndarray) -> np.ndarray:
    """Shape of a piece: 0 digits and marks only, 1 letters of one case, 2 letters of both."""
    value = windows[:, BEFORE:BEFORE + PIECE]
    upper = ((value >= 65) & (value <= 90)).any(1)
    lower = ((value >= 97) & (value <= 122)).any(1)
    return upper.astype(int) + lower


@dataclass
class Network:
    """Convolution of ``TAPS`` symbols, largest and mean activation by region, one hidden layer; then calibration and thresholds."""

    taps: list[np.ndarray]
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (0.5, 0.5, 0.5)

    REGIONS = ((0, BEFORE), (BEFORE, BEFORE + PIECE), (BEFORE + PIECE, WIDTH))

    def features(self, windows: np.ndarray):
        ids = windows + _REGION
        size = len(self.taps)
        padded = np.concatenate([ids, np.full((len(ids), size - 1), OUTSIDE + 2 * SYMBOLS, ids.dtype)], 1)
        sums = self.bias + sum(tap[padded[:, k:k + WIDTH]] for k, tap in enumerate(self.taps))
        active = np.maximum(sums, 0)
        largest = [(a, active[:, a:b].argmax(1)) for a, b in self.REGIONS]
        rows, filters = np.arange(len(ids))[:, None], np.arange(len(self.bias))[None, :]
        at = [a + i for a, i in largest]
        tops = [active[rows, i, filters] for i in at]
        here = (windows[:, BEFORE:BEFORE + PIECE] != OUTSIDE)[:, :, None]
        mean = (active[:, BEFORE:BEFORE + PIECE] * here).sum(1) / PIECE
        return padded, active, at, here, np.concatenate([*tops, mean], 1)

    def logit(self, windows: np.ndarray) -> np.ndarray:
        found = []
        for i in range(0, len(windows), 512):
            x = self.features(windows[i:i + 512])[-1]
            found.append(np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias)
        return np.concatenate(found) if found else np.zeros(0)

    def score(self, windows: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * self.logit(windows) + self.shift, -40, 40))), 6)


TAPS, FILTERS, HIDDEN = 4, 16, 24


def train(windows: np.ndarray, secret: np.ndarray, epochs: int = 16, seed: int = 11) -> Network:
    """Fit the network by Adam on cross-entropy; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    net = Network(
        [rng.normal(0, 0.25, (3 * SYMBOLS, FILTERS)) for _ in range(TAPS)], np.zeros(FILTERS),
        rng.normal(0, 0.2, (4 * FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), 0.0,
    )
    out_bias = np.zeros(1)
    params = [*net.taps, net.bias, net.hidden, net.hidden_bias, net.out, out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = secret.mean()
    weight = np.where(secret, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), 64):
            pick = order[i:i + 64]
            padded, active, at, here, x = net.features(windows[pick])
            h = np.maximum(x @ net.hidden + net.hidden_bias, 0)
            z = h @ net.out + out_bias[0]
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - secret[pick]) * weight[pick] / len(pick)
            dh = d[:, None] * net.out * (h > 0)
            dx = dh @ net.hidden.T
            da = np.zeros_like(active)
            rows, filters = np.arange(len(pick))[:, None], np.arange(FILTERS)[None, :]
            for r, spot in enumerate(at):
                da[rows, spot, filters] += dx[:, r * FILTERS:(r + 1) * FILTERS]
            da[:, BEFORE:BEFORE + PIECE] += here * dx[:, None, 3 * FILTERS:] / PIECE
            da *= active > 0
            flat = da.reshape(-1, FILTERS)
            used = np.flatnonzero(flat.any(1))
            grads = []
            for k in range(TAPS):
                g = np.zeros_like(net.taps[k])
                np.add.at(g, padded[:, k:k + WIDTH].reshape(-1)[used], flat[used])
                grads.append(g)
            grads += [flat.sum(0), x.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.out_bias = float(out_bias[0])
    return net


def calibrate(net: Network, windows: np.ndarray, secret: np.ndarray, recall: float = RECALL) -> Network:
    """A logistic curve on the scores of held-out findings, then a threshold for each shape that keeps ``recall`` of its secrets.

    Of the thresholds that keep enough the most precise one is taken, the highest among equals. A shape without held-out
    secrets takes that of all findings, or 0.5 if it is higher.
    """
    z, y = net.logit(windows), secret.astype(float)
    # targets a little inside 0 and 1 keep the curve finite where the classes part
    target = np.where(secret, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -40, 40)))
        w = p * (1 - p) + 1e-9
        # a weak pull to 1 keeps the slope finite where a line parts the classes
        gradient = np.array([((p - target) * z).sum() + (slope - 1), (p - target).sum()])
        hessian = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + np.diag([1, 1e-6])
        move = np.clip(np.linalg.solve(hessian, gradient), -0.5, 0.5)
        slope, shift = slope - move[0], shift - move[1]
        if abs(move).max() < 1e-7:
            break
    net.slope, net.shift = float(slope), float(shift)
    p, shape = net.score(windows), shapes(windows)

    def threshold(held: np.ndarray) -> float | None:
        good, best = np.sort(p[held & secret]), None
        if not len(good):
            return None
        for t in np.unique(good[: len(good) - int(np.ceil(recall * len(good))) + 1]):
            precise = secret[held & (p >= t)].mean()
            if best is None or precise >= best[0]:
                best = precise, float(t)
        return best[1]

    overall = threshold(np.ones(len(p), bool))
    net.thresholds = tuple(t if (t := threshold(shape == s)) is not None else max(overall or 0.5, 0.5) for s in range(3))
    return net


def made_findings(seed: int = 5, copies: int = 90) -> list[tuple[str, bool]]:
    """Values of public formats: tokens that grant access, and ordinary identifiers that don't, ``copies`` of each."""
    rng = random.Random(seed)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word, low, up = string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_uppercase
    digits, base64 = string.digits, string.ascii_letters + string.digits + "+/"
    # a repository host, a chat service, a payment service, a map service, a signed web token, a key of 40, a mail service, a package index
    secret = [
        lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + some(word, 36),
        lambda: rng.choice(["xoxb-", "xoxp-"]) + some(digits, 12) + "-" + some(digits, 12) + "-" + some(word, 24),
        lambda: rng.choice(["sk_live_", "rk_live_"]) + some(word, 24),
        lambda: "AIza" + some(word + "-_", 35),
        lambda: ".".join(["eyJ" + some(word, 33), "eyJ" + some(word, 60), some(word + "-_", 43)]),
        lambda: some(base64, 40),
        lambda: "SG." + some(word, 22) + "." + some(word, 43),
        lambda: "pypi-" + some(word, 60),
        lambda: some(word, rng.randint(20, 44)),
        lambda: some(up + digits, rng.randint(24, 40)),
    ]
    name = lambda: some(low, rng.randint(3, 9))
    plain = [
        lambda: "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        lambda: some(digits, rng.randint(12, 19)),
        lambda: "-".join(some(digits, n) for n in (3, 1, 5, 4, 1)),
        lambda: ".".join(some(digits, rng.randint(1, 3)) for _ in range(4)) + some(digits, 2),
        lambda: f"20{some(digits, 2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
        lambda: f"{name()}-{rng.randint(1, 20)}.{rng.randint(0, 40)}.{rng.randint(0, 9)}.tar.gz",
        lambda: "/".join([name(), name(), f"{name()}{rng.randint(1, 99)}.html"]),
        lambda: f"{name()}_{name()}_{rng.randint(1, 999)}_{name()}",
        lambda: f"{name()}.{name()}{rng.randint(1, 99)}.example.com",
        lambda: f"{name().upper()}-{some(digits, 4)}-{name().upper()}-{some(digits, 2)}",
        lambda: name() + name() + some(digits, 4),
        lambda: name().title() + name().title() + name().title() + some(digits, 1),
    ]
    return [(make(), y) for y, makers in ((True, secret), (False, plain)) for make in makers for _ in range(copies)]


def _split(key: str) -> int:
    return int.from_bytes(hashlib.sha256(key.encode()).digest()[:4], "big") % 3


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scan = Scan(batch.column("text").to_pylist())
        windows, owner = scan.windows()
        ruled = by_rules(scan.candidates(), scan.spans)[owner]
        around = scan.surroundings()
        kinds = np.where(ruled, RULED, ORDINARY).tolist() + [AROUND] * len(around)
        windows = np.concatenate([windows, around]).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"window": pa.array([w.tobytes() for w in windows], pa.binary()), "kind": pa.array(kinds, pa.int32())})


#: Kinds of examples: findings of the rules, other candidates, and surroundings of no candidate.
RULED, ORDINARY, AROUND = 0, 1, 2


def labelled_findings(docs: DataFrame, sample: int = SAMPLE, examples: int = EXAMPLES) -> list[list[bytes]]:
    """Windows of each kind in the sampled documents, at most ``examples`` of each, by hash."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = min(1.0, sample / max(docs.count(), 1))
    # a hash of both columns, so that an id that many rows share doesn't bring them all
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = chosen.select("text").limit(2 * sample).mapInArrow(_examples, "window binary, kind int").distinct()
    found = settle(found.withColumn("key", F.xxhash64("window")), "findings")
    return [[bytes(r["window"]) for r in found.where(F.col("kind") == k).orderBy("key", "window").limit(examples).collect()] for k in (RULED, ORDINARY, AROUND)]


def fit(docs: DataFrame, sample: int = SAMPLE, examples: int = EXAMPLES) -> Network:
    frames = [[np.frombuffer(w, np.uint8).astype(np.int16) for w in kind] for kind in labelled_findings(docs, sample, examples)]
    around = frames[AROUND] or [np.full(WIDTH, OUTSIDE, np.int16)]
    windows, secret, part = [], [], []

    def add(window: np.ndarray, y: bool, key: bytes) -> None:
        windows.append(window)
        secret.append(y)
        part.append(_split(key.hex()))

    def placed(window: np.ndarray, i: int) -> np.ndarray:
        """The value in other surroundings, of which some lack a side."""
        window, other = window.copy(), around[i % len(around)]
        window[:BEFORE] = OUTSIDE if i % 9 == 0 else other[:BEFORE]
        window[BEFORE + PIECE:] = OUTSIDE if i % 9 == 1 else other[BEFORE + PIECE:]
        if window[BEFORE - 1] != OUTSIDE and i % 2:
            window[BEFORE - 1] = ord(" ")
        return window

    for y, kind in ((True, frames[RULED]), (False, frames[ORDINARY])):
        for i, frame in enumerate(kind):
            add(frame, y, frame.tobytes())
            add(placed(frame, i), y, frame.tobytes())
    for i, (value, y) in enumerate(made_findings()):
        for window in Scan([value]).windows()[0][:3]:
            add(placed(window, 7 * i), y, value.encode())
            add(placed(window, 7 * i + 3), y, value.encode())
    windows, secret, part = np.array(windows), np.array(secret), np.array(part)
    net = train(windows[part > 0], secret[part > 0])
    return calibrate(net, windows[part == 0], secret[part == 0])


def find(texts: list[str | None], net: Network) -> list[list[tuple[int, int, int]]]:
    """The spans of each text: start, kind, end in code points, ordered."""
    scan = Scan(texts)
    spans = list(scan.spans)
    doc, start, end = scan.candidates()
    if len(doc):
        windows, owner = scan.windows()
        over = net.score(windows) - np.array(net.thresholds)[shapes(windows)]
        best = np.full(len(doc), -1.0)
        np.maximum.at(best, owner, over)
        ruled = by_rules((doc, start, end), spans)
        spans += [(int(doc[i]), int(start[i]), 3, int(end[i])) for i in np.flatnonzero((best >= 0) & ~ruled)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, a, kind, b in sorted(spans):
        out[d].append((a, kind, b))
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and the spans of every text: kind, start, end."""
    spark = docs.sparkSession
    small_batches(spark)
    given = spark.sparkContext.broadcast(net)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(batch.column("text").to_pylist(), given.value)
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in row] for row in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, spans {SPANS}")


def digests(docs: DataFrame, net: Network) -> DataFrame:
    """Counts of the rules' spans, their digest, and all spans as one string."""
    spans = scan(docs, net)
    joined = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
