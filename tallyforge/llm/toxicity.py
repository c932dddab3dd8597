"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all ordered
thresholds theta_1 < theta_2 < theta_3. The outcome is the expected severity,
the sum over k of P(grade >= k), from 0 to 3.

Labels only say toxic or not. The training grade of a clean document is 0. That of a
toxic one, 1 to 3, is the tercile of its severity among toxic documents, as judged
by a two-grade model fitted on the other half of the labelled rows: a document has
no part in the fit that grades it for training, nor have counts of its features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import settle, small_batches, text_of

WORD = re.compile(r"\w+")
PREFIXES = (4, 5)


@dataclass(frozen=True)
class ToxicityParams:
    """``labelled_bound`` bounds the rows the model is fitted on, ``vocabulary`` its features."""

    labelled_bound: int = 20_000
    vocabulary: int = 4_096
    min_docs: int = 6
    #: least likelihood ratio statistic (G) of a feature against the label, typical of toxic documents or of clean ones
    min_g: float = 20.0
    l2: float = 1e-3
    steps: int = 400


@dataclass
class OrdinalModel:
    """Weights by feature and the ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (1.0, 2.0, 3.0)
    #: least P(grade >= 1) of a toxic document
    cut: float = 0.5

    def grades(self, eta: float) -> list[float]:
        """P(grade >= k) for k = 1, 2, 3."""
        return [1 / (1 + math.exp(max(-500.0, min(500.0, t - eta)))) for t in self.thresholds]


def features_of(text: str, known: frozenset[str] | None = None) -> dict[str, int]:
    """Counts of words and of their beginnings; only ``known`` ones if given."""
    out: dict[str, int] = {}
    for w, n in Counter(WORD.findall(text.lower())).items():
        for f in (w, *(f"{w[:k]}*" for k in PREFIXES if len(w) > k)):
            if known is None or f in known:
                out[f] = out.get(f, 0) + n
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> DataFrame:
    """``text, toxic, half`` of at most ``labelled_bound`` labelled documents, in the order of a hash of their id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = rows.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(params.labelled_bound)
    ids = settle(ids, "toxicity-sample")
    half = F.pmod(F.xxhash64("doc_id", F.lit(33)), F.lit(2)).cast("int").alias("half")
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic", half)


def _count(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(features_of(text).keys())
        names = list(toxic.keys() | clean.keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], names=["feature", "toxic", "clean"])

    return rows.mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> OrdinalModel:
    """Fit on the labelled sample. Without toxic or without clean examples, nothing counts as toxic."""
    small_batches(docs.sparkSession)
    rows = settle(labelled_sample(docs, labels, params), "toxicity-rows")
    sizes = {int(bool(r["toxic"])): r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return OrdinalModel()
    cell = lambda seen, share: seen * F.log(F.greatest(seen, F.lit(1e-9)) / share)
    n_toxic, n_clean = sizes[1], sizes[0]
    n, toxic, clean = n_toxic + n_clean, F.col("toxic").cast("double"), F.col("clean").cast("double")
    has, lacks = (toxic + clean) / n, 1 + 1e-12 - (toxic + clean) / n
    g = 2 * (cell(toxic, has * n_toxic) + cell(clean, has * n_clean) + cell(n_toxic - toxic, lacks * n_toxic) + cell(n_clean - clean, lacks * n_clean))
    chosen = _count(rows).where(F.greatest("toxic", "clean") >= params.min_docs).withColumn("g", g).where(F.col("g") >= params.min_g)
    names = [r["feature"] for r in chosen.orderBy(F.desc("g"), "feature").limit(params.vocabulary).collect()]
    known = frozenset(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(t, known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))], names=["toxic", "half", "features", "counts"])

    sparse = rows.mapInArrow(run, f"toxic {dict(rows.dtypes)['toxic']}, half int, features array<string>, counts array<long>").collect()
    at = {x: i for i, x in enumerate(names)}
    toxic, half = np.array([bool(r["toxic"]) for r in sparse]), np.array([r["half"] for r in sparse])
    doc = np.array([i for i, r in enumerate(sparse) for _ in r["features"]], dtype=np.int64)
    col = np.array([at[x] for r in sparse for x in r["features"]], dtype=np.int64)
    val = np.array([1 + math.log(n) for r in sparse for n in r["counts"]])
    grade = training_grades(doc, col, val, toxic, half, len(names), params)
    weights, thresholds = fit_ordinal(doc, col, val, grade, len(names), params)
    eta = np.bincount(doc, weights[col] * val, minlength=len(toxic))
    cut = best_cut(1 / (1 + np.exp(thresholds[0] - eta)), toxic)
    return OrdinalModel({x: float(w) for x, w in zip(names, weights, strict=True) if w}, tuple(map(float, thresholds)), cut)


def training_grades(doc: np.ndarray, col: np.ndarray, val: np.ndarray, toxic: np.ndarray, half: np.ndarray, width: int, params: ToxicityParams) -> np.ndarray:
    """0 for clean rows, 1 to 3 for toxic ones, by terciles of what the model of the other half says. Ties share the lower grade."""
    severity = np.zeros(len(toxic))
    for k in (0, 1):
        use = half != k
        if not (use & toxic).any() or not (use & ~toxic).any():
            use = np.ones(len(toxic), bool)  # too few rows to part
        place = np.cumsum(use) - 1
        own = use[doc]
        w, _ = fit_ordinal(place[doc[own]], col[own], val[own], toxic[use].astype(np.int64), width, params, top=1)
        severity[half == k] = np.bincount(doc, w[col] * val, minlength=len(toxic))[half == k]
    low, high = np.quantile(severity[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (severity > low) + (severity > high), 0)


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the largest sum of both rates on the fitted rows, in the middle of its gap; from 0.3 to 0.5,
    since labels hold some noise and clean documents weigh more."""
    order = np.argsort(p, kind="stable")
    p, toxic = p[order], toxic[order]
    gain = np.r_[0, np.cumsum(np.where(toxic, -1 / toxic.sum(), 1 / (~toxic).sum()))]
    edges = np.r_[0.0, (p[1:] + p[:-1]) / 2, 1.0]
    # between equal scores there is no cut
    gain[1:-1][p[1:] == p[:-1]] = -np.inf
    return float(np.clip(edges[int(gain.argmax())], 0.3, 0.5))


def fit_ordinal(doc: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, width: int, params: ToxicityParams, top: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with an L2 penalty by Adam, for grades 0 to ``top``. Thresholds are a first value and positive steps, so they stay ordered."""
    n = len(grade)
    w, free = np.zeros(width), np.r_[1.0, np.zeros(top - 1)]
    m, v = np.zeros(width + top), np.zeros(width + top)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, params.steps + 1):
        theta = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        eta = np.bincount(doc, w[col] * val, minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = sig(edges[grade + 1] - eta), sig(edges[grade] - eta)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_eta = (du - dl) / n
        g_theta = np.array([(-du[grade == k].sum() + dl[grade == k + 1].sum()) / n for k in range(top)])
        g_w = np.bincount(col, g_eta[doc] * val, minlength=width) + params.l2 * w / 10
        g_free = np.array([g_theta.sum(), *(g_theta[k:].sum() * math.exp(free[k]) for k in range(1, top))])
        g = np.concatenate([g_w, g_free])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, free = w - move[:width], free - move[width:]
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def grade(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with ``severity`` (0 to 3), ``grade``, ``p_toxic`` and ``toxic`` added; every row, whole texts.

    A null or empty text has no features: the model's base rate. Texts of any length are read whole; equal texts have
    equal grades, repeated rows are graded one by one. A probability equal to a cut counts as above it. Columns of these
    names are replaced; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int, p_toxic double, toxic boolean")
    def run(texts):
        import pandas as pd

        own = sent.value
        known = frozenset(own.weights)
        stems = frozenset(x[:-1] for x in known if x.endswith("*"))
        rows = []
        for text in texts:
            eta = 0.0
            words = WORD.findall((text or "").lower())
            near = [w for w in set(words) if w in known or w[:4] in stems or w[:5] in stems]
            if near:
                found = features_of(" ".join(w for w in words if w in frozenset(near)), known)
                eta = sum(own.weights[f] * (1 + math.log(n)) for f, n in sorted(found.items()))
            p = own.grades(eta)
            rows.append((sum(p), sum(x >= 0.5 for x in p), p[0], p[0] >= own.cut))
        return pd.DataFrame(rows, columns=["severity", "grade", "p_toxic", "toxic"])

    names = [c for c in docs.columns if c not in ("severity", "grade", "p_toxic", "toxic")]
    return docs.select(*names, run(docs["text"]).alias("_g")).select(*names, "_g.*")


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` that ``grade`` does not call toxic, all columns."""
    names = docs.columns
    graded = grade(docs.select(F.struct(*names).alias("_row"), "text"), model)
    return graded.where("not toxic").select("_row.*").select(*names)
