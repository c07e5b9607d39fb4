"""Quality classifier by positive-unlabelled learning.

Trusted positives are the learning rows labelled good; everything else is
unlabelled web text, whose hidden labels are never used.  A linear model over
binned text features minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with logistic loss.  The class prior is estimated first: a plain classifier of
positives against unlabelled text ranks both, and the prior is the smallest
ratio of unlabelled to positive mass above any cut, on rows it was not fitted to.

The model is fitted on at most ``SAMPLE`` rows of each kind, drawn by a hash of
the id; all rows are scored.  Labels, language, source and id are never inputs.

Defined results: null, empty and blank texts have all-zero features and get a
score like any other; repeated rows get equal scores; without positives or
without unlabelled rows the score is the prior guess 0.5; an empty table gives
an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import byte_buffer, list_column, map_batches, owner, slices, words, written

SAMPLE = 20_000
BINS = 16
SLICE_BYTES = 1 << 19
STEPS, RATE, PENALTY = 300, 0.05, 1e-3

_CLASSES = {
    "upper": [range(65, 91)], "digit": [range(48, 58)], "bang": [b"!?"], "bar": [b"|"], "symbol": [b"#$%&*+=<>@^_~\\{}[]"],
    "mark": [b".,;:'\"()-"], "line": [b"\n"], "blank": [b" \t"], "wide": [range(128, 256)],
}
_MASKS = np.zeros((len(_CLASSES), 256), np.float32)
for _i, _parts in enumerate(_CLASSES.values()):
    for _p in _parts:
        _MASKS[_i, list(_p)] = 1
N_FEATURES = len(_CLASSES) + 8
WEIGHTS = N_FEATURES * (BINS + 1) + 1


def _per(doc: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(np.float64) if len(doc) else np.zeros(n)


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    if not len(doc):
        return np.zeros(n)
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])]
    return _per(d[new], None, n)


def features(column: pa.Array) -> np.ndarray:
    """(texts x N_FEATURES) shares of character classes and of repeated words."""
    data, offsets = byte_buffer(column)
    out = np.zeros((len(offsets) - 1, N_FEATURES), np.float32)
    for i, j in slices(offsets, SLICE_BYTES):
        n, part, own = j - i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        size = np.maximum(np.diff(own), 1)
        rows = out[i:j]
        at = np.repeat(np.arange(n), np.diff(own))
        counts = np.bincount(at * 256 + part, minlength=n * 256).reshape(n, 256) if len(part) else np.zeros((n, 256))
        rows[:, :len(_CLASSES)] = (counts @ _MASKS.T) / size[:, None]
        s, e, h = words(part, own)
        doc = owner(own, s)
        w = _per(doc, None, n)
        many = np.maximum(w, 1)
        pair = doc[1:] == doc[:-1]
        again = pair & (h[1:] == h[:-1])
        two = (h[1:] * np.uint64(0xA0761D6478BD642F) + h[:-1])[pair]
        rows[:, len(_CLASSES):] = np.stack([
            np.log1p(w), _per(doc, (e - s).astype(float), n) / many, _distinct(doc, h, n) / many,
            _distinct(doc[1:][pair], two, n) / many, _per(doc[1:][again], None, n) / many,
            _per(doc[e - s == 1], None, n) / many, _per(doc[e - s > 20], None, n) / many,
            (counts > 0).sum(axis=1) / np.minimum(size, 256)], axis=1)
    return out


def _design(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Per row the index of the bin of every feature, and of the constant."""
    n, f = x.shape
    out = np.full((n, f + 1), f * (BINS + 1), np.int32)
    for k in range(f):
        out[:, k] = k * (BINS + 1) + np.searchsorted(cuts[k], x[:, k])
    return out


def _value(design: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w[design].sum(axis=1)


def _back(design: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Sum of g over the rows of each bin."""
    return np.bincount(design.ravel(), weights=np.repeat(g, design.shape[1]), minlength=WEIGHTS)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _descend(gradient) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(WEIGHTS), np.zeros(WEIGHTS), np.zeros(WEIGHTS)
    for t in range(1, STEPS + 1):
        g = gradient(w) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from a classifier of one against the other."""
    p1, p2, u1, u2 = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]
    if not len(p2) or not len(u2):
        return 0.5
    w = _descend(lambda w: _back(p1, _sigmoid(_value(p1, w)) - 1) / len(p1) + _back(u1, _sigmoid(_value(u1, w))) / len(u1))
    a, b = np.sort(_value(p2, w)), np.sort(_value(u2, w))
    cut = np.quantile(a, np.linspace(0, 0.9, 91))
    above = lambda x: 1 - np.searchsorted(x, cut) / len(x)
    return float(np.clip((above(b) / np.maximum(above(a), 1e-9)).min(), 0.01, 0.99))


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative unbiased risk."""
    loss = lambda z: np.logaddexp(0, z)  # noqa: E731  of calling a row positive

    def gradient(w):
        zp, zu = _value(positive, w), _value(unlabelled, w)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        g_pos = prior * _back(positive, sp - 1) / len(zp)
        g_neg = _back(unlabelled, su) / len(zu) - prior * _back(positive, sp) / len(zp)
        negative = loss(zu).mean() - prior * loss(zp).mean()
        # a negative empirical risk is overfitting: step back out of it
        return g_pos + g_neg if negative >= 0 else -g_neg

    return _descend(gradient)


def zero_one_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The highest score at which the non-negative risk of 0-1 loss is least."""
    t = np.unique(np.concatenate([positive, unlabelled]))
    t = (t[1:] + t[:-1]) / 2 if len(t) > 1 else t
    missed = np.searchsorted(np.sort(positive), t) / len(positive)
    called = 1 - np.searchsorted(np.sort(unlabelled), t) / len(unlabelled)
    risk = prior * missed + np.maximum(0, called - prior * (1 - missed))
    return float(t[risk <= risk.min() + 1e-12].max())


@dataclass
class QualityModel:
    cuts: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(column), 0.5)
        return _sigmoid(_value(_design(features(column), self.cuts), self.weights))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Fit on trusted positives (``label_col`` = 1 among the label rows that ``learn`` admits)
    and unlabelled texts, at most ``sample`` of each, the least hashes of ids first."""
    trusted = (labels.filter(learn & (F.col(label_col) == 1)).select(F.col(id_col).alias("id")).filter("id is not null").distinct())
    draw = F.xxhash64(F.col("id"), F.lit("quality"))
    # a hash threshold keeps about twice the sample; the exact bound follows on small rows
    share = lambda n: F.pmod(draw, F.lit(1 << 20)) < int((1 << 20) * min(1.0, 2 * sample / max(n, 1)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_docs, n_trusted = docs.count(), trusted.count()
    picked = trusted.filter(share(n_trusted))
    positives = rows.join(F.broadcast(picked) if n_trusted <= 1_000_000 or sample <= 100_000 else picked, "id")
    unlabelled = rows.filter(share(n_docs))
    drawn = written(positives.select("id", "text", F.lit(1).alias("kind"))
                    .unionByName(unlabelled.select("id", "text", F.lit(0).alias("kind"))), "quality-sample")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), list_column(
                x.ravel(), np.full(len(b), N_FEATURES), pa.float32())], names=["id", "kind", "x"])

    described = written(map_batches(drawn, describe, "id string, kind int, x array<float>"), "quality-features")
    sides = []
    for kind in (1, 0):
        got = described.filter(F.col("kind") == kind).orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
        sides.append(np.array(got["x"].tolist(), np.float32).reshape(len(got), N_FEATURES))
    p, u = sides
    if not len(p) or not len(u):
        return QualityModel(np.zeros((N_FEATURES, 0)), np.zeros(0), 0.5)
    cuts = np.quantile(np.concatenate([p, u]), np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    dp, du = _design(p, cuts), _design(u, cuts)
    prior = estimate_prior(dp, du)
    weights = fit_risk(dp, du, prior)
    # a prior that is off shifts all scores alike; the cut of least 0-1 risk goes to 0.5
    weights[-1] -= zero_one_cut(_value(dp, weights), _value(du, weights), prior)
    return QualityModel(cuts, weights, prior)


def add_score(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """(row: all columns of docs, ``out``: probability of good quality)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)), pa.float64())], names=["row", out])

    return map_batches(rows, run, f"row {kind}, `{out}` double")


def score_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 parts: int = 3, held: int = 1) -> DataFrame:
    """id, held_out, score, predicted; rows of fold ``held`` of ``parts`` are never learnt from."""
    model = fit(docs, labels, fold(id_col, parts) != held, id_col, text_col)
    return (add_score(docs.select(id_col, text_col), model, text_col)
            .select(F.col(f"row.{id_col}").alias(id_col), "score")
            .select(id_col, (fold(id_col, parts) == held).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              parts: int = 3, held: int = 1) -> DataFrame:
    """The rows whose score is at least 0.5, with all their columns."""
    model = fit(docs, labels, fold(id_col, parts) != held, id_col, text_col)
    return add_score(docs, model, text_col).filter("score >= 0.5").select(*[F.col("row")[c].alias(c) for c in docs.columns])
