"""Quality: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed character n-grams is shared by all grades; ordered thresholds
cut the latent quality into grades: P(grade <= k) = logistic(threshold_k - weights . x). The
expected grade ranks documents, the tail probability P(grade >= k) selects them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm import ngrams
from siltbed.llm.batches import text_slices
from siltbed.llm.optimize import minimize

SIZES = (3, 4)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Model:
    """Shared weights over the hash buckets, and the grades with the thresholds between them."""

    buckets: np.ndarray
    weights: np.ndarray
    grades: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(ngrams.BUCKETS, np.float64)
        out[self.buckets] = self.weights
        return out

    def tails(self, texts: list[str | None], dense: np.ndarray | None = None) -> np.ndarray:
        """P(grade >= g) for every grade but the least; a column each."""
        z = ngrams.linear_scores(texts, self.dense() if dense is None else dense, SIZES, False)
        return _logistic(z[:, None] - self.thresholds[None])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades).astype(np.float64)


def fit(texts: list[str], ratings: np.ndarray, **options) -> Model:
    """As :func:`fit_sample`, on whole texts in memory."""
    return fit_sample(ngrams.Texts(texts, ratings, SIZES, False), **options)


def fit_sample(sample: ngrams.Texts | ngrams.Sample, min_docs: int = 4, min_z: float = 6.0, ridge: float = 10.0) -> Model:
    """Fits on whole texts with integer ratings. With one grade only there is no threshold."""
    grades, y = np.unique(sample.y, return_inverse=True)
    n, cuts = len(y), max(0, len(grades) - 1)
    if not cuts:
        return Model(np.zeros(0, np.int64), np.zeros(0), grades if len(grades) else np.zeros(1, np.int64), np.zeros(0))
    docs, total = sample.sums({g: i for i, g in enumerate(grades.tolist())})
    # How far the mean grade with a feature lies from the mean without it, in standard errors.
    seen = np.flatnonzero((docs >= min_docs) & (docs < n))
    held, total = docs[seen], total[seen]
    gap = total / held - (y.sum() - total) / (n - held)
    chosen = seen[np.abs(gap) >= min_z * np.sqrt((y.var() + 1e-12) * (1 / held + 1 / (n - held)))]
    x, k = sample.presence(chosen), len(chosen)
    share = np.cumsum(np.bincount(y, minlength=cuts + 1))[:-1] / n
    first = np.log(share / (1 - share))
    start = np.concatenate((np.zeros(k), first[:1], np.log(np.maximum(np.diff(first), 1e-3))))

    def unpack(v: np.ndarray) -> np.ndarray:
        return v[k] + np.concatenate(([0.0], np.cumsum(np.exp(np.minimum(v[k + 1 :], 50)))))

    def objective(v: np.ndarray) -> tuple[float, np.ndarray]:
        cut = np.concatenate(([-np.inf], unpack(v), [np.inf]))

        def slopes(margin: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            grade = y[texts]
            hi, lo = _logistic(cut[grade + 1] - margin), _logistic(cut[grade] - margin)
            p = np.maximum(hi - lo, 1e-12)
            return p, hi * (1 - hi) / p, lo * (1 - lo) / p

        def value(margin: np.ndarray, texts: np.ndarray) -> np.ndarray:
            _, d_hi, d_lo = slopes(margin, texts)
            return d_hi - d_lo

        margin, sums = x.step(v[:k], value)
        p, d_hi, d_lo = slopes(margin, np.arange(n))
        slope = sums + ridge * v[:k]
        d_cut = np.bincount(y, weights=-d_hi, minlength=cuts + 1)[:cuts] + np.bincount(y, weights=d_lo, minlength=cuts + 1)[1:]
        gaps = np.exp(np.minimum(v[k + 1 :], 50)) * (np.cumsum(d_cut[::-1])[::-1][1:])
        return -np.log(p).sum() + ridge * (v[:k] @ v[:k]) / 2, np.concatenate((slope, [d_cut.sum()], gaps))

    v = minimize(objective, start)
    return Model(chosen, v[:k], grades, unpack(v))


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = 2, max_rows: int = 6000) -> Model:
    """Fits on a sample of at most ``max_rows`` of the labelled rows outside the fold ``held_out``."""
    return fit_sample(ngrams.Sample(ngrams.training_sample(docs, labels, "quality", held_out, max_rows), SIZES, False))


def grade_documents(docs: DataFrame, model: Model, grade: int = 1, least: float = 0.5, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, selected) for every row of ``docs``.

    ``tail_probability`` is that of a grade of at least ``grade``, ``selected`` whether it
    reaches ``least``. Null and empty texts are graded as texts without features, repeated rows
    alike. A null doc_id is in no fold. An empty table gives an empty result.
    """
    at = int(np.searchsorted(model.grades[1:], grade))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for part in text_slices(batch, "text"):
                tails = model.tails(part.column("text").to_pylist(), dense)
                tail = tails[:, at] if at < tails.shape[1] else np.full(len(tails), float(model.grades[-1] >= grade))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("fold"), pa.array(model.expected(tails)), pa.array(tail)], names=["doc_id", "fold", "expected", "tail"])

    slim = docs.select(F.col("doc_id").cast("long"), (ngrams.fold(F.col("doc_id")) == held_out).alias("fold"), "text")
    out = slim.mapInArrow(kernel, "doc_id long, fold boolean, expected double, tail double")
    return out.select("doc_id", F.coalesce("fold", F.lit(False)).alias("held_out"), F.col("expected").alias("expected_grade"),
                      F.col("tail").alias("tail_probability"), (F.col("tail") >= least).alias("selected"))


def select_quality(docs: DataFrame, model: Model, grade: int = 1, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose grade is at least ``grade`` with probability ``least``, unchanged.

    A model that knows no grade as high keeps nothing less than it was taught: with a single
    training grade every row has that grade. Null and empty texts are graded as texts without
    features, repeated rows alike. An empty table gives an empty result.
    """
    at = int(np.searchsorted(model.grades[1:], grade))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for part in text_slices(batch, "text"):
                tails = model.tails(part.column("text").to_pylist(), dense)
                keep = tails[:, at] >= least if at < tails.shape[1] else np.full(len(tails), bool(model.grades[-1] >= grade))
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(kernel, docs.schema)
