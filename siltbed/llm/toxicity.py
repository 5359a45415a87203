"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence features are multiplied by the log ratio of their smoothed shares in toxic and clean
training documents; a ridge logistic regression on the scaled features gives the score.
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

SIZES = (4, 5, 6, 7, 8)


@dataclass
class Model:
    """Weights over the hash buckets, already multiplied by the log-count ratios."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(ngrams.BUCKETS, np.float64)
        out[self.buckets] = self.weights
        return out

    def score(self, texts: list[str | None], dense: np.ndarray | None = None) -> np.ndarray:
        z = self.intercept + ngrams.linear_scores(texts, self.dense() if dense is None else dense, SIZES, True)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(texts: list[str], y: np.ndarray, **options) -> Model:
    """As :func:`fit_sample`, on whole texts in memory."""
    return fit_sample(ngrams.Texts(texts, y, SIZES, True), **options)


def fit_sample(sample: ngrams.Texts | ngrams.Sample, alpha: float = 0.5, min_docs: int = 4, min_z: float = 4.0, ridge: float = 1.0) -> Model:
    """Fits on whole texts with labels 0 and 1. With one class only, the score is its share, smoothed."""
    y = sample.y.astype(np.float64)
    n1, n = float(y.sum()), len(y)
    base = float(np.log((n1 + alpha) / (n - n1 + alpha)))
    if n1 in (0.0, float(n)):
        return Model(np.zeros(0, np.int64), np.zeros(0), base)
    docs, pos = sample.sums({v: v for v in np.unique(sample.y).tolist()})
    seen = np.flatnonzero(docs >= min_docs)
    p, q = pos[seen] + alpha, docs[seen] - pos[seen] + alpha
    ratio = np.log(p / (n1 + 2 * alpha)) - np.log(q / (n - n1 + 2 * alpha))
    clear = np.abs(ratio / np.sqrt(1 / p + 1 / q)) >= min_z
    chosen, ratio = seen[clear], ratio[clear]
    x, k = sample.presence(chosen), len(chosen)

    def objective(v: np.ndarray) -> tuple[float, np.ndarray]:
        b = v[k]

        def error(margin: np.ndarray, texts: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(margin + b, -500, 500))) - y[texts]

        margin, sums = x.step(ratio * v[:k], error)
        err = error(margin, np.arange(n))
        margin = margin + b
        loss = np.logaddexp(0, margin) - y * margin
        slope = ratio * sums + ridge * v[:k]
        return loss.sum() + ridge * (v[:k] @ v[:k]) / 2, np.append(slope, err.sum())

    solution = minimize(objective, np.append(np.zeros(k), base))
    w, b = solution[:k], solution[k]
    keep = w != 0
    return Model(chosen[keep], (w * ratio)[keep], float(b))


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = 2, max_rows: int = 6000) -> Model:
    """Fits on a sample of at most ``max_rows`` of the labelled rows outside the fold ``held_out``."""
    return fit_sample(ngrams.Sample(ngrams.training_sample(docs, labels, "toxic", held_out, max_rows), SIZES, True))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; only the text is scored.

    Null and empty texts score as texts without features. Repeated rows score alike. A null
    doc_id is in no fold (held_out false). An empty table gives an empty result.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for part in text_slices(batch, "text"):
                score = model.score(part.column("text").to_pylist(), dense)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("fold"), pa.array(score)], names=["doc_id", "fold", "score"])

    slim = docs.select(F.col("doc_id").cast("long"), (ngrams.fold(F.col("doc_id")) == held_out).alias("fold"), "text")
    scored = slim.mapInArrow(kernel, "doc_id long, fold boolean, score double")
    return scored.select("doc_id", F.coalesce("fold", F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, unchanged.

    Null and empty texts score as texts without features; repeated rows stay or go together. An empty
    table gives an empty result. Columns other than the text aren't looked at.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield part.filter(pa.array(model.score(part.column("text").to_pylist(), dense) < threshold))

    return docs.mapInArrow(kernel, docs.schema)
