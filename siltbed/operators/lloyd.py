"""Weighted Lloyd iterations over tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.operators import cost as costs
from siltbed.operators import sampling


@dataclass(frozen=True)
class Model:
    """Ordered centres, their weighted SSE on the points they were fitted to, and the iterations run."""

    centers: list[list[float]]
    cost: float
    iterations: int

    @property
    def k(self) -> int:
        return len(self.centers)

    def ordered(self) -> list[list[float]]:
        """The centres by their first coordinate, then the others: an order that doesn't hang on seeds."""
        return sorted(self.centers)

    def frame(self, like: DataFrame) -> DataFrame:
        return costs.centers_frame(like, self.centers)


def step(points: DataFrame, centers: list[list[float]]) -> DataFrame:
    """(cid, j, v): the coordinates of the new centres; a cluster without points or mass keeps its old one."""
    new, _ = fused_step(points, np.array(centers, np.float64))
    return points.sparkSession.createDataFrame([(i, j, v) for i, c in enumerate(new.tolist()) for j, v in enumerate(c)], "cid int, j int, v double")


def step_relational(points: DataFrame, centers: list[list[float]]) -> DataFrame:
    """As :func:`step`, as one relational plan that explodes coordinates: its twin for SQL engines."""
    sums = costs.assign(points, centers).select("cid", "w", F.posexplode("x").alias("j", "v")).groupBy("cid", "j").agg(
        F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("m"))
    old = costs.centers_frame(points, centers).select("cid", F.posexplode("c").alias("j", "old"))
    new = old.join(sums, ["cid", "j"], "left")
    return new.select("cid", "j", F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(F.col("old")).alias("v"))


def fused_step(points: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, float]:
    """The new centres and the cost of the old ones, in one pass: k partial rows per task, summed by cluster."""
    d = centers.shape[1]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, mass, total = np.zeros((len(centers), d)), np.zeros(len(centers)), np.zeros(len(centers))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = costs.flat(batch.column("x")), batch.column("w").to_numpy()
            d2 = costs.distances(x, centers)
            cid = d2.argmin(axis=1)
            mass += np.bincount(cid, weights=w, minlength=len(centers))
            total += np.bincount(cid, weights=w * d2[np.arange(len(x)), cid], minlength=len(centers))
            for j in range(d):
                sums[:, j] += np.bincount(cid, weights=w * x[:, j], minlength=len(centers))
        hit = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(mass[hit]), pa.array(total[hit]), pa.array(sums[hit].tolist(), pa.list_(pa.float64()))], names=["cid", "m", "c", "s"])

    parts = points.select("x", "w").mapInArrow(kernel, "cid int, m double, c double, s array<double>")
    summed = parts.groupBy("cid").agg(F.sum("m").alias("m"), F.sum("c").alias("c"), *[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(d)])
    new, total = centers.copy(), 0.0
    for r in summed.collect():  # at most k rows
        total += r["c"]
        if r["m"] > 0:
            new[r["cid"]] = [r[f"s{j}"] / r["m"] for j in range(d)]
    return new, total


def lloyd(points: DataFrame, start: list[list[float]], max_iter: int = 100, tol: float = 1e-6) -> Model:
    """Iterates on the full table, which the caller caches; one job per iteration.

    Stops once the cost falls by at most ``tol`` times the one before, after moving the centres
    a last time; ``max_iter`` 0 returns the start.
    """
    centers, before, done = np.array(start, np.float64), np.inf, 0
    for done in range(1, max_iter + 1):
        centers, now = fused_step(points, centers)
        if now > before * (1 + 1e-9):
            raise ArithmeticError("the cost rose")
        if before - now <= tol * max(before if np.isfinite(before) else 0.0, 1e-300):
            break
        before = now
    return Model(centers.tolist(), costs.cost(points, centers.tolist()), done)


def fit(points: DataFrame, k: int, restarts: int = 5, max_iter: int = 100, tol: float = 1e-6, seed: int = 42, key: str = "id") -> Model:
    """The best of several seeded runs on the full table; of equally good ones the first."""
    if restarts < 1:
        raise ValueError("restarts must be positive")
    best = None
    for r in range(restarts):
        model = lloyd(points, sampling.seed_centers(points, k, seed * 1_000_003 + r, key), max_iter, tol)
        if best is None or model.cost < best.cost:
            best = model
    return best
