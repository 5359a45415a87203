"""Weighted sums of squared distances, in three physical forms with one result.

The expression stays inside one generated stage, the join is the relational reading, and the
Arrow kernel is the fastest where Python workers already run. Each sums partially per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions import vectors

Centers = Sequence[Sequence[float]]
#: Centres of a table that are broadcast.
BROADCAST_CENTERS = 10_000


def centers_frame(points: DataFrame, centers: Centers) -> DataFrame:
    """(cid, c): the centres as a table, as large as the caller's list."""
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(centers)]
    return points.sparkSession.createDataFrame(rows, "cid int, c array<double>")


def assign(points: DataFrame, centers: Centers) -> DataFrame:
    """``points`` with the nearest centre ``cid`` and the squared distance ``d2`` to it."""
    hit = vectors.nearest(F.col("x"), vectors.literal_centers(centers))
    return points.withColumn("__n", hit).select(*points.columns, F.col("__n.cid").alias("cid"), F.col("__n.d2").alias("d2"))


def total_mass(points: DataFrame) -> DataFrame:
    return points.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("mass"))


def sse(points: DataFrame, centers: Centers) -> DataFrame:
    """One row (cost): the weighted SSE; 0 without points."""
    return assign(points, centers).agg(F.coalesce(F.sum(F.col("w") * F.col("d2")), F.lit(0.0)).alias("cost"))


def sse_by_cluster(points: DataFrame, centers: Centers) -> DataFrame:
    """(cid, n, mass, cost) of every cluster that has points; partial sums per task, in Arrow batches."""
    c = np.array(centers, np.float64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mass, total = np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros(len(c))
        for batch in batches:
            if batch.num_rows:
                d2, w = distances(flat(batch.column("x")), c), batch.column("w").to_numpy()
                cid = d2.argmin(axis=1)
                n += np.bincount(cid, minlength=len(c))
                mass += np.bincount(cid, weights=w, minlength=len(c))
                total += np.bincount(cid, weights=w * d2[np.arange(len(d2)), cid], minlength=len(c))
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(n[hit]), pa.array(mass[hit]), pa.array(total[hit])], names=["cid", "n", "mass", "cost"])

    parts = points.select("x", "w").mapInArrow(kernel, "cid int, n long, mass double, cost double")
    return parts.groupBy("cid").agg(*(F.sum(v).alias(v) for v in ("n", "mass", "cost")))


def small(centers: DataFrame) -> DataFrame:
    """``centers``, broadcast if there are at most :data:`BROADCAST_CENTERS`; others are joined by shuffle."""
    return F.broadcast(centers) if centers.limit(BROADCAST_CENTERS + 1).count() <= BROADCAST_CENTERS else centers.hint("shuffle_replicate_nl")


def sse_join(points: DataFrame, centers: DataFrame) -> DataFrame:
    """The SSE as a nearest-neighbour join with a table of centres (c); every row counts as a point of its own."""
    rows = points.select(F.monotonically_increasing_id().alias("row"), "x", "w")
    pairs = rows.crossJoin(small(centers.select("c"))).select("row", "w", vectors.sqdist(F.col("x"), F.col("c")).alias("d2"))
    near = pairs.groupBy("row").agg(F.min("d2").alias("d2"), F.first("w").alias("w"))
    return near.agg(F.coalesce(F.sum(F.col("w") * F.col("d2")), F.lit(0.0)).alias("cost"))


def flat(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equally long lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def distances(x: np.ndarray, centers: np.ndarray, chunk: int = 1 << 22) -> np.ndarray:
    """Squared distances, by direct differences, of ``x`` to every centre."""
    out = np.empty((len(x), len(centers)))
    rows = max(1, chunk // max(1, x.shape[1]))
    for a in range(0, len(x), rows):
        for j, c in enumerate(centers):
            diff = x[a : a + rows] - c
            out[a : a + rows, j] = np.einsum("ij,ij->i", diff, diff)
    return out


def sse_arrow(points: DataFrame, centers: Centers) -> DataFrame:
    """The SSE with one partial sum per task, computed in Arrow batches."""
    c = np.array(centers, np.float64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total += float(batch.column("w").to_numpy() @ distances(flat(batch.column("x")), c).min(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["part"])

    parts = points.select("x", "w").mapInArrow(kernel, "part double")
    return parts.agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("cost"))


def cost(points: DataFrame, centers: Centers) -> float:
    """The weighted SSE as a number."""
    return sse_arrow(points, centers).first()["cost"]


def model_cost(points: DataFrame, model) -> float:
    """The weighted SSE of the points around a model's centres."""
    return cost(points, model.centers)


def max_center_deviation(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row (deviation): the largest distance of a true centre (cid, c) to its nearest found one."""
    other = found.select(F.col("c").alias("f"))
    near = truth.crossJoin(small(other)).groupBy("cid").agg(F.min(vectors.sqdist(F.col("c"), F.col("f"))).alias("d2"))
    return near.agg(F.sqrt(F.max("d2")).alias("deviation"))
