"""Weighted draws and D² seeding over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions import vectors
from siltbed.functions.uniforms import uniform, uniform_column
from siltbed.operators import cost

#: Cells of ids whose sums are put in order first, and rows that are few enough to be ordered at once.
CELLS, FEW = 4096, 10_000


def weighted_draw(df: DataFrame, u: float, weight: str | Column = "w", key: str = "id") -> DataFrame:
    """One row (key): the first row, by key, whose running weight reaches ``u`` times the total.

    If the total isn't positive, every row weighs 1. An empty table gives no row. Running sums
    are taken over at most :data:`CELLS` + 1 ranges of keys at a time, and the range that is hit is
    cut again until it holds few rows or a single key, so no task orders many rows.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    rows = df.select(F.col(key).cast("long").alias("id"), w.cast("double").alias("w")).filter("id is not null")
    span = rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("w").alias("total"), F.count("*").alias("n")).first()
    if not span["n"]:
        return df.select(key).limit(0)
    total = span["total"]
    if total is None or not total > 0:
        rows, total = rows.withColumn("w", F.lit(1.0)), float(span["n"])
    lo, hi, n, need = span["lo"], span["hi"], span["n"], u * total
    while True:
        inside = rows.filter((F.col("id") >= lo) & (F.col("id") <= hi))
        if lo == hi or n <= FEW:
            break
        width = max(1, -(-(hi - lo + 1) // CELLS))
        cell = F.floor((F.col("id").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long")
        cells = inside.groupBy(cell.alias("cell")).agg(F.sum("w").alias("w"), F.count("*").alias("n")).orderBy("cell").collect()
        running = np.cumsum([c["w"] for c in cells])
        at = min(int(np.searchsorted(running, need, side="left")), len(cells) - 1)
        while at and cells[at]["w"] == 0:  # rounding ran past the end
            at -= 1
        need -= float(running[at] - cells[at]["w"])
        lo, hi, n = lo + cells[at]["cell"] * width, min(hi, lo + (cells[at]["cell"] + 1) * width - 1), cells[at]["n"]
    if lo == hi:
        return df.sparkSession.createDataFrame([(lo,)], "id long").select(F.col("id").alias(key))
    cs = F.sum("w").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    hit = inside.withColumn("cs", cs).agg(F.min(F.when(F.col("cs") >= need, F.col("id"))).alias("a"), F.max("id").alias("b"))
    return hit.select(F.coalesce("a", "b").alias(key))


def race_draw(df: DataFrame, seed: int, stage: str, n: int = 1, weight: str = "w", key: str = "id") -> DataFrame:
    """``n`` rows drawn without replacement in proportion to their weight, in one pass.

    Every row runs an exponential race with its own replayable uniform; the first ``n`` win, found
    by partial top-n per task. Rows without weight never win.
    """
    u = uniform_column(seed, stage, F.col(key))
    time = -F.log(u + 2.0**-33) / F.col(weight)
    return df.filter(F.col(weight) > 0).withColumn("__time", time).orderBy("__time", key).limit(n).drop("__time")


def closest(points: DataFrame, centers: list[list[float]]) -> DataFrame:
    """``points`` with ``mass``: weight times squared distance to the nearest of ``centers``."""
    if not centers:
        return points.withColumn("mass", F.col("w"))
    return points.withColumn("mass", F.col("w") * vectors.nearest(F.col("x"), vectors.literal_centers(centers))["d2"])


def seed_ids(points: DataFrame, k: int, seed: int, stage: str = "seed", key: str = "id") -> list[int]:
    """Keys of k-means++ seeds: the first in proportion to weight, each next one to weight times D².

    At most one job per centre over the points, none of which leave their executors but the
    seeds. Returns min(k, rows) keys; fails without points or with k < 1.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = points.count()
    if not rows:
        raise ValueError("no points")
    ids: list[int] = []
    centers: list[list[float]] = []
    for i in range(min(k, rows)):
        pick = weighted_draw(closest(points, centers), uniform(seed, stage, i), "mass", key).first()[key]
        ids.append(pick)
        centers.append(list(points.filter(F.col(key) == pick).first()["x"]))
    return ids


def hashed_uniforms(ids: np.ndarray, *counters: int) -> np.ndarray:
    """A number in (0, 1) for each id and the counters, whatever task asks for it (splitmix64)."""
    x = ids.astype(np.int64).view(np.uint64).copy()
    for c in counters:
        x = (x ^ np.uint64(c & 0xFFFFFFFFFFFFFFFF)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _fastest(points: DataFrame, centers: list[list[float]], seed: int, n: int, key: str) -> list[float] | None:
    """The winner of an exponential race in which a point's rate is its weight times its squared
    distance to ``centers`` (its weight without any); each task sends its own winner alone."""
    known = np.array(centers, np.float64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, rate = batch.column("id").to_numpy(), cost.flat(batch.column("x")), batch.column("w").to_numpy().copy()
            if len(known):
                rate *= cost.distances(x, known).min(axis=1)
            with np.errstate(divide="ignore"):
                arrival = -np.log(hashed_uniforms(ids, seed, n)) / rate
            i = int(np.lexsort((ids, arrival))[0])
            if rate[i] > 0 and (best is None or (arrival[i], ids[i]) < best[:2]):
                best = (arrival[i], ids[i], x[i].tolist())
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.int64()), pa.array([best[2]], pa.list_(pa.float64()))], names=["arrival", "id", "x"])

    won = points.select(F.col(key).cast("long").alias("id"), "x", "w").mapInArrow(kernel, "arrival double, id long, x array<double>")
    first = won.orderBy("arrival", "id").limit(1).first()
    return None if first is None else list(first["x"])


def seed_centers(points: DataFrame, k: int, seed: int, key: str = "id") -> list[list[float]]:
    """k-means++ seeds of a table: one pass per centre, a row per task to the driver.

    Fewer come back where there are fewer distinct points with weight; without any it fails.
    """
    if k < 1:
        raise ValueError("k must be positive")
    centers: list[list[float]] = []
    while len(centers) < k and (x := _fastest(points, centers, seed, len(centers), key)) is not None:
        centers.append(x)
    if not centers:
        raise ValueError("no points with weight")
    return centers
