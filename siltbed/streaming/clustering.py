"""Streaming clustering: each micro-batch becomes a coreset, the stream a persisted sketch.

The sketch after a batch is a snapshot under that batch's id, written before anybody hears of
the batch's model. A replayed batch finds its snapshot and isn't counted again; a restarted query
goes on from the last snapshot. Empty batches leave everything as it is.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltbed.operators import coreset, kernel
from siltbed.operators.lloyd import Model
from siltbed.sources import sinks
from siltbed.sources.points import from_features

SNAPSHOT = "batch_id long, level int, mass double, reductions int, x array<double>, w double"


@dataclass(frozen=True)
class Params:
    """Clusters, coreset size, restarts of the fit and seed."""

    k: int
    m: int
    restarts: int = 5
    seed: int = 42

    def __post_init__(self):
        if min(self.k, self.m, self.restarts) < 1:
            raise ValueError("k, m and restarts must be positive")


class SketchStore:
    """Snapshots of a stream's sketch, a Parquet folder per batch, the last two kept."""

    def __init__(self, spark: SparkSession, path: str, params: Params):
        self.spark, self.path, self.params = spark, path.rstrip("/"), params

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Ids of the whole snapshots, in order."""
        root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        whole = [p for p in names if p.getName().startswith("batch=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in whole)

    def load(self, batch_id: int | None) -> kernel.Sketch:
        sketch = kernel.Sketch(self.params.m, self.params.seed, 7)
        if batch_id is None:
            return sketch
        rows = self.spark.read.schema(SNAPSHOT).parquet(f"{self.path}/batch={batch_id}").collect()  # O(m log n) points
        for level in sorted({r["level"] for r in rows}):
            mine = [r for r in rows if r["level"] == level]
            while len(sketch.levels) <= level:
                sketch.levels.append(None)
            points = [r for r in mine if r["x"] is not None]
            if points:
                sketch.levels[level] = (np.array([r["x"] for r in points]), np.array([r["w"] for r in points]))
        sketch.mass, sketch.reductions = rows[0]["mass"], rows[0]["reductions"]
        return sketch

    def save(self, batch_id: int, sketch: kernel.Sketch) -> None:
        rows = []
        for level, held in enumerate(sketch.levels):
            if held is None:
                rows.append((batch_id, level, sketch.mass, sketch.reductions, None, None))
                continue
            rows += [(batch_id, level, sketch.mass, sketch.reductions, x, w) for x, w in zip(held[0].tolist(), held[1].tolist(), strict=True)]
        df = self.spark.createDataFrame(rows, SNAPSHOT).drop("batch_id").coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        root, fs = self._fs()
        for old in self.batches()[:-2]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, f"batch={old}"), True)


def integrate(batch: DataFrame, batch_id: int, params: Params, store: SketchStore) -> tuple[kernel.Sketch, bool]:
    """The sketch after a batch of points (x, w), and whether this call added it."""
    known = store.batches()
    if batch_id in known:
        return store.load(batch_id), False
    earlier = [b for b in known if b < batch_id]
    sketch = store.load(earlier[-1] if earlier else None)
    # Every batch and task draws from its own stream: the seed's counters are kept apart, not added.
    x, w = coreset.to_arrays(coreset.merged_coreset(batch, params.m, params.seed * 1_000_003 + batch_id + 1))
    if len(x):
        sketch.insert(x, w)
    store.save(batch_id, sketch)
    return sketch, True


def model_of(sketch: kernel.Sketch, k: int, params: Params) -> Model | None:
    """The clustering of a sketch's coreset; None while it is empty. Its cost is the coreset's."""
    x, w = sketch.extract()
    if not len(x):
        return None
    centers, total, iterations = kernel.fit(x, w, k, params.restarts, key=(params.seed,))
    return Model(centers.tolist(), total, iterations)


def run(source: DataFrame, params: Params, on_model: Callable[[Model, int], None] | None = None, *, state: str, checkpoint: str,
        features: str = "features", ks: list[int] | None = None, view: str | None = None, trigger: dict | None = None, name: str | None = None) -> StreamingQuery:
    """Starts the query over a streaming frame with an array column ``features``.

    After every batch, ``on_model(model, batch_id)`` hears each model of ``ks`` (default: the
    parameters' k). ``state`` holds the snapshots and ``metrics`` and ``centers`` tables beside
    them; ``view`` names a temporary view of the newest centres.
    """
    spark = source.sparkSession
    store = SketchStore(spark, f"{state.rstrip('/')}/sketch", params)

    def handle(batch: DataFrame, batch_id: int) -> None:
        began = time.time()
        points = batch.select("x", "w").persist()
        try:
            partitions = points.rdd.getNumPartitions()
            sketch, added = integrate(points, batch_id, params, store)
        finally:
            points.unpersist()
        models = [(k, model) for k in ks or [params.k] if (model := model_of(sketch, k, params)) is not None]
        took = int((time.time() - began) * 1000)
        centers = [(batch_id, k, cid, c) for k, model in models for cid, c in enumerate(model.centers)]
        metrics = [(batch_id, partitions, params.m, k, sketch.mass, took, model.cost) for k, model in models]
        newest = spark.createDataFrame(centers, sinks.CENTER)
        newest.drop("batch_id").coalesce(1).write.mode("overwrite").parquet(f"{state}/centers/batch_id={batch_id}")
        spark.createDataFrame(metrics, sinks.METRIC).drop("batch_id").coalesce(1).write.mode("overwrite").parquet(f"{state}/metrics/batch_id={batch_id}")
        if view:
            sinks.publish(newest, view)
        for _, model in models if on_model else []:
            on_model(model, batch_id)

    writer = from_features(source, features).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    writer = writer.queryName(name) if name else writer
    return writer.trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def batch_mass(state_path: str, spark: SparkSession) -> DataFrame:
    """(batch_id, mass): the mass that the stream had seen after each batch, from the metrics table."""
    return spark.read.parquet(f"{state_path}/metrics").groupBy("batch_id").agg(F.max("points_seen").alias("mass"))
