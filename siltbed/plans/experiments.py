"""End-to-end clusterings, their comparison with MLlib, and the quality sweeps."""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.vectors import recommended_size
from siltbed.operators import coreset, cost, kernel
from siltbed.operators.lloyd import Model, lloyd
from siltbed.sources import points as sources
from siltbed.sources import sinks

# Fixed values of the published experiments.
K_SWEEP = (10, 20, 30, 40, 50)
M_SWEEP, M_SWEEP_K = (1000, 5000, 10000, 20000), 25
DIMENSIONS, PARTITIONS, RESTARTS, MAX_ITER, TOL, BASE_SEED = 54, 8, 5, 100, 1e-6, 2026
SEED_STEP = 1_000_003
#: The relative gain of a Lloyd iteration on the full table that ends the refinement.
REFINE_TOL = 2e-4


def cluster(points: DataFrame, k: int, m: int | None = None, seed: int = 42, restarts: int = RESTARTS, fan: int | None = None, refine: int = 0) -> Model | None:
    """Coreset, k-means++ and Lloyd on it, then at most ``refine`` Lloyd iterations on the full table.

    The refinement takes out what is left of the coreset's sampling error and stops where an iteration
    gains little; by default there is none. The model's cost is the full table's; None without points.
    """
    x, w = coreset.to_arrays(coreset.merged_coreset(points, m or recommended_size(k), seed, fan))
    if not len(x):
        return None
    centers, _, iterations = kernel.fit(x, w, k, restarts, MAX_ITER, TOL, key=(seed,))
    fitted = lloyd(points, centers.tolist(), refine, REFINE_TOL)
    return Model(fitted.centers, fitted.cost, iterations + fitted.iterations)


def distributed_cost(points: DataFrame, k: int, m: int, seed: int) -> float:
    return _required(cluster(points, k, m, seed)).cost


def sequential_cost(points: DataFrame, k: int, m: int, seed: int) -> float:
    """The same with one task: a single pass in arrival order, then the cost of the full table."""
    return _required(cluster(points.coalesce(1), k, m, seed)).cost


def sequential_cost_of_file(spark: SparkSession, path: str, k: int, m: int, seed: int, dim: int = DIMENSIONS, max_lines: int | None = None) -> float:
    return sequential_cost(sources.read_points(spark, path, dim, max_lines), k, m, seed)


def cost_of_file(spark: SparkSession, path: str, centers: list[list[float]], dim: int = DIMENSIONS, max_lines: int | None = None) -> float:
    return cost.cost(sources.read_points(spark, path, dim, max_lines), centers)


def _required(model: Model | None) -> Model:
    if model is None:
        raise ValueError("no valid points")
    return model


def mllib_cost(features: DataFrame, k: int, seed: int, restarts: int = RESTARTS) -> float:
    """The least training cost of MLlib's k-means over spaced seeds, on unweighted feature vectors."""
    def once(s: int) -> float:
        model = KMeans(k=k, seed=s, maxIter=MAX_ITER, tol=TOL, initMode="k-means||", featuresCol="features").fit(features)
        return model.summary.trainingCost

    return min(once(seed + r * SEED_STEP) for r in range(restarts))


def sweep(points: DataFrame, dataset: str, grid: list[tuple[int, int]], runs: int = 1, base_seed: int = BASE_SEED, with_mllib: bool = True) -> list[tuple]:
    """Result rows of every (k, m) of ``grid`` and run, by the sequential, distributed and MLlib methods."""
    rows = []
    features = sources.to_features(points).persist(StorageLevel.MEMORY_AND_DISK) if with_mllib else None
    try:
        for k, m in grid:
            for run in range(1, runs + 1):
                seed = base_seed + run - 1
                rows.append((dataset, "sequential", k, m, run, seed, sequential_cost(points, k, m, seed)))
                rows.append((dataset, "distributed", k, m, run, seed, distributed_cost(points, k, m, seed)))
                if features is not None:
                    rows.append((dataset, "mllib", k, m, run, seed, mllib_cost(features, k, seed)))
    finally:
        if features is not None:
            features.unpersist()
    return rows


def k_sweep(points: DataFrame, dataset: str, ks: tuple[int, ...] = K_SWEEP, **options) -> list[tuple]:
    return sweep(points, dataset, [(k, recommended_size(k)) for k in ks], **options)


def m_sweep(points: DataFrame, dataset: str, ms: tuple[int, ...] = M_SWEEP, k: int = M_SWEEP_K, **options) -> list[tuple]:
    return sweep(points, dataset, [(k, m) for m in ms], with_mllib=False, **options)


def positive_int(text: str | None) -> int | None:
    """A positive integer, or None for anything else."""
    try:
        value = int(text)
    except (TypeError, ValueError):
        return None
    return value if value > 0 else None


def main(argv: list[str] | None = None) -> None:
    """Both sweeps over a labelled text file, each into one CSV."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("path")
    parser.add_argument("max_lines", nargs="?", type=positive_int)
    parser.add_argument("runs", nargs="?", type=positive_int, default=1)
    parser.add_argument("--out", default="results")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.shuffle.partitions", str(PARTITIONS)).getOrCreate()
    points = sources.read_points(spark, args.path, DIMENSIONS, args.max_lines, PARTITIONS).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if points.count() == 0:
            raise ValueError("no valid points")
        sinks.write_csv(sinks.results(spark, k_sweep(points, "file", runs=args.runs or 1)), f"{args.out}/quality_k_sweep")
        sinks.write_csv(sinks.results(spark, m_sweep(points, "file", runs=args.runs or 1)), f"{args.out}/quality_m_sweep")
    finally:
        points.unpersist()


def demo(spark: SparkSession, n: int = 200_000, k: int = 5, d: int = 2, m: int = 1000) -> DataFrame:
    """(coreset_cost, full_cost, ratio, deviation) of a synthetic mixture, clustered both ways."""
    points = sources.mixture(spark, n, k, d).persist()
    try:
        ours = _required(cluster(points, k, m))
        full = mllib_cost(sources.to_features(points), k, 42, 1)
        truth = cost.centers_frame(points, sources.mixture_centers(k, d))
        deviation = cost.max_center_deviation(truth, ours.frame(points)).first()["deviation"]
        return spark.createDataFrame([(ours.cost, full, ours.cost / full, deviation)], "coreset_cost double, full_cost double, ratio double, deviation double")
    finally:
        points.unpersist()


# How the error of a coreset compounds over a tree of merges.


def error_model(cases: DataFrame, epsilon: float = 0.10) -> DataFrame:
    """(partitions, depth) with the scale, the levels and the tolerance, as column expressions."""
    scale = F.greatest(F.lit(2), F.ceil(F.pow("partitions", 1 / F.col("depth")) - 1e-12).cast("int"))
    levels = (F.col("depth") * (scale - 1)).cast("int")
    return cases.select("partitions", "depth", scale.alias("scale"), levels.alias("levels"), F.round(F.pow(F.lit(1 + epsilon), levels) - 1, 9).alias("tolerance"))
