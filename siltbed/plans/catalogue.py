"""Registered queries of the clustering engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import uniforms, vectors
from siltbed.functions.csv import csv_field
from siltbed.operators import coreset, cost, kernel, lloyd, sampling
from siltbed.plans import experiments, selfcheck
from siltbed.sources import points as sources
from siltbed.sources import sinks
from siltbed.storage import materialize, scratch_path, table
from siltbed.streaming import clustering

K, M, SEED = 5, 300, 42


# Points -------------------------------------------------------------------------------------


def embeddings(spark: SparkSession, sf_dir: str, weight: str | Column | None = None) -> DataFrame:
    """(id, x, w) of the embeddings."""
    df = table(spark, sf_dir, "embeddings").withColumn("id", F.col("vec_id"))
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    out = df.select("id", F.col("embedding").cast("array<double>").alias("x"), w.cast("double").alias("w"))
    return out.filter(vectors.is_point(F.col("x")))


def by_label() -> Column:
    return F.col("label") + 1


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, w): four-dimensional order lines, weighted by quantity."""
    return sources.from_columns(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_quantity")


def events(spark: SparkSession, sf_dir: str, key: list[str]) -> DataFrame:
    return sources.from_columns(table(spark, sf_dir, "events"), ["value", "user_id"], None, key)


def first_centers(points: DataFrame, k: int) -> list[list[float]]:
    """The first ``k`` points by id."""
    return [list(r["x"]) for r in points.orderBy("id").limit(k).collect()]


# Sources and sinks --------------------------------------------------------------------------


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value) lines of two numbers, of which some kinds are malformed."""
    v, u = F.col("value").cast("decimal(18,4)").cast("string"), F.col("user_id").cast("string")
    kind = F.col("event_id") % 7
    line = (F.when(kind == 0, F.concat_ws(",", v, u)).when(kind == 1, F.concat(F.lit(" "), v, F.lit(" , "), u, F.lit("\t")))
            .when(kind == 2, F.concat(v, F.lit(","), u, F.lit(","))).when(kind == 3, v).when(kind == 4, F.concat(v, F.lit(",,"), u))
            .when(kind == 5, F.concat(F.lit("a,"), u)).otherwise(F.concat_ws(",", v, u, u)))
    return table(spark, sf_dir, "events").select("event_id", line.alias("value"))


def parse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sources.parse_points(event_lines(spark, sf_dir), 2)
    return out.select("event_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "w")


def parse_reject_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    kept = sources.parse_points(lines, 2).agg(F.count("*").alias("kept"))
    return lines.agg(F.count("*").alias("lines")).crossJoin(kept).select((F.col("lines") - F.col("kept")).alias("rejected"))


def parse_label_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sources.parse_points(event_lines(spark, sf_dir), 2, drop_label=True)
    return out.select("event_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


def first_n_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = sources.head_lines(event_lines(spark, sf_dir), 500, "event_id")
    return sources.parse_points(head, 2).select("event_id", F.col("x")[0].alias("x0"))


def csv_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", csv_field(F.col("text")).alias("field"))


def mixture_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, j, v) for c, center in enumerate(sources.mixture_centers(K, 4)) for j, v in enumerate(center)]
    return spark.createDataFrame(rows, "cid int, j int, v double")


def mixture_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a cluster's mean coordinates lie from its centre, and their spread, to one digit."""
    rows = sources.mixture(spark, 40_000, K, 2, partitions=8).select("id", F.posexplode("x").alias("j", "v"))
    center = F.round(F.col("v") / 20) * 20
    rows = rows.withColumn("gap", F.col("v") - center).groupBy("j", (center / 20).cast("int").alias("place"))
    return rows.agg(F.abs(F.round(F.avg("gap"), 1)).alias("off"), F.round(F.stddev("gap"), 1).alias("sigma"))


def _labelled_file(spark: SparkSession, sf_dir: str) -> str:
    """The event lines as a text file without a header; the folder."""
    path = scratch_path(spark, "lines")
    event_lines(spark, sf_dir).select("value").write.text(path)
    return path


def file_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed scan of a text file, its last field dropped, in a given number of partitions."""
    out = sources.read_points(spark, _labelled_file(spark, sf_dir), 2, partitions=3)
    return out.select(F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "w")


def file_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of a file in file order, malformed ones counted, as they come before parsing."""
    path = scratch_path(spark, "lines")
    event_lines(spark, sf_dir).orderBy("event_id").coalesce(1).select("value").write.text(path)
    return sources.read_points(spark, path, 2, max_lines=350).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x")[1]), 3).alias("total"))


def file_loan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that are lent to a function while they are cached, and the same as an array on the driver."""
    def use(points: DataFrame) -> tuple[int, float]:
        some = sources.collect_points(points.orderBy("x").limit(100), 100)
        return points.count(), float(sum(w for _, w in some))

    n, mass = sources.with_points(spark, _labelled_file(spark, sf_dir), 2, use)
    return spark.createDataFrame([(n, mass)], "n long, mass_of_100 double")


def file_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SSE over a file, around fixed centres."""
    got = experiments.cost_of_file(spark, _labelled_file(spark, sf_dir), FILE_CENTERS, 2)
    return spark.createDataFrame([(got,)], "cost double").select(F.round(F.col("cost") / 1e6, 3).alias("cost_e6"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with commas, quotes and line ends, written as one CSV file and read again."""
    p, path = table(spark, sf_dir, "part"), scratch_path(spark, "csv")
    name = F.concat(F.col("p_name"), F.lit(', "a"\n'), F.col("p_type"))
    sinks.write_csv(p.select(name.alias("dataset"), F.col("p_brand").alias("method"), F.col("p_size").alias("k"), F.lit(1).alias("m"), F.lit(2).alias("run"), F.col("p_partkey").alias("seed"), F.col("p_retailprice").alias("cost")), path)
    return sinks.read_csv(spark, path)


def features_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector column for MLlib, read back."""
    p = embeddings(spark, sf_dir)
    rows = sources.to_features(p).select(vector_to_array("features").alias("x"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(F.col("x")[0]), 6).alias("first"), F.round(F.sum(F.element_at("x", -1)), 6).alias("last"))


# Distances and costs ------------------------------------------------------------------------


def approximate_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.agg(F.count_if(vectors.approx_equal(F.col("value"), F.round("value", 1), 0.01)).alias("near"), F.lit(vectors.recommended_size(K)).cast("long").alias("m"))


def nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir)
    return p.select("id", F.round(vectors.distance(F.col("x"), vectors.literal(first_centers(p, 1)[0])), 6).alias("distance"))


def point_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitems(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("w").alias("weights"))


def sqdist_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir)
    c = cost.centers_frame(p, first_centers(p, K))
    return p.crossJoin(F.broadcast(c)).select("id", "cid", F.round(vectors.sqdist(F.col("x"), F.col("c")), 6).alias("d2"))


def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir)
    return cost.assign(p, first_centers(p, K)).select("id", "cid", F.round("d2", 6).alias("d2"))


def nearest_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every centre stands twice; the lower index wins."""
    p = embeddings(spark, sf_dir)
    c = first_centers(p, K)
    return cost.assign(p, c + c).groupBy("cid").agg(F.count("*").alias("n"))


def weighted_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir, by_label())
    return cost.sse(p, first_centers(p, K)).select(F.round("cost", 4).alias("cost"))


def weighted_sse_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir, by_label())
    return cost.sse_join(p, cost.centers_frame(p, first_centers(p, K))).select(F.round("cost", 4).alias("cost"))


def weighted_sse_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir, by_label())
    return cost.sse_arrow(p, first_centers(p, K)).select(F.round("cost", 4).alias("cost"))


def sse_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir, by_label())
    out = cost.sse_by_cluster(p, first_centers(p, 10))
    return out.select("cid", "n", "mass", F.round("cost", 4).alias("cost"))


FILE_CENTERS = [[10.0, 100.0], [50.0, 500.0], [90.0, 900.0]]
LINE_CENTERS = [[10.0, 20000.0, 0.02, 0.02], [25.0, 40000.0, 0.05, 0.04], [40.0, 60000.0, 0.08, 0.06]]


def sse_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.sse(lineitems(spark, sf_dir), LINE_CENTERS).select(F.round(F.col("cost") / 1e9, 3).alias("cost_e9"))


def total_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.total_mass(lineitems(spark, sf_dir))


def max_center_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the labels' mean vectors from the first vectors."""
    p = embeddings(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))
    means = rows.groupBy("label", "j").agg(F.avg("v").alias("v")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("s"))
    truth = means.select(F.col("label").alias("cid"), F.transform("s", lambda r: r["v"]).alias("c"))
    return cost.max_center_deviation(truth, cost.centers_frame(p, first_centers(p, K))).select(F.round("deviation", 6).alias("deviation"))


# Lloyd --------------------------------------------------------------------------------------


def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir, by_label())
    return lloyd.step(p, first_centers(p, K)).select("cid", "j", F.round("v", 6).alias("v"))


def lloyd_step_empty_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more centre, far from all points, keeps its place."""
    p = embeddings(spark, sf_dir, by_label())
    c = first_centers(p, K)
    return lloyd.step(p, [*c, [100.0] * len(c[0])]).select("cid", "j", F.round("v", 6).alias("v"))


def lloyd_3_iters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir, by_label())
    model = lloyd.lloyd(p, first_centers(p, K), max_iter=3, tol=-1.0)
    return model.frame(p).select("cid", F.posexplode("c").alias("j", "v")).withColumn("v", F.round("v", 6))


def lloyd_step_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir, by_label())
    return lloyd.step_relational(p, first_centers(p, K)).select("cid", "j", F.round("v", 6).alias("v"))


def lloyd_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After how many iterations the tolerance ends the loop, and the cost of its model."""
    p = embeddings(spark, sf_dir, by_label())
    model = lloyd.lloyd(p, first_centers(p, K), max_iter=4, tol=0.05)
    return spark.createDataFrame([(model.iterations, round(cost.model_cost(p, model), 4))], "iterations int, cost double")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, w): nations as points near their region's number."""
    n = table(spark, sf_dir, "nation").withColumn("id", F.col("n_nationkey").cast("long")).withColumn("v", F.col("n_regionkey") * 100 + F.col("n_nationkey") / 100)
    return sources.from_columns(n, ["v"], F.col("n_nationkey") + 1, ["id"])


def _ordered(spark: SparkSession, centers: list[list[float]], total: float) -> DataFrame:
    return spark.createDataFrame([(i, round(c[0], 6), round(total, 6)) for i, c in enumerate(centers)], "i int, c0 double, cost double")


def fit_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of five seeded runs over a table, its centres by their first coordinate."""
    model = lloyd.fit(_regions(spark, sf_dir), 5, seed=SEED)
    return _ordered(spark, model.ordered(), model.cost)


def fit_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the kernel that fits coresets, over a coreset as large as the table."""
    x, w = coreset.to_arrays(coreset.merged_coreset(_regions(spark, sf_dir), 100))
    centers, total, _ = kernel.fit(x, w, 5, key=(SEED,))
    return _ordered(spark, sorted(centers.tolist()), total)


def cluster_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole clustering plan: coreset, fit, refinement."""
    model = experiments.cluster(_regions(spark, sf_dir), 5)
    return _ordered(spark, model.ordered(), model.cost)


def weight_equals_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step over points of weight w, as over w copies of each."""
    p = embeddings(spark, sf_dir, by_label())
    copies = p.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).select("id", "x", F.lit(1.0).alias("w"))
    return lloyd.step(copies, first_centers(p, K)).select("cid", "j", F.round("v", 6).alias("v"))


# Draws --------------------------------------------------------------------------------------


def uniforms_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", uniforms.uniform_column(SEED, "demo", F.col("event_id")).alias("u"))


def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir, by_label())
    out = None
    for i in range(5):
        one = sampling.weighted_draw(p, uniforms.uniform(SEED, "draw", i)).select(F.lit(i).alias("i"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def weighted_draw_zero_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir, F.lit(0))
    return sampling.weighted_draw(p, uniforms.uniform(SEED, "draw", 0)).select("id")


def kmeanspp_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = sampling.seed_ids(embeddings(spark, sf_dir), 4, SEED)
    return spark.createDataFrame(list(enumerate(ids)), "i int, id long")


# Buckets and coresets -----------------------------------------------------------------------


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coreset.bucket_assignment(table(spark, sf_dir, "events").select("ts", "event_id"), M, ["ts", "event_id"])


def bucket_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir).select("event_id", "bucket")


def bucket_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.floor(F.count("*") / M)
    levels = F.when(q == 0, 1).otherwise(1 + F.length(F.bin(q))).cast("int")
    return table(spark, sf_dir, "events").agg(levels.alias("levels"))


def union_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points the buckets hold, after building them."""
    p = events(spark, sf_dir, ["ts", "event_id"])
    return coreset.reduced_buckets(p, M, ["ts", "event_id"]).agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("mass"))


def partial_coreset_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coreset.partial_coresets(events(spark, sf_dir, []).repartition(4), M).agg(F.round(F.sum("w"), 6).alias("mass"))


def merged_coreset_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coreset.merged_coreset(events(spark, sf_dir, []).repartition(8), M)
    return out.agg(F.round(F.sum("w"), 6).alias("mass"), (F.count("*") <= M).alias("fits"))


def coreset_mass_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coreset.merged_coreset(lineitems(spark, sf_dir), M).agg(F.round(F.sum("w"), 4).alias("mass"), (F.count("*") <= M).alias("fits"))


def grouped_coreset_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events(spark, sf_dir, ["event_type"]).repartition(4)
    return coreset.merged_coreset(p, 100, by=["event_type"]).groupBy("event_type").agg(F.round(F.sum("w"), 6).alias("mass"), (F.count("*") <= 100).alias("fits"))


def coreset_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coreset points that aren't input points: none."""
    p = events(spark, sf_dir, [])
    return coreset.merged_coreset(p, M).join(p, "x", "left_anti").agg(F.count("*").alias("strangers"))


def coreset_identity_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer points than the coreset may hold come back as they are."""
    df = table(spark, sf_dir, "nation")
    p = sources.from_columns(df, ["n_nationkey", "n_regionkey"])
    return coreset.merged_coreset(p, 100).select(F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "w")


# End to end ---------------------------------------------------------------------------------


def coreset_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cells of the vectors, refined with replayable uniforms: representative, rows, mass and cost."""
    x, w = [], []
    rows = embeddings(spark, sf_dir, by_label()).orderBy("id").select("id", "x", "w").collect()  # the kernel's input, as large as a task's
    x, w = np.array([r["x"] for r in rows]), np.array([r["w"] for r in rows])
    cells = kernel.partition(x, w, 3, uniforms.Replay(SEED, "cells"))
    out = [(i, rows[rep]["id"], len(cells.rows[i]), float(cells.mass[i]), round(float(cells.cost[i]), 6)) for i, rep in enumerate(cells.reps)]
    return spark.createDataFrame(out, "cell int, rep long, n long, mass double, cost double")


def sketch_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers inserted one after another: seen, in the union, in the reduced coreset; the sketch is left as it was."""
    x, w = coreset.to_arrays(sources.from_columns(table(spark, sf_dir, "supplier"), ["s_acctbal", "s_suppkey"]))
    sketch = kernel.Sketch(7, SEED).insert(x, w)
    reduced, union = sketch.extract(), sketch.union()
    return spark.createDataFrame([(int(sketch.mass), len(union[0]), len(reduced[0]), float(reduced[1].sum()), sketch.check(), len(sketch.levels))],
                                 "seen long, in_union long, extracted long, mass double, whole boolean, levels int")


def self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(selfcheck.checks(), "name string, ok boolean")


def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demonstration on a mixture: cost over that of all points, cost over n * d * sigma^2, deviation, to one digit."""
    n, d = 50_000, 2
    return experiments.demo(spark, n).select(F.round("ratio", 1).alias("ratio"), F.round(F.col("coreset_cost") / (n * d * 0.25), 1).alias("scaled"), F.round("deviation", 1).alias("deviation"))


def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sweeps' rows, and how far a run's cost is above the least of its k, in tenths."""
    p = sources.from_columns(table(spark, sf_dir, "supplier"), ["s_acctbal"]).persist()
    try:
        rows = experiments.k_sweep(p, "supplier", (2, 3), with_mllib=False) + experiments.m_sweep(p, "supplier", (50, 400), 3)
    finally:
        p.unpersist()
    out = sinks.results(spark, rows)
    least = out.groupBy("k").agg(F.min("cost").alias("least"))
    return out.join(F.broadcast(least), "k").select("dataset", "method", "k", "m", "run", "seed", F.round(F.col("cost") / F.col("least"), 1).alias("over"))


def error_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.error_model(spark.createDataFrame([(p, d) for p in (1, 2, 4, 8, 16, 100) for d in (1, 2, 3)], "partitions int, depth int"))


def coreset_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much the clustering's cost is above the best of MLlib's five on the full table, in hundredths."""
    p = embeddings(spark, sf_dir).persist()
    try:
        ours, theirs = experiments.cluster(p, K).cost, experiments.mllib_cost(sources.to_features(p), K, SEED)
    finally:
        p.unpersist()
    return spark.createDataFrame([(max(0.0, round(ours / theirs - 1, 2)),)], "excess double")


def distributed_vs_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the costs of the distributed and the single-task plan are apart, in hundredths."""
    p = sources.from_columns(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]).persist()
    try:
        spread, single = experiments.distributed_cost(p.repartition(8), K, 1000, SEED), experiments.sequential_cost(p, K, 1000, SEED)
    finally:
        p.unpersist()
    return spark.createDataFrame([(abs(round(spread / single - 1, 2)),)], "gap double")


def stream_input(spark: SparkSession, sf_dir: str) -> str:
    """The events in four files, a micro-batch each; the folder."""
    state = scratch_path(spark, "stream")
    rows = coreset.ranked(events(spark, sf_dir, ["event_id"]).select("event_id", F.col("x").alias("features")), ["event_id"])
    n = rows.count()
    for i in range(4):
        rows.filter(F.floor(F.col("rank") * 4 / n) == i).select("features").coalesce(1).write.parquet(f"{state}/in/part={i}")
    return state


def run_stream(spark: SparkSession, state: str, on_model=None, view: str | None = None) -> str:
    """Runs the files of ``state`` through the streaming query; the folder of its tables."""
    source = spark.readStream.schema("features array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{state}/in")
    query = clustering.run(source, clustering.Params(K, vectors.recommended_size(K)), on_model, state=f"{state}/state", checkpoint=f"{state}/checkpoint", trigger={"availableNow": True}, view=view)
    query.awaitTermination()
    return f"{state}/state"


def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many batches the stream had and what it had seen after the last."""
    masses = clustering.batch_mass(run_stream(spark, stream_input(spark, sf_dir)), spark)
    return masses.agg(F.count("*").alias("batches"), F.max("mass").alias("mass"))


def stream_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the callback heard, the metrics and centre tables hold and the view of the newest centres shows."""
    heard: list[int] = []
    view = "siltbed_newest_centers"
    state = run_stream(spark, stream_input(spark, sf_dir), lambda model, batch_id: heard.append(model.k), view)
    metrics, centers = spark.read.parquet(f"{state}/metrics"), spark.read.parquet(f"{state}/centers")
    return spark.createDataFrame([(len(heard), sum(heard), metrics.filter("cost > 0 and build_ms >= 0").count(), centers.count(), spark.table(view).count())],
                                 "heard long, centers_heard long, metrics long, centers long, newest long")


def stream_vs_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of the stream's last centres over that of the bounded plan, in tenths."""
    models: list[lloyd.Model] = []
    run_stream(spark, stream_input(spark, sf_dir), lambda model, batch_id: models.append(model))
    p = events(spark, sf_dir, [])
    return spark.createDataFrame([(round(cost.model_cost(p, models[-1]) / experiments.cluster(p, K).cost, 1),)], "ratio double")


_QUERIES = (
    parse_points, parse_reject_count, parse_label_drop, first_n_lines, csv_quote, mixture_centers, sqdist_pairs, nearest_center, nearest_tie,
    weighted_sse, weighted_sse_join, weighted_sse_arrow, sse_by_cluster, sse_lineitem, total_mass, max_center_deviation, lloyd_step,
    lloyd_step_empty_cluster, lloyd_3_iters, weight_equals_copies, uniforms_replay, weighted_draw, weighted_draw_zero_mass, kmeanspp_seeds,
    bucket_assignment, bucket_occupancy, bucket_levels, union_size, partial_coreset_mass, merged_coreset_mass, coreset_mass_weighted,
    grouped_coreset_mass, coreset_subset, coreset_identity_small, error_model, coreset_quality, distributed_vs_sequential,
    stream_batches, stream_sinks, stream_vs_batch, mixture_noise, file_points, file_head, file_loan, file_cost, csv_round_trip, features_frame,
    approximate_equality, nearest_distance, point_count, lloyd_step_relational, lloyd_tolerance, fit_restarts, fit_kernel, cluster_regions,
    coreset_cells, sketch_extract, self_check, demo, sweeps)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


# DuckDB -------------------------------------------------------------------------------------

_D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1]-z[2])*(z[1]-z[2])))"
_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, {w}::DOUBLE AS w FROM embeddings)"
_C = "c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS cid, x AS c FROM e QUALIFY row_number() OVER (ORDER BY id) <= {k})"


def _setup(k: int = K, w: str = "(label + 1)") -> str:
    return f"WITH {_E.format(w=w)}, {_C.format(k=k)}"


def _nearest(points: str, centers: str) -> str:
    d2 = _D2.format("x", "c")
    return f"SELECT id, x, w, cid, {d2} AS d2 FROM {points}, {centers} QUALIFY row_number() OVER (PARTITION BY id ORDER BY {d2}, cid) = 1"


def _step(assigned: str, centers: str) -> str:
    """(cid, c): the new centres."""
    return f"""SELECT cid, list(v ORDER BY j) AS c FROM (
      SELECT o.cid, o.j, coalesce(n.v, o.v) AS v
      FROM (SELECT cid, unnest(range(1, len(c) + 1)) AS j, unnest(c) AS v FROM {centers}) o
      LEFT JOIN (SELECT cid, j, sum(w * v) / sum(w) AS v FROM (SELECT cid, w, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM {assigned}) GROUP BY cid, j) n
      ON o.cid = n.cid AND o.j = n.j) GROUP BY cid"""


def _coordinates(centers: str) -> str:
    return f"SELECT cid, (j - 1)::INTEGER AS j, round(v, 6) AS v FROM (SELECT cid, unnest(range(1, len(c) + 1)) AS j, unnest(c) AS v FROM {centers})"


def _u(stage: str, i: int) -> str:
    return f"(('0x' || substr(md5('{SEED}|{stage}|{i}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _draw(table_name: str, weight: str, u: str) -> str:
    return f"""(SELECT min(id) FROM (SELECT id, sum({weight}) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS cs, sum({weight}) OVER () AS tot FROM {table_name})
      WHERE cs >= {u} * tot)"""


_LINES = "CAST(CAST(value AS DECIMAL(18,4)) AS DOUBLE)"
_SSE = f"{_setup()}, a AS ({_nearest('e', 'c')}) SELECT round(sum(w * d2), 4) AS cost FROM a"
_BUCKETS = f"""WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // {M} AS b, (count(*) OVER ()) // {M} AS q FROM events),
  b AS (SELECT event_id, (CASE WHEN b = q THEN 0 ELSE length(bin(xor(b, q))) END)::INTEGER AS bucket FROM r)"""
_LLOYD_STEP = f"{_setup()}, a AS ({_nearest('e', 'c')}), n AS ({_step('a', 'c')}) {_coordinates('n')}"


def _seeds() -> str:
    steps = [_E.format(w="1"), "s0 AS (SELECT id, x, 1.0::DOUBLE AS cl FROM e)"]
    for i in range(4):
        steps.append(f"p{i} AS (SELECT {_draw(f's{i}', 'cl', _u('seed', i))} AS id)")
        least = "d2" if i == 0 else "least(cl, d2)"
        steps.append(f"s{i + 1} AS (SELECT id, x, {least} AS cl FROM (SELECT s.id, s.x, s.cl, {_D2.format('s.x', 'o.x')} AS d2 FROM s{i} s, (SELECT x FROM e WHERE id = (SELECT id FROM p{i})) o))")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS i, id FROM p{i}" for i in range(4))


_REGIONS = """n AS (SELECT n_regionkey AS r, (n_regionkey * 100 + n_nationkey / 100.0)::DOUBLE AS v, (n_nationkey + 1)::DOUBLE AS w FROM nation),
  c AS (SELECT r, sum(v * w) / sum(w) AS c0 FROM n GROUP BY r)
  SELECT (row_number() OVER (ORDER BY c0) - 1)::INTEGER AS i, round(c0, 6) AS c0, (SELECT round(sum(w * (v - c0) ** 2), 6) FROM n JOIN c USING (r)) AS cost FROM c"""


def _cells() -> str:
    """Three cells: draw by weight, split by the share of cost, draw a cell by cost, split it."""
    near = _D2.format("e.x", "p.x")
    return f"""WITH {_E.format(w="(label + 1)")},
      p0 AS (SELECT id, x FROM e WHERE id = {_draw("e", "w", _u("cells", 0))}),
      s0 AS (SELECT e.id, e.x, e.w, {near} AS d2, e.w * {near} AS cl FROM e, p0 p),
      p1 AS (SELECT id, x FROM e WHERE id = {_draw("s0", "cl", _u("cells", 2))}),
      s1 AS (SELECT e.id, e.x, e.w, least(e.d2, {near}) AS d2, CASE WHEN {near} < e.d2 THEN 1 ELSE 0 END AS cell FROM s0 e, p1 p),
      k AS (SELECT CASE WHEN {_u("cells", 3)} * sum(w * d2) < sum(CASE WHEN cell = 0 THEN w * d2 ELSE 0 END) THEN 0 ELSE 1 END AS cell FROM s1),
      h AS (SELECT id, x, w, w * d2 AS cl FROM s1 WHERE cell = (SELECT cell FROM k)),
      p2 AS (SELECT id, x FROM e WHERE id = {_draw("h", "cl", _u("cells", 4))}),
      s2 AS (SELECT e.id, e.w, CASE WHEN e.cell = k.cell AND {near} < e.d2 THEN 2 ELSE e.cell END AS cell,
             CASE WHEN e.cell = k.cell THEN least(e.d2, {near}) ELSE e.d2 END AS d2 FROM s1 e, p2 p, k),
      r AS (SELECT 0 AS cell, id FROM p0 UNION ALL SELECT 1, id FROM p1 UNION ALL SELECT 2, id FROM p2)
      SELECT s2.cell::INTEGER AS cell, r.id AS rep, count(*) AS n, sum(w) AS mass, round(sum(w * d2), 6) AS cost FROM s2 JOIN r ON r.cell = s2.cell GROUP BY s2.cell, r.id"""


def _tolerance() -> str:
    """Four iterations at most; the loop ends where the cost falls by no more than the share."""
    steps = [f"a{i} AS ({_nearest('e', 'c' if i == 0 else f'c{i}')}), c{i + 1} AS ({_step(f'a{i}', 'c' if i == 0 else f'c{i}')})" for i in range(4)]
    sums = ", ".join(f"(SELECT sum(w * d2) FROM a{i}) AS t{i}" for i in range(5))
    return f"""{_setup()}, {", ".join(steps)}, a4 AS ({_nearest("e", "c4")}), t AS (SELECT {sums}),
      n AS (SELECT CASE WHEN t0 - t1 <= 0.05 * t0 THEN 2 WHEN t1 - t2 <= 0.05 * t1 THEN 3 ELSE 4 END AS i, * FROM t)
      SELECT i::INTEGER AS iterations, round(CASE i WHEN 2 THEN t2 WHEN 3 THEN t3 ELSE t4 END, 4) AS cost FROM n"""


def oracle_sql() -> dict[str, str]:
    kept = "event_id % 7 IN (0, 1, 2, 6)"
    file_d2 = ", ".join(f"({_LINES} - {c[0]}) ** 2 + (user_id - {c[1]}) ** 2" for c in FILE_CENTERS)
    line_d2 = ", ".join(f"(l_quantity-{c[0]})**2 + (l_extendedprice-{c[1]})**2 + (l_discount-{c[2]})**2 + (l_tax-{c[3]})**2" for c in LINE_CENTERS)
    three = [f"a0 AS ({_nearest('e', 'c')}), c1 AS ({_step('a0', 'c')})", f"a1 AS ({_nearest('e', 'c1')}), c2 AS ({_step('a1', 'c1')})", f"a2 AS ({_nearest('e', 'c2')}), c3 AS ({_step('a2', 'c2')})"]
    return {
        "parse_points": f"SELECT event_id, {_LINES} AS x0, user_id::DOUBLE AS x1, 1.0::DOUBLE AS w FROM events WHERE event_id % 7 IN (0, 1, 2)",
        "parse_reject_count": "SELECT count(*) AS rejected FROM events WHERE event_id % 7 NOT IN (0, 1, 2)",
        "parse_label_drop": f"SELECT event_id, {_LINES} AS x0, user_id::DOUBLE AS x1 FROM events WHERE event_id % 7 IN (0, 1, 2, 6)",
        "first_n_lines": f"SELECT event_id, {_LINES} AS x0 FROM (SELECT * FROM events ORDER BY event_id LIMIT 500) WHERE event_id % 7 IN (0, 1, 2)",
        "csv_quote": """SELECT doc_id, CASE WHEN strpos(text, ',') > 0 OR strpos(text, '"') > 0 OR strpos(text, chr(10)) > 0 OR strpos(text, chr(13)) > 0
            THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""",
        "mixture_centers": f"SELECT c::INTEGER AS cid, j::INTEGER AS j, ((c + 1) * (j + 1) % {K} * 20.0)::DOUBLE AS v FROM range({K}) a(c), range(4) b(j)",
        "sqdist_pairs": f"{_setup(w='1')} SELECT id, cid, round({_D2.format('x', 'c')}, 6) AS d2 FROM e, c",
        "nearest_center": f"{_setup(w='1')}, a AS ({_nearest('e', 'c')}) SELECT id, cid, round(d2, 6) AS d2 FROM a",
        "nearest_tie": f"{_setup(w='1')}, t AS (SELECT * FROM c UNION ALL SELECT cid + {K} AS cid, c FROM c), a AS ({_nearest('e', 't')}) SELECT cid, count(*) AS n FROM a GROUP BY cid",
        "weighted_sse": _SSE,
        "weighted_sse_join": _SSE,
        "weighted_sse_arrow": _SSE,
        "sse_by_cluster": f"{_setup(10)}, a AS ({_nearest('e', 'c')}) SELECT cid, count(*) AS n, sum(w) AS mass, round(sum(w * d2), 4) AS cost FROM a GROUP BY cid",
        "sse_lineitem": f"SELECT round(sum(l_quantity * least({line_d2})) / 1e9, 3) AS cost_e9 FROM lineitem",
        "total_mass": "SELECT sum(l_quantity) AS mass FROM lineitem",
        "max_center_deviation": f"""{_setup(w='1')}, m AS (SELECT label, list(v ORDER BY j) AS t FROM (SELECT label, j, avg(v) AS v FROM (
            SELECT label, unnest(range(1, len(embedding) + 1)) AS j, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY label, j) GROUP BY label)
            SELECT round(sqrt(max(d2)), 6) AS deviation FROM (SELECT label, min({_D2.format('t', 'c')}) AS d2 FROM m, c GROUP BY label)""",
        "lloyd_step": _LLOYD_STEP,
        "lloyd_step_empty_cluster": f"{_setup()}, f AS (SELECT * FROM c UNION ALL SELECT {K}::INTEGER AS cid, list_transform(c, lambda v: 100.0::DOUBLE) AS c FROM c WHERE cid = 0), a AS ({_nearest('e', 'f')}), n AS ({_step('a', 'f')}) {_coordinates('n')}",
        "lloyd_3_iters": f"{_setup()}, {', '.join(three)} {_coordinates('c3')}",
        "weight_equals_copies": _LLOYD_STEP,
        "uniforms_replay": f"SELECT event_id, ('0x' || substr(md5('{SEED}|demo|' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events",
        "weighted_draw": f"WITH {_E.format(w='(label + 1)')} " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS i, {_draw('e', 'w', _u('draw', i))} AS id" for i in range(5)),
        "weighted_draw_zero_mass": f"WITH {_E.format(w='1')} SELECT {_draw('e', 'w', _u('draw', 0))} AS id",
        "kmeanspp_seeds": _seeds(),
        "bucket_assignment": f"{_BUCKETS} SELECT event_id, bucket FROM b",
        "bucket_occupancy": f"{_BUCKETS} SELECT bucket, count(*) AS n FROM b GROUP BY bucket",
        "bucket_levels": f"SELECT (CASE WHEN q = 0 THEN 1 ELSE 1 + length(bin(q)) END)::INTEGER AS levels FROM (SELECT count(*) // {M} AS q FROM events)",
        "union_size": f"SELECT (n % {M} + {M} * bit_count(n // {M}))::BIGINT AS n, n::DOUBLE AS mass FROM (SELECT count(*) AS n FROM events)",
        "partial_coreset_mass": "SELECT count(*)::DOUBLE AS mass FROM events",
        "merged_coreset_mass": "SELECT count(*)::DOUBLE AS mass, true AS fits FROM events",
        "coreset_mass_weighted": "SELECT round(sum(l_quantity), 4) AS mass, true AS fits FROM lineitem",
        "grouped_coreset_mass": "SELECT event_type, count(*)::DOUBLE AS mass, true AS fits FROM events GROUP BY event_type",
        "coreset_subset": "SELECT 0::BIGINT AS strangers",
        "coreset_identity_small": "SELECT n_nationkey::DOUBLE AS x0, n_regionkey::DOUBLE AS x1, 1.0::DOUBLE AS w FROM nation",
        "error_model": """SELECT p::INTEGER AS partitions, d::INTEGER AS depth, s::INTEGER AS scale, (d * (s - 1))::INTEGER AS levels, round(pow(1.1::DOUBLE, d * (s - 1)) - 1, 9) AS tolerance
            FROM (SELECT p, d, greatest(2, ceil(pow(p, 1.0::DOUBLE / d) - 1e-12))::INTEGER AS s FROM (SELECT unnest([1, 2, 4, 8, 16, 100]) AS p), (SELECT unnest([1, 2, 3]) AS d))""",
        "coreset_quality": "SELECT 0.0::DOUBLE AS excess",
        "distributed_vs_sequential": "SELECT 0.0::DOUBLE AS gap",
        "stream_batches": "SELECT 4::BIGINT AS batches, count(*)::DOUBLE AS mass FROM events",
        "stream_sinks": f"SELECT 4::BIGINT AS heard, {4 * K}::BIGINT AS centers_heard, 4::BIGINT AS metrics, {4 * K}::BIGINT AS centers, {K}::BIGINT AS newest",
        "stream_vs_batch": "SELECT 1.0::DOUBLE AS ratio",
        "mixture_noise": f"SELECT j::INTEGER AS j, place::INTEGER AS place, 0.0::DOUBLE AS off, 0.5::DOUBLE AS sigma FROM range(2) a(j), range({K}) b(place)",
        "file_points": f"SELECT {_LINES} AS x0, user_id::DOUBLE AS x1, 1.0::DOUBLE AS w FROM events WHERE {kept}",
        "file_head": f"SELECT count(*) AS n, round(sum(user_id), 3)::DOUBLE AS total FROM (SELECT * FROM events ORDER BY event_id LIMIT 350) WHERE {kept}",
        "file_loan": f"SELECT count(*) AS n, 100.0::DOUBLE AS mass_of_100 FROM events WHERE {kept}",
        "file_cost": f"SELECT round(sum(least({file_d2})) / 1e6, 3) AS cost_e6 FROM events WHERE {kept}",
        "csv_round_trip": """SELECT p_name || ', "a"' || chr(10) || p_type AS dataset, p_brand AS method, p_size AS k, 1::INTEGER AS m, 2::INTEGER AS run, p_partkey AS seed, p_retailprice AS cost FROM part""",
        "features_frame": "SELECT count(*) AS n, round(sum(embedding[1]::DOUBLE), 6) AS first, round(sum(embedding[-1]::DOUBLE), 6) AS last FROM embeddings",
        "approximate_equality": f"SELECT count(*) FILTER (abs(value - round(value, 1)) <= 0.01) AS near, {200 * K}::BIGINT AS m FROM events",
        "nearest_distance": f"{_setup(1, '1')} SELECT id, round(sqrt({_D2.format('x', 'c')}), 6) AS distance FROM e, c",
        "point_count": "SELECT count(*) AS n, count(DISTINCT l_quantity) AS weights FROM lineitem",
        "lloyd_step_relational": _LLOYD_STEP,
        "lloyd_tolerance": _tolerance(),
        "fit_restarts": f"WITH {_REGIONS}",
        "fit_kernel": f"WITH {_REGIONS}",
        "cluster_regions": f"WITH {_REGIONS}",
        "coreset_cells": _cells(),
        "sketch_extract": """SELECT n AS seen, (n % 7 + 7 * bit_count(n // 7))::BIGINT AS in_union, least(7, n % 7 + 7 * bit_count(n // 7))::BIGINT AS extracted, n::DOUBLE AS mass, true AS whole,
            (CASE WHEN n < 7 THEN 1 ELSE 1 + length(bin(n // 7)) END)::INTEGER AS levels FROM (SELECT count(*) AS n FROM supplier)""",
        "self_check": "SELECT unnest(['squared distance', 'two clusters', 'weighted mean', 'coreset', 'sketch']) AS name, true AS ok",
        "demo": "SELECT 1.0::DOUBLE AS ratio, 1.0::DOUBLE AS scaled, 0.0::DOUBLE AS deviation",
        "sweeps": """SELECT 'supplier' AS dataset, method, k::INTEGER AS k, m::INTEGER AS m, 1::INTEGER AS run, 2026::BIGINT AS seed, 1.0::DOUBLE AS over
            FROM (VALUES (2, 400), (3, 600), (3, 50), (3, 400)) a(k, m), (VALUES ('sequential'), ('distributed')) b(method)""",
    }
