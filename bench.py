"""Headline queries of the clustering engine over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siltbed.operators import coreset, cost, lloyd, sampling  # noqa: E402
from siltbed.plans import catalogue, experiments  # noqa: E402
from siltbed.sources import points as sources  # noqa: E402


def session(cpus: str) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session(cpus)
    vectors = catalogue.embeddings(spark, sf_dir).persist()
    lines = sources.from_columns(catalogue.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).repartition(int(cpus)).persist()
    n_vectors, n_lines = vectors.count(), lines.count()
    centers = catalogue.first_centers(vectors, 10)
    keyed = lines.withColumn("id", F.monotonically_increasing_id())
    stream = catalogue.stream_input(spark, sf_dir)  # the files that the stream will find
    extra: dict[str, float] = {"vectors": n_vectors, "lines": n_lines, "cpus": int(cpus)}

    def done(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    def mllib() -> None:
        extra["mllib_sse"] = experiments.mllib_cost(sources.to_features(lines), 10, 42, 5)

    def ours() -> None:
        extra["coreset_sse"] = experiments.cluster(lines, 10, 2000).cost

    def mllib_vectors() -> None:
        extra["mllib_sse_vectors"] = experiments.mllib_cost(sources.to_features(vectors), 10, 42, 5)

    def ours_vectors() -> None:
        extra["coreset_sse_vectors"] = experiments.cluster(vectors, 10, 2000).cost

    work = {
        "sse_expression": lambda: done(cost.sse(lines, catalogue.LINE_CENTERS)),
        "sse_arrow": lambda: done(cost.sse_arrow(lines, catalogue.LINE_CENTERS)),
        "sse_embeddings": lambda: done(cost.sse_by_cluster(vectors, centers)),
        "lloyd_step": lambda: done(lloyd.step(lines, catalogue.LINE_CENTERS)),
        "lloyd_10_iterations": lambda: lloyd.lloyd(lines, catalogue.LINE_CENTERS, 10, -1.0),
        "seed_10_centers": lambda: sampling.seed_centers(keyed, 10, 42),
        "coreset_lineitem_m2000": lambda: done(coreset.merged_coreset(lines, 2000)),
        "bucket_assignment": lambda: done(catalogue.bucket_assignment(spark, sf_dir)),
        "cluster_lineitem_k10": ours,
        "mllib_lineitem_k10": mllib,
        "cluster_embeddings_k10": ours_vectors,
        "mllib_embeddings_k10": mllib_vectors,
        "stream_events": lambda: catalogue.run_stream(spark, stream),
    }
    seconds = {}
    work["sse_arrow"]()  # starts the Python workers and compiles the scan
    for name, run in work.items():
        began = time.time()
        run()
        seconds[name] = round(time.time() - began, 3)
    extra["sse_ratio_lineitem"] = round(extra["coreset_sse"] / extra["mllib_sse"], 5)
    extra["sse_ratio_embeddings"] = round(extra["coreset_sse_vectors"] / extra["mllib_sse_vectors"], 5)
    ours_only = sum(v for k, v in seconds.items() if not k.startswith("mllib"))
    print(json.dumps({"metric": "seconds of the engine's headline queries", "value": round(ours_only, 3), "unit": "sec", "queries": seconds, "sf": sf_dir, "extra": extra}))


if __name__ == "__main__":
    main()
