import time

import numpy as np
import pytest

from siltbed.operators import kernel
from siltbed.sources import points as P
from siltbed.streaming import clustering

PARAMS = clustering.Params(3, 100, restarts=2)


def write(spark, path, n, seed, k=3):
    rng = np.random.default_rng(seed)
    centers = np.array(P.mixture_centers(k, 2))
    x = centers[rng.integers(0, k, n)] + rng.normal(0, 0.5, (n, 2))
    spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


def start(spark, root, heard, **options):
    source = spark.readStream.schema("features array<double>").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = clustering.run(source, PARAMS, lambda m, b: heard.append((b, m)), state=f"{root}/state", checkpoint=f"{root}/ckpt", trigger={"availableNow": True}, **options)
    query.awaitTermination()
    assert query.exception() is None


def test_mass_restart_and_view(spark, tmp_path):
    root, heard = f"file://{tmp_path}", []
    for n in (400, 300):
        write(spark, f"{root}/in", n, n)
    start(spark, root, heard, view="newest", ks=[2, 3])
    masses = {r["batch_id"]: r["mass"] for r in clustering.batch_mass(f"{root}/state", spark).collect()}
    assert sorted(masses) == [0, 1] and masses[1] == 700 and [b for b, _ in heard] == [0, 0, 1, 1]
    assert spark.table("newest").count() == 5
    write(spark, f"{root}/in", 500, 9)
    start(spark, root, heard)
    assert max(r["mass"] for r in clustering.batch_mass(f"{root}/state", spark).collect()) == 1200
    centers = np.array(heard[-1][1].centers)
    truth = np.array(P.mixture_centers(3, 2))
    assert np.sqrt(((truth[:, None] - centers[None]) ** 2).sum(-1)).min(axis=1).max() < 1


def test_replay_and_empty_batches(spark, tmp_path):
    store = clustering.SketchStore(spark, f"file://{tmp_path}/s", PARAMS)
    empty = spark.createDataFrame([], "x array<double>, w double")
    batch = spark.createDataFrame([([float(i), 0.0], 1.0) for i in range(250)], "x array<double>, w double")
    sketch, added = clustering.integrate(empty, 0, PARAMS, store)
    assert added and sketch.mass == 0 and clustering.model_of(sketch, 3, PARAMS) is None
    assert clustering.integrate(batch, 1, PARAMS, store)[0].mass == 250
    again, added = clustering.integrate(batch, 1, PARAMS, store)
    assert not added and again.mass == 250 and again.check()
    assert clustering.integrate(batch, 2, PARAMS, store)[0].mass == 500
    assert store.batches() == [1, 2]
    loaded = store.load(2)
    assert loaded.mass == 500 and loaded.check() and isinstance(loaded, kernel.Sketch)


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        clustering.Params(0, 10)
