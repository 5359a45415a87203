import math

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltbed.operators import coreset, cost, kernel, lloyd, sampling
from siltbed.operators.ranking import chunked, ranked
from siltbed.plans import experiments
from siltbed.sources import points as P


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x], float(w)) for i, (x, w) in enumerate(rows)], "id long, x array<double>, w double")


def blobs(n, k, d, sigma=0.5, seed=1):
    rng = np.random.default_rng(seed)
    centers = np.array(P.mixture_centers(k, d))
    return centers[rng.integers(0, k, n)] + rng.normal(0, sigma, (n, d)), centers


def deviation(truth, found):
    return math.sqrt(cost.distances(np.asarray(truth, float), np.asarray(found, float)).min(axis=1).max())


SQUARE = [((0, 0), 1), ((0, 2), 1), ((10, 10), 1), ((10, 12), 1)]


def test_sse_by_hand(spark):
    p = frame(spark, [((-1,), 1), ((0,), 1), ((1,), 1)])
    for form in (cost.sse(p, [[0.0]]), cost.sse_arrow(p, [[0.0]]), cost.sse_join(p, cost.centers_frame(p, [[0.0]]))):
        assert form.first()["cost"] == 2
    assert cost.cost(p.limit(0), [[0.0]]) == 0 and cost.sse(p.limit(0), [[0.0]]).first()["cost"] == 0


def test_cost_does_not_depend_on_partitions(spark):
    x, c = blobs(3000, 3, 2)
    p = frame(spark, [(r, 1) for r in x])
    expected = kernel.sse(x, np.ones(len(x)), c)
    for n in (1, 3, 9):
        assert cost.cost(p.repartition(n), c.tolist()) == pytest.approx(expected, rel=1e-9)
    assert cost.cost(p, [[1000.0, 1000.0]]) > 10 * expected


def test_lloyd_by_hand(spark):
    p = frame(spark, SQUARE)
    model = lloyd.lloyd(p, [[0.0, 0.0], [10.0, 10.0]])
    assert model.cost == 4 and model.centers == [[0, 1], [10, 11]] and model.k == 2
    assert lloyd.lloyd(p, [[0.0, 0.0]], max_iter=0).centers == [[0, 0]]
    x, w = np.array([r[0] for r in SQUARE], float), np.ones(4)
    assert kernel.lloyd(x, w, np.array([[0.0, 0], [10, 10]]))[1] == 4


def test_weights_are_copies(spark):
    weighted, copies = frame(spark, [((0, 0), 3), ((10, 0), 1)]), frame(spark, [((0, 0), 1)] * 3 + [((10, 0), 1)])
    a, b = lloyd.lloyd(weighted, [[0.0, 0.0]]), lloyd.lloyd(copies, [[-5.0, 0.0]])
    assert a.centers == b.centers == [[2.5, 0]] and a.cost == b.cost == 75


def test_empty_and_massless_clusters_stay(spark):
    p = frame(spark, [((0,), 1), ((50,), 0)])
    new, _ = lloyd.fused_step(p, np.array([[0.0], [50.0], [99.0]]))
    assert new.tolist() == [[0], [50], [99]]
    rows = {r["cid"]: r["v"] for r in lloyd.step(p, [[0.0], [50.0], [99.0]]).collect()}
    assert rows == {0: 0, 1: 50, 2: 99}


def test_fit_on_the_full_table(spark):
    x, c = blobs(2000, 4, 2)
    model = lloyd.fit(frame(spark, [(r, 1) for r in x]), 4, restarts=2)
    assert deviation(c, model.centers) < 0.2
    with pytest.raises(ValueError):
        lloyd.fit(frame(spark, SQUARE), 2, restarts=0)


def test_lloyd_falls_from_any_start():
    x, _ = blobs(3000, 4, 3)
    w = np.ones(len(x))
    assert kernel.lloyd(x, w, np.zeros((4, 3)))[1] <= kernel.sse(x, w, np.zeros((4, 3)))


def test_seeding():
    x, _ = blobs(500, 5, 4)
    rng = kernel.generator(1)
    assert kernel.seed(x, np.ones(500), 5, rng).shape == (5, 4)
    assert len(kernel.seed(x[:2], np.ones(2), 10, rng)) == 2
    for bad in ((x[:0], 3), (x, 0)):
        with pytest.raises(ValueError):
            kernel.seed(bad[0], np.ones(len(bad[0])), bad[1], rng)
    far = np.concatenate([np.random.default_rng(s).normal(1000 * s, 1, (300, 1)) for s in range(3)])
    hits = sum(len({round(v[0] / 1000) for v in kernel.seed(far, np.ones(900), 3, kernel.generator(t))}) == 3 for t in range(20))
    assert hits >= 18


def test_more_restarts_are_no_worse():
    x, _ = blobs(2000, 6, 2, 2.0)
    w = np.ones(len(x))
    assert kernel.fit(x, w, 6, 5, key=(33,))[1] <= kernel.fit(x, w, 6, 1, key=(33,))[1]


def test_weighted_draw(spark):
    w = np.array([1.0, 0.0, 3.0])
    assert [kernel.draw(w, u) for u in (0.0, 0.25, 0.26, 0.999)] == [0, 0, 2, 2]
    assert kernel.draw(np.zeros(4), 0.6) == 2
    p = frame(spark, [((0,), 1), ((1,), 0), ((2,), 3)])
    assert [sampling.weighted_draw(p, u).first()["id"] for u in (0.25, 0.26, 1.0)] == [0, 2, 2]
    assert sampling.weighted_draw(p.limit(0), 0.5).count() == 0
    assert sampling.weighted_draw(p.withColumn("w", F.lit(0.0)), 0.5).first()["id"] == 1
    wide = spark.range(10_000).select((F.col("id") * 7).alias("id"), F.lit(1.0).alias("w"))
    assert sampling.weighted_draw(wide, 0.5).first()["id"] == 7 * 4999


def test_table_seeding(spark):
    x, c = blobs(800, 4, 2)
    p = frame(spark, [(r, 1) for r in x])
    assert deviation(c, sampling.seed_centers(p, 4, 3)) < 10
    assert sampling.seed_centers(p.repartition(7), 4, 3) == sampling.seed_centers(p.repartition(2), 4, 3)
    assert len(sampling.seed_centers(frame(spark, [((1, 1), 1)] * 5), 3, 1)) == 1
    assert len(set(sampling.seed_ids(p.limit(40), 3, 7))) == 3
    race = sampling.race_draw(p, 5, "r", 10)
    assert race.count() == 10
    with pytest.raises(ValueError):
        sampling.seed_centers(p.limit(0), 2, 1)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(1, 60), st.integers(1, 4), st.integers(0, 99))
def test_coreset_keeps_mass_and_size(n, m, distinct, seed):
    rng = np.random.default_rng(seed)
    x, w = rng.integers(0, distinct * 3, (n, 2)).astype(float), rng.integers(0, 9, n).astype(float)
    cx, cw = kernel.coreset(x, w, m, kernel.generator(seed))
    assert len(cx) <= max(m, 0) or n <= m
    assert cw.sum() == pytest.approx(w.sum()) and {tuple(r) for r in cx} <= {tuple(r) for r in x}


def test_coreset_identity_constant_and_quality():
    x, _ = blobs(20_000, 5, 2, seed=7)
    w = np.ones(len(x))
    assert kernel.coreset(x[:50], w[:50], 100, kernel.generator(1))[0] is not None and len(kernel.coreset(x[:50], w[:50], 100, kernel.generator(1))[0]) == 50
    same = kernel.coreset(np.full((1000, 2), 3.0), np.ones(1000), 50, kernel.generator(1))
    assert len(same[0]) <= 50 and same[1].sum() == 1000
    cx, cw = kernel.coreset(x, w, 200, kernel.generator(7))
    full, ours = kernel.fit(x, w, 5)[1], kernel.sse(x, w, kernel.fit(cx, cw, 5)[0])
    assert len(cx) <= 200 and ours <= 1.10 * full


def test_sketch_levels_follow_the_binary_counter():
    x, _ = blobs(4000, 4, 2, seed=9)
    s = kernel.Sketch(64)
    for a in range(0, 4000, 37):
        s.insert(x[a : a + 37])
        n = min(a + 37, 4000)
        assert s.check() and s.mass == n and sum(s.sizes()) == kernel.union_size(n, 64) and len(s.levels) == max(1, kernel.level_count(n, 64))
    counts = {}
    for r in range(4000):
        b = kernel.bucket_of(r, 4000, 64)
        counts[b] = counts.get(b, 0) + 1
    assert [counts.get(i, 0) for i in range(len(s.levels))] == [round(lv[1].sum()) if lv else 0 for lv in s.levels]


def test_sketch_of_duplicates_and_merge():
    same = kernel.Sketch(50).insert(np.full((1000, 2), 3.0))
    assert same.check() and same.extract()[1].sum() == 1000
    x, _ = blobs(10_000, 4, 2)
    a, b = kernel.Sketch(100, 1).insert(x[:4000]), kernel.Sketch(100, 2).insert(x[4000:])
    before = [a.sizes(), b.sizes()]
    both = a.merge(b)
    assert both.mass == 10_000 and both.extract()[1].sum() == pytest.approx(10_000) and [a.sizes(), b.sizes()] == before
    first, again = a.extract(), a.extract()
    assert (first[0] == again[0]).all()
    with pytest.raises(RuntimeError):
        both.insert(x[:1])
    with pytest.raises(ValueError):
        a.merge(kernel.Sketch(99))
    assert "mass" in repr(both) and len(kernel.Sketch(5).extract()[0]) == 0


def test_log_levels():
    assert kernel.level_count(100_000, 100) == 11


def test_partial_and_merged_coresets(spark):
    x, _ = blobs(8000, 4, 2)
    p = frame(spark, [(r, 1) for r in x])
    parts = coreset.partial_coresets(p.repartition(4), 200)
    nodes = {r["node"]: (r["mass"], r["n"]) for r in parts.groupBy("node").agg(F.sum("w").alias("mass"), F.count("*").alias("n")).collect()}
    assert len(nodes) == 4 and sum(v[0] for v in nodes.values()) == 8000 and max(v[1] for v in nodes.values()) <= 200
    for n in (1, 2, 9):
        got = coreset.merged_coreset(p.repartition(n), 300, fan=2).agg(F.sum("w"), F.count("*")).first()
        assert got[0] == pytest.approx(8000) and got[1] <= 300
    assert coreset.merged_coreset(p.limit(0), 300).count() == 0


def test_tasks_draw_differently(spark):
    x, _ = blobs(2000, 3, 2)
    p = frame(spark, [(r, 1) for r in x])
    two = [kernel.coreset(x, np.ones(2000), 50, kernel.generator(60, part))[0] for part in (0, 1)]
    assert {tuple(r) for r in two[0]} != {tuple(r) for r in two[1]}
    assert coreset.partial_coresets(p, 50, seed=1).exceptAll(coreset.partial_coresets(p, 50, seed=2)).count() > 0


def test_grouped_coresets_flush(spark, monkeypatch):
    x, _ = blobs(3000, 3, 2)
    p = frame(spark, [(r, 1) for r in x]).withColumn("g", F.concat(F.lit("g"), F.col("id") % 7))
    got = coreset.merged_coreset(p, 40, by=["g"]).groupBy("g").agg(F.sum("w").alias("mass"), F.count("*").alias("n")).collect()
    assert len(got) == 7 and all(r["n"] <= 40 for r in got) and sum(r["mass"] for r in got) == pytest.approx(3000)


def test_reduced_buckets_match_the_closed_form(spark):
    x, _ = blobs(1700, 3, 2)
    p = frame(spark, [(r, 1) for r in x]).repartition(3)
    rows = coreset.reduced_buckets(p, 100, ["id"]).groupBy("bucket").agg(F.sum("w").alias("mass"), F.count("*").alias("n")).collect()
    assert {r["bucket"]: (round(r["mass"]), r["n"]) for r in rows} == {1: (100, 100), 5: (1600, 100)}


def test_ranked_and_chunked(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("v")).repartition(5)
    assert all(r["rank"] == r["v"] for r in ranked(df, ["v"]).collect())
    assert {r["chunk"]: r["n"] for r in chunked(df, 300, ["v"]).groupBy("chunk").agg(F.count("*").alias("n")).collect()} == {0: 300, 1: 300, 2: 300, 3: 100}


def test_plans_agree(spark, tmp_path):
    x, c = blobs(6000, 5, 2, seed=33)
    p = frame(spark, [(r, 1) for r in x]).persist()
    ours, theirs = experiments.cluster(p.repartition(8), 5, 1000), experiments.mllib_cost(P.to_features(p), 5, 42, 2)
    assert ours.cost <= 1.10 * theirs and deviation(c, ours.centers) < 0.5
    single = experiments.sequential_cost(p, 5, 1000, 42)
    assert experiments.distributed_cost(p.repartition(8), 5, 1000, 42) <= 1.1**4 * single
    assert experiments.cluster(p.limit(0), 5) is None
    with pytest.raises(ValueError):
        experiments.distributed_cost(p.limit(0), 5, 100, 1)
    truth = cost.centers_frame(p, c.tolist())
    assert cost.max_center_deviation(truth, ours.frame(p)).first()["deviation"] == pytest.approx(deviation(c, ours.centers))
    path = tmp_path / "lines.csv"
    path.write_text("\n".join(",".join(map(repr, map(float, r))) + ",1" for r in x[:500]))
    by_file = experiments.sequential_cost_of_file(spark, str(path), 5, 200, 1, dim=2)
    assert by_file == pytest.approx(250, rel=0.2)  # n * d * sigma^2
    assert experiments.cost_of_file(spark, str(path), c.tolist(), dim=2) == pytest.approx(kernel.sse(x[:500], np.ones(500), c), rel=1e-9)
    p.unpersist()


def test_partition_keeps_points_with_the_nearer_representative():
    """After every split, the cost of a cell is that of its points around its representative, and no mass is lost."""
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(400, 3)), rng.integers(1, 5, 400).astype(float)
    for m in (2, 3, 10, 50, 399):
        cells = kernel.partition(x, w, m, kernel.generator(m))
        assert sorted(np.concatenate(cells.rows)) == list(range(400)) and len(cells.reps) == m
        for rep, rows, mass, cost_ in zip(cells.reps, cells.rows, cells.mass, cells.cost, strict=True):
            assert rep in rows and mass == w[rows].sum() and cost_ == pytest.approx(w[rows] @ ((x[rows] - x[rep]) ** 2).sum(axis=1))


def test_cost_tree_draws_like_running_sums():
    rng = np.random.default_rng(0)
    costs, plain = kernel.Costs(37), np.zeros(37)
    for _ in range(300):
        i = int(rng.integers(0, 37))
        plain[i] = rng.choice([0.0, rng.random()])
        costs.set(i, plain[i])
        u = rng.random()
        assert costs.total == pytest.approx(plain.sum())
        if plain.sum() > 0:
            assert costs.draw(u) == int(np.searchsorted(np.cumsum(plain), u * plain.sum(), side="right")) and plain[costs.draw(u)] > 0


def test_draw_with_outlying_and_repeated_ids(spark, monkeypatch):
    from siltbed.operators import sampling

    monkeypatch.setattr(sampling, "FEW", 5)
    monkeypatch.setattr(sampling, "CELLS", 8)
    ids = sorted([0, 2**62, *range(1000, 1060), *[1030] * 50])
    df = spark.createDataFrame([(i, 1.0 + i % 3) for i in ids], "id long, w double")
    running = np.cumsum([1.0 + i % 3 for i in ids])
    for u in (0.0, 0.001, 0.3, 0.5, 0.62, 0.97, 0.9999):
        assert sampling.weighted_draw(df, u).first()["id"] == ids[int(np.searchsorted(running, u * running[-1], side="left"))]


def test_equal_rows_are_points_of_their_own(spark):
    p = spark.createDataFrame([(1, [0.0], 1.0), (1, [4.0], 1.0), (1, [4.0], 1.0)], "id long, x array<double>, w double")
    assert cost.sse_join(p, cost.centers_frame(p, [[0.0], [1.0]])).first()["cost"] == 18


def test_release_deletes_intermediate_tables(spark):
    from siltbed import storage

    df = storage.materialize(spark.range(3), "gone")
    path = df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert os.path.isdir(path) and storage.release(spark) > 0 and not os.path.isdir(path) and storage.release(spark) == 0


def test_sweeps(spark):
    x, _ = blobs(400, 3, 2)
    p = frame(spark, [(r, 1) for r in x])
    rows = experiments.k_sweep(p, "toy", ks=(2, 3), runs=1)
    assert [r[1] for r in rows] == ["sequential", "distributed", "mllib"] * 2 and [r[3] for r in rows] == [400] * 3 + [600] * 3
    assert len(experiments.m_sweep(p, "toy", ms=(50,), k=3)) == 2


def test_small_functions(spark):
    assert [experiments.positive_int(t) for t in ("3", "0", "-1", "x", None)] == [3, None, None, None, None]
    cases = spark.createDataFrame([(8, 2), (4, 2), (1, 2)], "partitions int, depth int")
    got = {r["partitions"]: r for r in experiments.error_model(cases).collect()}
    assert got[8]["tolerance"] == pytest.approx(0.4641) and got[4]["tolerance"] == pytest.approx(0.21) and got[1]["scale"] == 2


def test_selfcheck():
    from siltbed.plans import selfcheck

    assert all(ok for _, ok in selfcheck.checks()) and selfcheck.main([]) == 0


def test_registered_baseline_is_the_best_of_five(spark, monkeypatch):
    from siltbed.plans import catalogue

    seeds = []

    class Fit:
        def __init__(self, seed, **_):
            seeds.append(seed)

        def fit(self, _):
            return type("Model", (), {"summary": type("Summary", (), {"trainingCost": 1.0})})

    monkeypatch.setattr(catalogue.experiments, "KMeans", Fit)
    monkeypatch.setattr(catalogue.experiments, "cluster", lambda *_: type("Model", (), {"cost": 1.0}))
    monkeypatch.setattr(catalogue, "embeddings", lambda *_: catalogue.sources.from_columns(spark.range(3), ["id"]))
    assert catalogue.coreset_quality(spark, "").first()["excess"] == 0.0 and len(set(seeds)) == 5
