"""Hand-computed checks of the kernels: ``python -m siltbed.plans.selfcheck [labelled text file]``."""

from __future__ import annotations

import sys

import numpy as np

from siltbed.operators import kernel
from siltbed.operators.cost import distances
from siltbed.plans.experiments import DIMENSIONS


def checks() -> list[tuple[str, bool]]:
    square = np.array([[0.0, 0], [0, 2], [10, 10], [10, 12]])
    centers, cost, _ = kernel.lloyd(square, np.ones(4), square[[0, 2]])
    pair, cost_pair, _ = kernel.lloyd(np.array([[0.0, 0], [10, 0]]), np.array([3.0, 1]), np.zeros((1, 2)))
    line = np.stack([np.arange(100.0), np.zeros(100)], axis=1)
    x, w = kernel.coreset(line, np.ones(100), 10, kernel.generator(1))
    sketch = kernel.Sketch(10).insert(line)
    found = [
        ("squared distance", float(distances(np.zeros((1, 2)), np.array([[3.0, 4]]))[0, 0]) == 25),
        ("two clusters", cost == 4 and centers.tolist() == [[0, 1], [10, 11]]),
        ("weighted mean", cost_pair == 75 and pair.tolist() == [[2.5, 0]]),
        ("coreset", len(x) <= 10 and abs(w.sum() - 100) < 1e-9),
        ("sketch", sketch.check() and abs(sketch.extract()[1].sum() - 100) < 1e-9),
    ]
    return [(name, bool(ok)) for name, ok in found]


def main(argv: list[str]) -> int:
    results = checks()
    if argv:
        from pyspark.sql import SparkSession

        from siltbed.sources.points import read_points

        spark = SparkSession.builder.getOrCreate()
        results.append((f"points in {argv[0]}", read_points(spark, argv[0], DIMENSIONS).count() > 0))
    for name, ok in results:
        print(f"{'ok  ' if ok else 'FAIL'} {name}")
    return int(not all(ok for _, ok in results))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
