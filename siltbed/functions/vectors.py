"""Distances between ``array<double>`` points as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(point: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in point])


def literal_centers(centers: Sequence[Sequence[float]]) -> Column:
    """Centres as one array column; their index is the cluster id."""
    return F.array(*[literal(c) for c in centers])


def sqdist(a: Column, b: Column) -> Column:
    """The squared Euclidean distance, by direct differences; null where the dimensions differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), total)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sqdist(a, b))


def nearest(x: Column, centers: Column) -> Column:
    """struct(d2, cid) of the nearest centre; of equally near ones, the one with the lowest index."""
    return F.array_min(F.transform(centers, lambda c, i: F.struct(sqdist(x, c).alias("d2"), i.alias("cid"))))


def approx_equal(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return F.abs(a - b) <= eps


def is_point(x: Column, dim: int | None = None, finite_only: bool = True) -> Column:
    """Whether ``x`` is an array of ``dim`` numbers without nulls (and, if asked for, all finite)."""
    ok = x.isNotNull() & F.forall(x, lambda v: v.isNotNull())
    if finite_only:
        ok = ok & F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    if dim is not None:
        ok = ok & (F.size(x) == dim)
    return F.coalesce(ok, F.lit(False))


def recommended_size(k: int) -> int:
    """The usual coreset size for ``k`` clusters."""
    return 200 * k
