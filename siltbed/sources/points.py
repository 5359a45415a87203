"""Weighted points (x ARRAY<DOUBLE>, w DOUBLE) from text lines, tables, streams and generators."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.vectors import is_point

A = TypeVar("A")

#: Spellings of numbers that count, blanks around them aside: decimal, with exponent or type
#: suffix, hexadecimal, NaN and Infinity; no other word.
NUMBER = r"^[+-]?(NaN|Infinity|((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*[pP][+-]?\d+)[dDfF]?)$"


def fields(line: Column, sep: str = ",") -> Column:
    """The separated fields of a trimmed line; empty ones at its end don't count."""
    quoted = "".join(f"\\u{ord(c):04x}" for c in sep)
    trimmed = F.regexp_replace(line, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.split(F.regexp_replace(trimmed, f"({quoted})+$", ""), quoted)


def numbers(parts: Column) -> Column:
    """Fields as doubles, null where one isn't a number."""
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return F.transform(trimmed, lambda p: F.when(p.rlike(NUMBER), p.try_cast("double")))


def parse_points(lines: DataFrame, dim: int, sep: str = ",", drop_label: bool = False, finite_only: bool = True, line: str = "value") -> DataFrame:
    """The lines of exactly ``dim`` numbers, as unit points; other lines are left out.

    ``drop_label``: lines have at least ``dim`` fields, of which the first ``dim`` are taken.
    The columns of ``lines`` stay, so an order key survives.
    """
    parts = fields(F.col(line), sep)
    fit = F.size(parts) >= dim if drop_label else F.size(parts) == dim
    out = lines.withColumn("x", F.when(fit, numbers(F.slice(parts, 1, dim))))
    return out.filter(is_point(F.col("x"), dim, finite_only)).withColumn("w", F.lit(1.0))


def head_lines(lines: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` lines by the key ``order``, malformed ones included."""
    return lines.orderBy(order).limit(n)


def read_lines(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """(value) lines of text files; the first ``max_lines`` in file order, if given."""
    lines = spark.read.text(path)
    if max_lines is None:
        return lines
    where = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return where.orderBy("file", "block", "n").limit(max_lines).select("value")


def read_points(spark: SparkSession, path: str, dim: int = 54, max_lines: int | None = None, partitions: int | None = None, drop_label: bool = True) -> DataFrame:
    """(x, w) of labelled text lines, in ``partitions`` partitions if given."""
    points = parse_points(read_lines(spark, path, max_lines), dim, drop_label=drop_label).select("x", "w")
    return points.repartition(partitions) if partitions else points


def collect_points(points: DataFrame, limit: int = 1_000_000) -> list[tuple[list[float], float]]:
    """Points on the driver; refuses more than ``limit``."""
    rows = points.select("x", "w").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} points; keep them distributed")
    return [(list(r["x"]), r["w"]) for r in rows]


def with_points(spark: SparkSession, path: str, dim: int, use: Callable[[DataFrame], A], max_lines: int | None = None) -> A:
    """What ``use`` makes of the file's points, which are cached only meanwhile."""
    points = read_points(spark, path, dim, max_lines).persist()
    try:
        return use(points)
    finally:
        points.unpersist()


def from_columns(df: DataFrame, columns: list[str], weight: str | Column | None = None, key: list[str] | None = None) -> DataFrame:
    """(key.., x, w) from numeric columns; rows with a null or non-finite coordinate are left out."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    out = df.select(*(key or []), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), w.alias("w"))
    return out.filter(is_point(F.col("x"), len(columns)) & (F.col("w") >= 0))


def from_features(df: DataFrame, column: str = "features", key: list[str] | None = None) -> DataFrame:
    """(key.., x, w) of an array column of any numeric type, batch or streaming; null arrays are left out."""
    out = df.select(*(key or []), F.col(column).cast("array<double>").alias("x"), F.lit(1.0).alias("w"))
    return out.filter(is_point(F.col("x")))


def to_features(points: DataFrame) -> DataFrame:
    """One non-null dense vector column, for MLlib; weights are dropped."""
    return points.select(array_to_vector("x").alias("features"))


def mixture_centers(k: int, d: int, spread: float = 20.0) -> list[list[float]]:
    """Centres of the synthetic mixture, at least ``spread`` apart."""
    return [[(c + 1) * (j + 1) % k * spread for j in range(d)] for c in range(k)]


def mixture(spark: SparkSession, n: int, k: int, d: int, sigma: float = 0.5, spread: float = 20.0, seed: int = 12345, partitions: int | None = None) -> DataFrame:
    """(id, x, w): ``n`` points of an isotropic Gaussian mixture around :func:`mixture_centers`."""
    ids = spark.range(n, numPartitions=partitions) if partitions else spark.range(n)
    cid = F.floor(F.rand(seed) * k).cast("int")
    noise = [F.randn(seed + 1 + j) * sigma for j in range(d)]
    out = ids.withColumn("c", cid)
    x = F.array(*[((F.col("c") + 1) * (j + 1) % k) * spread + noise[j] for j in range(d)])
    return out.select("id", x.alias("x"), F.lit(1.0).alias("w"))

