"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.storage import materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges with u > v."""
    least = _least(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def lookup(rows: DataFrame, names: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` joined with ``names``, which has a row for each value of ``on``.

    The rows of a hot value are dealt to ``salts`` parts by a hash of ``spread``, each with its copy of the name.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    copies = names.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [*on, "__salt"], how).drop("__salt")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its least node.

    Edges stay distributed; each round is written to the shared folder. A hub's edges meet in a
    join that splits skewed partitions, never in a list. Rounds grow with the logarithm of the
    longest path. Edges with a null end link nothing; without edges the result is empty.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialize(edges, "edges"), None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
        edges = materialize(_small_star(_large_star(edges)), "edges")
    raise RuntimeError("the components didn't settle")
