"""Coresets of tables: one per task, then merged in rounds of bounded groups.

Nothing ever gathers a group of raw points: a task folds its rows into bucket sketches and emits
at most ``m`` weighted points per group, and a round of merging joins at most ``fan`` of those.
Every round is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.operators import cost, kernel
from siltbed.operators.ranking import ranked
from siltbed.storage import materialize

#: Points that a task holds over all its groups before it emits them.
HELD = 200_000
#: Raw points that a task reduces at once, in coreset sizes: fewer reductions, a smaller error.
GULP = 8
#: Points that a group of a merging round holds at most, unless two coresets are more.
ROUND = 50_000


def _rows(group: list, node: int, x: np.ndarray, w: np.ndarray, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = [pa.array([g] * len(x), t) for g, t in zip(group, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*cols, pa.array([node] * len(x), pa.int64()), pa.array(list(x), pa.list_(pa.float64())), pa.array(w, pa.float64())], names=[*names, "node", "x", "w"])


def _schema(points: DataFrame, by: list[str]) -> str:
    kinds = dict(points.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "node long", "x array<double>", "w double"])


def partial_coresets(points: DataFrame, m: int, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """(by.., node, x, w): a coreset of every task's rows of every group; ``node`` numbers the tasks.

    A task with very many groups emits what it holds in between, so a group may have several
    nodes' worth of points under one node; the rounds of merging take care of them.
    """
    by = by or []

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sketches: dict[tuple, kernel.Sketch] = {}
        raw: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        kinds: list[pa.DataType] = []
        flushed = 0

        def swallow(g: tuple) -> None:
            x, w = (np.concatenate(c) for c in zip(*raw.pop(g), strict=True))
            s = sketches[g]
            s.reductions += 1
            s.insert(*kernel.coreset(x, w, m, kernel.generator(*s.key, 4, s.reductions)))

        def flush() -> Iterator[pa.RecordBatch]:
            for g in list(raw):
                swallow(g)
            for g, s in sketches.items():
                yield _rows(list(g), part, *s.extract(), kinds, by)
            sketches.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(c).type for c in by]
            x, w = cost.flat(batch.column("x")), batch.column("w").to_numpy()
            where: dict[tuple, list[int]] = {}
            if by:
                for i, g in enumerate(zip(*(batch.column(c).to_pylist() for c in by), strict=True)):
                    where.setdefault(g, []).append(i)
            for g, rows in where.items() if by else [((), slice(None))]:
                if g not in sketches:
                    sketches[g] = kernel.Sketch(m, seed, part, len(sketches), flushed)
                raw.setdefault(g, []).append((x[rows], w[rows]))
                if sum(len(r[1]) for r in raw[g]) >= GULP * m:
                    swallow(g)
            if by and sum(sum(s.sizes()) for s in sketches.values()) + sum(len(r[1]) for rs in raw.values() for r in rs) > HELD:
                yield from flush()
                flushed += 1
        yield from flush()

    return points.select(*by, "x", "w").mapInArrow(fold, _schema(points, by))


def merge_round(parts: DataFrame, m: int, fan: int, seed: int, stage: int, by: list[str] | None = None) -> DataFrame:
    """One round: the points of every ``fan`` neighbouring nodes of a group become one node's."""
    by = by or []

    def reduce(table: pa.Table) -> pa.Table:
        x, w = cost.flat(table.column("x").combine_chunks()), table.column("w").to_numpy()
        order = np.lexsort((*x.T[::-1], w))  # the shuffle's order doesn't matter
        node = table.column("node")[0].as_py()
        x, w = kernel.coreset(x[order], w[order], m, kernel.generator(seed, stage, node))
        group = [table.column(c)[0].as_py() for c in by]
        return pa.Table.from_batches([_rows(group, node, x, w, [table.column(c).type for c in by], by)])

    grouped = parts.withColumn("node", F.floor(F.col("node") / fan).cast("long"))
    return grouped.groupBy(*by, "node").applyInArrow(reduce, _schema(parts, by))


def merged_coreset(points: DataFrame, m: int, seed: int = 42, fan: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(by.., x, w): one coreset of at most ``m`` points per group, of mass equal to the group's.

    ``fan`` coresets merge at a time; by default as many as :data:`ROUND` points allow, so that
    few rounds compound their error.
    """
    fan = fan or max(2, ROUND // m)
    parts = materialize(partial_coresets(points, m, seed, by), "coresets")
    last, stage = parts.agg(F.max("node")).first()[0], 0
    while last is not None:
        stage += 1
        parts = materialize(merge_round(parts, m, fan, seed, stage, by), "coresets")
        if last < fan:
            break
        last //= fan
    return parts.drop("node")


def bucket(rank: Column, n: Column, m: int) -> Column:
    """The bucket of the item of 0-based ``rank`` after ``n`` unit inserts, in closed form."""
    b, q = F.floor(rank / m).cast("long"), F.floor(n / m).cast("long")
    return F.when(b == q, 0).otherwise(F.length(F.bin(b.bitwiseXOR(q)))).cast("int")


def bucket_assignment(df: DataFrame, m: int, order: list[str]) -> DataFrame:
    """``df`` with the arrival ``rank`` of each row, its ``block`` of ``m`` and its ``bucket``."""
    out = ranked(df, order)
    n = F.lit(out.count())
    return out.withColumn("block", F.floor(F.col("rank") / m)).withColumn("bucket", bucket(F.col("rank"), n, m))


def reduced_buckets(points: DataFrame, m: int, order: list[str], seed: int = 42) -> DataFrame:
    """(bucket, x, w): the buckets that inserting the rows in ``order`` leaves, built level by level.

    Sibling blocks of a bucket are reduced pairwise, all in parallel; after as many rounds as the
    largest bucket's level nothing is left to merge.
    """
    parts = bucket_assignment(points, m, order).select("bucket", F.col("block").alias("node"), "x", "w")
    parts = parts.withColumn("bucket", F.col("bucket").cast("int"))
    top = parts.agg(F.max("bucket")).first()[0] or 0
    for stage in range(1, top):
        done, rest = parts.filter(F.col("bucket") <= stage), parts.filter(F.col("bucket") > stage)
        parts = materialize(done.unionByName(merge_round(rest, m, 2, seed, stage, ["bucket"])), "buckets")
    return parts.select("bucket", "x", "w")


def to_arrays(points: DataFrame, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A coreset's points on the driver, in an order that doesn't hang on the partitions."""
    rows = points.select("x", "w").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} points; reduce them first")
    if not rows:
        return np.zeros((0, 0)), np.zeros(0)
    x, w = np.array([r["x"] for r in rows], np.float64), np.array([r["w"] for r in rows], np.float64)
    order = np.lexsort((*x.T[::-1], w))
    return x[order], w[order]
