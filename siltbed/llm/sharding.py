"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells; a row's cell comes from its key's hash, and a
cell belongs to the next virtual node clockwise. Only the row counts of the cells (a number
that doesn't grow with the data) reach the driver, which pours them into the shards: every arc
first fills its own shard, and what a full shard turns away moves on clockwise, node by node.
The outcome is a short list of (cell, ranks, shard) ranges that the rows look up by their rank
within the cell, so one shuffle places everything and each shard's slots come out gapless.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.storage import materialize

#: Cells of the ring, a power of two; bounds what reaches the driver and what is broadcast.
CELLS = 1 << 14


@dataclass(frozen=True)
class Ring:
    """``vnodes`` virtual nodes for each of ``shards`` shards, on ``cells`` cells."""

    shards: int
    vnodes: int = 64
    cells: int = CELLS

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the virtual nodes in ring order, and their shards. Growing the ring only adds nodes."""
        taken: dict[int, int] = {}
        for shard in range(self.shards):
            for v in range(self.vnodes):
                digest = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()
                cell = int.from_bytes(digest, "big") % self.cells
                while cell in taken:
                    cell = (cell + 1) % self.cells
                taken[cell] = shard
        order = np.array(sorted(taken))
        return order, np.array([taken[c] for c in order.tolist()])

    def pour(self, counts: np.ndarray, capacity: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
        """(cell, first rank, end rank, shard, first slot) ranges for ``counts`` rows per cell."""
        where, shard = self.nodes()
        n = len(where)
        arc_of = np.searchsorted(where, np.arange(self.cells)) % n
        # Rows of an arc in ring order; the last arc's cells wrap around the origin.
        cells = sorted(np.flatnonzero(counts).tolist(), key=lambda c: (arc_of[c], (c - where[arc_of[c] - 1]) % self.cells))
        left = np.bincount(arc_of, weights=counts, minlength=n).astype(np.int64)
        free, used = list(capacity), [0] * self.shards
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]  # (rows, shard, first slot)
        waiting = np.flatnonzero(left).tolist()
        for hop in range(n):
            if not waiting:
                break
            for arc in waiting:
                s = int(shard[(arc + hop) % n])
                take = min(int(left[arc]), free[s])
                if take:
                    runs[arc].append((take, s, used[s]))
                    left[arc] -= take
                    free[s] -= take
                    used[s] += take
            waiting = [a for a in waiting if left[a]]
        if waiting:
            raise ValueError("the shards' capacities are less than the rows")
        out = []
        for c in cells:
            rank, need, mine = 0, int(counts[c]), runs[arc_of[c]]
            while need:
                rows, s, slot = mine[0]
                take = min(rows, need)
                out.append((c, rank, rank + take, s, slot))
                rank, need = rank + take, need - take
                mine[:1] = [(rows - take, s, slot + take)] if rows > take else []
        return out


def even_capacity(rows: int, shards: int) -> list[int]:
    """Capacities that the rows just fill: load bound 1, counts at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def loose_capacity(rows: int, shards: int, load: float) -> list[int]:
    """The usual bound: ``load`` times the mean, rounded up."""
    return [max(-(-rows // shards), int(np.ceil(load * rows / shards)))] * shards


def shard_documents(docs: DataFrame, shards: int = 16, vnodes: int = 64, load: float = 1.0, hot_rows: int = 50_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    A row's place on the ring comes from ``doc_id``; a null one takes its place from the text's
    checksum. With ``load`` 1 every shard is filled to its exact share, so that counts are at
    most one apart (law ``rows``); a larger ``load`` moves fewer rows off their own arc (law
    ``load``). ``slot`` numbers each shard's rows from 0 without gaps; ``grown_shard`` is null,
    as only the law ``key`` has one. Equal rows are placed one by one, in any order. Null texts
    have size 1 and checksum 0. An empty table gives an empty result. Other columns aren't read.

    A cell with more than ``hot_rows`` rows and twice the mean (a key that repeats without end)
    is ranked in parts, by the task that wrote the row, so no task has to sort it alone.
    """
    spark = docs.sparkSession
    text = F.encode(F.col("text"), "UTF-8")
    slim = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(-1), "text_crc32")).otherwise(F.xxhash64(F.lit(1), "doc_id"))
    slim = materialize(slim.select("*", F.pmod(key, F.lit(CELLS)).cast("int").alias("cell"), F.spark_partition_id().alias("part")), "ring")
    counts = np.zeros(CELLS, np.int64)
    for r in slim.groupBy("cell").count().collect():  # at most CELLS rows
        counts[r["cell"]] = r["count"]
    total = int(counts.sum())
    capacity = even_capacity(total, shards) if load <= 1 else loose_capacity(total, shards, load)
    ranges = Ring(shards, vnodes).pour(counts, capacity)
    hot = np.flatnonzero(counts > max(hot_rows, 2 * total / CELLS)).tolist()

    sub = F.when(F.col("cell").isin(hot), F.col("part")).otherwise(-1) if hot else F.lit(-1)
    rows = slim.withColumn("sub", sub)
    within = Window.partitionBy("cell", "sub").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", (F.row_number().over(within) - 1).cast("long"))
    if hot:
        parts = rows.filter(F.col("sub") >= 0).groupBy("cell", "sub").agg(F.count("*").alias("n"))
        before = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("cell", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
        ranked = ranked.join(parts, ["cell", "sub"], "left").withColumn("rank", F.col("rank") + F.coalesce("skip", F.lit(0)))
    # At most CELLS + shards * vnodes * shards ranges, whatever the data.
    places = spark.createDataFrame(ranges, "cell int, lo long, hi long, shard int, slot0 long").groupBy("cell").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "shard", "slot0"))).alias("ranges"))
    fit = F.filter("ranges", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0]
    return ranked.join(F.broadcast(places), "cell").withColumn("place", fit).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows" if load <= 1 else "load").alias("law"),
        F.col("place.shard").cast("int").alias("shard"),
        (F.col("place.slot0") + F.col("rank") - F.col("place.lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
