"""Mixing sources to target weights by capped water-filling.

Sources share the corpus' words by weight; a source's target is clamped at ``max_epochs`` times
its size and the excess is dealt to the others by weight until none is above its clamp. Every
document is taken as often as its source's target holds the source whole; the fraction that
remains is filled with documents in a seeded order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators.ranking import ranked
from siltbed.storage import materialize

#: Rows that a cell of a source's seeded order should hold, and the most cells that a source has.
CELL_ROWS, CELLS = 2000, 1 << 20
#: Up to this number of sources (about 10 MB), their plan is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(seed: int, *columns: Column) -> Column:
    """60 bits of the md5 of the seed and the columns as text, joined by ``|``; nulls are passed over."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in columns)).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``sources`` (words, weight, ..) with ``target``: shares of all words in proportion to ``weight``.

    A target never exceeds ``max_epochs`` times its source's words. Sources that would are clamped
    there, and the excess is dealt to the others by weight, until none is above its clamp; every
    round is one sum over the sources, of which only the totals reach the driver.
    """
    exact = "decimal(19,0)"
    cap = (F.col("words") * max_epochs).cast(exact)
    free = F.lit(True)
    while True:
        sums = [F.coalesce(F.sum(F.when(c, v).otherwise(0)), F.lit(0)) for c, v in ((F.lit(True), F.col("words")), (~free, F.col("words") * max_epochs), (free, F.col("weight")))]
        total, clamped, weight = sources.agg(*sums).first()
        left = F.lit(total - clamped).cast(exact)
        now = cap * F.lit(weight).cast(exact) >= left * F.col("weight").cast(exact)
        if sources.filter(free & ~now).isEmpty():
            share = F.lit(total - clamped) * F.col("weight") / F.lit(max(1, weight))
            return sources.withColumn("target", F.when(free, share).otherwise((F.col("words") * max_epochs).cast("double")))
        free = free & now


def mix_documents(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 42, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``size`` counts the text's words, ``taken`` the words that the mix takes of the document,
    repeats counted. Sources rank by code point, a null source last, and weigh ``cycle`` in turn.
    The order in which the fractional repetition takes documents hangs on ``seed``, ``doc_id`` and
    ``size`` alone, so reruns agree. The document at its end gives as many words as are still
    missing (``whole``: all or none, whichever is nearer, and ``taken`` is a multiple of ``size``).
    Null and empty texts have size 0 and are taken 0 times in words. Rows that repeat a doc_id
    count one by one. An empty table gives an empty result. Other columns aren't read.

    Sources stay a table: only totals reach the driver. Documents are ordered cell by cell, and only
    the one cell of each source in which its fraction ends is ordered row by row.
    """
    slim = materialize(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("h", seeded(seed, F.col("doc_id"), F.col("size"))), "mix")
    stats = slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    stats = ranked(stats.withColumn("last", F.col("source").isNull()), ["last", "source"])
    weights = F.array(*[F.lit(w).cast("long") for w in cycle])
    stats = materialize(stats.withColumn("weight", F.get(weights, (F.col("rank") % len(cycle)).cast("int"))), "sources")
    goal = F.bround("target").cast("long")
    wanted = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / CELL_ROWS))).cast("long")
    plan = water_fill(stats, max_epochs).select(
        F.col("source").alias("src"), F.col("words").alias("source_size"), "target",
        F.when(F.col("words") > 0, F.floor(goal / F.col("words"))).otherwise(0).alias("epochs"),
        F.when(F.col("words") > 0, goal % F.col("words")).otherwise(0).alias("rest"),
        F.least(F.lit(CELLS), F.greatest(F.lit(1), wanted)).alias("cells"))
    plan = materialize(plan, "plan")
    few = plan.count() <= BROADCAST_SOURCES
    plan = F.broadcast(plan) if few else plan
    located = slim.join(plan, F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn("cell", F.pmod("h", "cells"))
    # Where each source's fraction ends: the cell whose running sum first reaches it.
    per_cell = located.filter("rest > 0").groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ends = per_cell.withColumn("upto", F.sum("words").over(running)).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    ends = ends.select(F.col("source").alias("src"), F.col("cell").alias("end_cell"), (F.col("rest") - F.col("upto") + F.col("words")).alias("missing"))
    ends = F.broadcast(ends) if few else ends
    placed = located.join(ends, F.col("source").eqNullSafe(F.col("src")), "left").drop("src")
    base = F.col("epochs") * F.col("size")
    clear = placed.filter("end_cell is null or cell <> end_cell").withColumn("taken", base + F.when(F.col("cell") < F.col("end_cell"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter("cell = end_cell").withColumn("gap", F.col("missing") - F.sum("size").over(order) + F.col("size"))
    part = F.greatest(F.lit(0), F.least("size", "gap"))
    if whole:
        part = F.when(2 * F.col("gap") >= F.col("size"), F.col("size")).otherwise(0)
    edge = edge.withColumn("taken", base + part)
    cols = ["doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return clear.select(*cols).unionByName(edge.select(*cols))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row repeated as often, whole documents only.

    Rows without words are kept once; rows without a ``doc_id`` are left out of the lookup and kept
    once. The decision is by ``doc_id``: rows that share one are all repeated as the most taken is.
    """
    taken = mix_documents(docs, whole=True, **options).filter("size > 0 and doc_id is not null")
    key, times, copy = (f"__{name}_{uuid.uuid4().hex}" for name in ("key", "times", "copy"))  # clash with no column
    often = taken.groupBy(F.col("doc_id").alias(key)).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias(times))
    out = docs.join(often, F.col("doc_id") == F.col(key), "left")
    out = out.withColumn(times, F.coalesce(times, F.lit(1))).filter(F.col(times) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
