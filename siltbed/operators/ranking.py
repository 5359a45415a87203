"""A global rank without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.storage import materialize


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank of each row in ``order``.

    Rows are range-partitioned, sorted within their partition and written; a partition's first
    rank is the number of rows before it, of which there is one per partition.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = materialize(parts.withColumn("__part", F.spark_partition_id()).withColumn("__local", local), "ranked")
    before, rows = 0, []
    for r in parts.groupBy("__part").count().orderBy("__part").collect():
        rows.append((r["__part"], before))
        before += r["count"]
    first = df.sparkSession.createDataFrame(rows, "__part int, __before long")
    return parts.join(F.broadcast(first), "__part").withColumn(name, F.col("__before") + F.col("__local")).drop("__part", "__local", "__before")


def chunked(df: DataFrame, size: int, order: list[str], name: str = "chunk") -> DataFrame:
    """``df`` with the number of each row's chunk of ``size`` consecutive rows."""
    return ranked(df, order, "__rank").withColumn(name, F.floor(F.col("__rank") / size)).drop("__rank")
