"""Sinks: the experiments' CSV, centre and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RESULT = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("method", T.StringType()), T.StructField("k", T.IntegerType()),
    T.StructField("m", T.IntegerType()), T.StructField("run", T.IntegerType()), T.StructField("seed", T.LongType()), T.StructField("cost", T.DoubleType())])

CENTER = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("cid", T.IntegerType()), T.StructField("c", T.ArrayType(T.DoubleType(), False))])

METRIC = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("partitions", T.IntegerType()), T.StructField("m", T.IntegerType()), T.StructField("k", T.IntegerType()),
    T.StructField("points_seen", T.DoubleType()), T.StructField("build_ms", T.LongType()), T.StructField("cost", T.DoubleType())])


def results(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header below ``path``, overwritten; quotes only where RFC 4180 asks for them."""
    df.coalesce(1).write.option("header", True).option("escape", '"').option("encoding", "UTF-8").mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def publish(df: DataFrame, name: str) -> None:
    """A queryable view of a small result."""
    df.createOrReplaceTempView(name)
