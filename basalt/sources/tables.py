"""Reading tables and frames, and keeping fitted models."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame:
    """Any format of Spark's readers; text formats should be given a schema, as inferring one reads the data twice."""
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    df.write.mode(mode).format(kind).partitionBy(*partition_by).save(path)


def missing_to_null(df: DataFrame, cols: list[str], sentinel: float | None = None) -> DataFrame:
    """NaN, and a sentinel if given, become NULL: the one missing value of this library."""
    gone = lambda c: F.isnan(c) if sentinel is None else F.isnan(c) | (F.col(c) == sentinel)
    return df.withColumns({c: F.when(~gone(c), F.col(c).cast("double")) for c in cols})


def save_model(spark: SparkSession, model, path: str) -> None:
    """A fitted model is small driver state; it is kept as one binary row."""
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str):
    """Only from folders you trust: models are pickles."""
    return pickle.loads(bytes(spark.read.parquet(path).first()[0]))
