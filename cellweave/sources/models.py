"""Reference-count bundle and shape model as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_reference(counts: DataFrame, types: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    types.write.mode("overwrite").parquet(f"{path}/types")


def read_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/types")


def write_shape_model(model: DataFrame, path: str) -> None:
    model.coalesce(1).write.mode("overwrite").parquet(path)


def read_shape_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
