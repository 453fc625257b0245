"""Candidate store: one row per cell with its ordered candidate bins, and the index of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordered import ordinal
from ..operators.spatial_join import candidate_counts


def index_rows(nuclei: DataFrame, candidates: DataFrame) -> DataFrame:
    counts = candidate_counts(nuclei.select("cell_id", "center_x_um", "center_y_um", "radius_um"), candidates)
    return ordinal(counts, ["cell_id"], "episode_index")


def nested(candidates: DataFrame) -> DataFrame:
    """Candidates as one ordered array per cell; its length is limited by the search disc."""
    item = F.struct("matrix_col_index", "barcode", "x_um", "y_um", "dist_um")
    return candidates.groupBy("cell_id").agg(F.sort_array(F.collect_list(item)).alias("bins"))


def write_store(nuclei: DataFrame, candidates: DataFrame, path: str) -> None:
    """Cells are range-partitioned by id, so a reader of few cells touches few files."""
    nested(candidates).repartitionByRange("cell_id").sortWithinPartitions("cell_id").write.mode("overwrite").parquet(f"{path}/bins")
    index_rows(nuclei, candidates).write.mode("overwrite").parquet(f"{path}/index")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Flat candidate rows in stored order."""
    bins = spark.read.parquet(f"{path}/bins")
    return bins.select("cell_id", F.posexplode("bins").alias("candidate_index", "b")).select("cell_id", "candidate_index", "b.*")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")
