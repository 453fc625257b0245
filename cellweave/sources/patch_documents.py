"""Nested document per patch (bounds, metrics, cells, bins, trajectory) and the manifest over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .timeline import nested, read_nested


def documents(patches: DataFrame, members: DataFrame, bins: DataFrame, cells: DataFrame, metrics: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """One nested row per patch. A patch box and its cell cap bound both arrays.

    ``segments`` (a ``timeline`` by patch_id) become the field ``trajectory``; patches without steps have none.
    """
    bin_cols = [c for c in bins.columns if c != "patch_id"]
    cell_cols = [c for c in cells.columns if c != "patch_id"]
    nested_bins = bins.groupBy("patch_id").agg(F.sort_array(F.collect_list(F.struct(*bin_cols))).alias("bins"))
    nested_cells = cells.groupBy("patch_id").agg(F.sort_array(F.collect_list(F.struct(*cell_cols))).alias("cells"))
    ids = members.groupBy("patch_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "core", F.col("cell_id").cast("string")))).alias("core_cell_ids"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "margin", F.col("cell_id").cast("string")))).alias("margin_cell_ids"))
    packed = metrics.select("patch_id", F.struct(*[c for c in metrics.columns if c != "patch_id"]).alias("metrics"))
    bounds = patches.select("patch_id", F.struct("outer_x_min", "outer_x_max", "outer_y_min", "outer_y_max").alias("outer_bounds"),
                            F.struct("core_x_min", "core_x_max", "core_y_min", "core_y_max").alias("core_bounds"))
    docs = bounds.join(packed, "patch_id").join(ids, "patch_id").join(nested_cells, "patch_id", "left").join(nested_bins, "patch_id", "left")
    return docs if segments is None else docs.join(nested(segments), "patch_id", "left")


def manifest(docs: DataFrame) -> DataFrame:
    return docs.select("patch_id", F.col("metrics.foreground_iou").alias("foreground_iou"), F.size("bins").cast("bigint").alias("n_bins"),
                       F.size("cells").cast("bigint").alias("n_cells"), F.size("margin_cell_ids").cast("bigint").alias("n_margin_cells"))


def write_documents(docs: DataFrame, path: str, folder_per_patch: bool = False) -> None:
    """One JSON line per patch, plus the manifest.

    Files are ranges of patch ids. A folder per patch is only for small exports: a slide
    has far too many patches for one directory entry each.
    """
    if folder_per_patch:
        docs.withColumn("patch", F.col("patch_id")).write.mode("overwrite").partitionBy("patch").json(f"{path}/patches")
    else:
        docs.repartitionByRange("patch_id").sortWithinPartitions("patch_id").write.mode("overwrite").json(f"{path}/patches")
    manifest(docs).write.mode("overwrite").json(f"{path}/manifest")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/patches")


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Timelines of the documents, one row per patch and segment."""
    return read_nested(spark, f"{path}/patches")
