"""Run manifests: one row of counts and crop metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import attach_scalars


def claims_manifest(claims: DataFrame, rectangle: DataFrame) -> DataFrame:
    counts = claims.agg(F.count("*").alias("n_rows"), F.countDistinct("barcode").alias("n_barcodes"),
                        F.countDistinct("cell_id").alias("n_cells"), F.sum("is_nuclear").alias("n_nuclear_rows"))
    return attach_scalars(counts, rectangle.select("crop_height_px", "crop_width_px"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)
