"""Nucleus table: pixel moments per nucleus and its summary."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import exact_quantiles
from ..functions.scalars import attach_scalars


def nucleus_moments(pixels: DataFrame) -> DataFrame:
    """Mergeable per-nucleus sums; background and non-nuclear pixels are dropped first."""
    return pixels.filter("is_nuclear > 0 and cell_id > 0").groupBy("cell_id").agg(
        F.sum("is_nuclear").alias("nuclear_pixel_count"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def nuclei_table(moments: DataFrame, rectangle: DataFrame, microns_per_pixel: float) -> DataFrame:
    """Centroid, equivalent radius and bounding box in full-resolution coordinates."""
    mpp, n = F.lit(microns_per_pixel), F.col("nuclear_pixel_count")
    with_crop = attach_scalars(moments, rectangle.select("crop_left", "crop_top"))
    cx = F.col("sum_x") / n + F.col("crop_left")
    cy = F.col("sum_y") / n + F.col("crop_top")
    return with_crop.select(
        "cell_id", (cx * mpp).alias("center_x_um"), (cy * mpp).alias("center_y_um"),
        F.sqrt(n * mpp * mpp / F.lit(math.pi)).alias("radius_um"), "nuclear_pixel_count",
        cx.alias("center_x_fullres_px"), cy.alias("center_y_fullres_px"),
        (F.col("min_x") + F.col("crop_left")).alias("bbox_min_x"), (F.col("max_x") + F.col("crop_left")).alias("bbox_max_x"),
        (F.col("min_y") + F.col("crop_top")).alias("bbox_min_y"), (F.col("max_y") + F.col("crop_top")).alias("bbox_max_y"))


def nuclei_summary(nuclei: DataFrame) -> DataFrame:
    base = nuclei.agg(F.count("*").alias("n_nuclei"), F.avg("radius_um").alias("mean_radius_um"),
                      F.max("radius_um").alias("max_radius_um"))
    return attach_scalars(base, exact_quantiles(nuclei, [], "radius_um", {"median_radius_um": 0.5}))
