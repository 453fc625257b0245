"""Overlapping square tiles over the nuclei, their core and margin cells, and cell-to-patch choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordered import ordinal
from ..functions.scalars import attach_scalars

ROLES = ("core", "margin")


def tile_grid(nuclei: DataFrame, size: float, stride: float) -> DataFrame:
    """One row: origin of the tile centres and number of tiles per axis."""
    pad = size / 2.0
    box = nuclei.agg(F.min("center_x_um").alias("x0"), F.max("center_x_um").alias("x1"),
                     F.min("center_y_um").alias("y0"), F.max("center_y_um").alias("y1"))
    steps = lambda lo, hi: F.ceil(((F.col(hi) + pad + stride) - (F.col(lo) - pad)) / stride).cast("int")
    return box.select((F.col("x0") - pad).alias("base_x"), (F.col("y0") - pad).alias("base_y"),
                      steps("x0", "x1").alias("n_x"), steps("y0", "y1").alias("n_y"))


def tile_members(nuclei: DataFrame, size: float, stride: float, core: float,
                 offsets: Sequence[tuple[float, float]] = ((0.0, 0.0),)) -> DataFrame:
    """(pass, ix, iy, cell) memberships with the role of the cell in the tile.

    Tile indices that can cover a nucleus follow from arithmetic, so every nucleus expands
    to at most (size/stride + 1)^2 rows per pass. Jitter passes are given as offsets.
    """
    g = attach_scalars(nuclei.select("cell_id", "center_x_um", "center_y_um"), tile_grid(nuclei, size, stride))
    passes = F.explode(F.array(*[F.struct(F.lit(i).alias("pass"), F.lit(float(a)).alias("ox"), F.lit(float(b)).alias("oy"))
                                 for i, (a, b) in enumerate(offsets)]))
    g = g.withColumn("_p", passes)
    half = size / 2.0

    def index_range(v: str, base: str, off: str, n: str) -> Column:
        rel = F.col(v) - F.col(base) - F.col(f"_p.{off}")
        low = F.greatest(F.floor((rel - half) / stride), F.lit(0))
        high = F.least(F.ceil((rel + half) / stride), F.col(n) - 1)
        return F.when(high >= low, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))

    t = g.withColumn("ix", F.explode(index_range("center_x_um", "base_x", "ox", "n_x")))
    t = t.withColumn("iy", F.explode(index_range("center_y_um", "base_y", "oy", "n_y")))
    t = t.withColumn("cx", F.col("base_x") + F.col("ix") * F.lit(float(stride)) + F.col("_p.ox"))
    t = t.withColumn("cy", F.col("base_y") + F.col("iy") * F.lit(float(stride)) + F.col("_p.oy"))
    x, y = F.col("center_x_um"), F.col("center_y_um")

    def inside(h: float) -> Column:
        return x.between(F.col("cx") - h, F.col("cx") + h) & y.between(F.col("cy") - h, F.col("cy") + h)

    return t.filter(inside(half)).select(
        F.col("_p.pass").alias("pass"), "ix", "iy", "cx", "cy", "cell_id",
        F.when(inside(core / 2.0), "core").otherwise("margin").alias("role"),
        ((x - F.col("cx")) * (x - F.col("cx")) + (y - F.col("cy")) * (y - F.col("cy"))).alias("dist2"))


def valid_tiles(members: DataFrame, min_core: int, min_cells: int) -> DataFrame:
    tiles = members.groupBy("pass", "ix", "iy").agg(
        F.max("cx").alias("cx"), F.max("cy").alias("cy"), F.count_if(F.col("role") == "core").alias("n_core"), F.count("*").alias("n_all"))
    return tiles.filter((F.col("n_core") >= min_core) & (F.col("n_all") >= min_cells))


def cap_members(members: DataFrame, keys: Sequence[str], max_cells: int) -> DataFrame:
    """At most ``max_cells`` cells per tile: core cells first, then the closest to the centre.

    The row-number limit is applied map-side before rows of a tile meet.
    """
    if max_cells <= 0:
        return members
    w = Window.partitionBy(*keys).orderBy((F.col("role") != "core").cast("int"), "dist2", "cell_id")
    return members.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_cells).drop("_rn")


def build_patches(nuclei: DataFrame, size: float, stride: float, core: float, min_core: int = 1, min_cells: int = 1,
                  max_cells: int = 64, offsets: Sequence[tuple[float, float]] = ((0.0, 0.0),)) -> tuple[DataFrame, DataFrame]:
    """(patches, members). Tiles are numbered in scan order; rescue tiles follow in id order.

    A rescue tile is centred on each cell that is in no tile's core.
    """
    members = tile_members(nuclei, size, stride, core, offsets)
    tiles = ordinal(valid_tiles(members, min_core, min_cells), ["pass", "ix", "iy"], "patch_number")
    kept = cap_members(members.join(tiles.select("pass", "ix", "iy", "patch_number"), ["pass", "ix", "iy"]), ["patch_number"], max_cells)
    kept = kept.select("patch_number", "cell_id", "role", "dist2")
    covered = kept.filter("role = 'core'").select("cell_id")
    missing = nuclei.select("cell_id", "center_x_um", "center_y_um").join(covered, "cell_id", "left_anti")
    grid_patches = tiles.select("patch_number", F.concat(F.lit("grid"), F.col("pass").cast("string")).alias("source"), "cx", "cy")
    numbered = ordinal(missing.withColumn("_id", F.col("cell_id").cast("string")), ["_id"], "_k")
    base = tiles.agg(F.count("*").alias("_base"))
    rescue = attach_scalars(numbered, base).select(
        (F.col("_base") + F.col("_k")).alias("patch_number"), F.lit("rescue").alias("source"),
        F.col("center_x_um").alias("cx"), F.col("center_y_um").alias("cy"))
    rescued = cap_members(box_members(rescue, nuclei, size, core), ["patch_number"], max_cells)
    patches = grid_patches.unionByName(rescue)
    half, inner = size / 2.0, core / 2.0
    boxed = patches.select(
        "patch_number", F.format_string("patch_%07d", "patch_number").alias("patch_id"), "source", "cx", "cy",
        (F.col("cx") - half).alias("outer_x_min"), (F.col("cx") + half).alias("outer_x_max"),
        (F.col("cy") - half).alias("outer_y_min"), (F.col("cy") + half).alias("outer_y_max"),
        (F.col("cx") - inner).alias("core_x_min"), (F.col("cx") + inner).alias("core_x_max"),
        (F.col("cy") - inner).alias("core_y_min"), (F.col("cy") + inner).alias("core_y_max"))
    all_members = kept.unionByName(rescued).join(boxed.select("patch_number", "patch_id"), "patch_number")
    return boxed, all_members.select("patch_id", "cell_id", "role", "dist2")


def box_members(tiles: DataFrame, nuclei: DataFrame, size: float, core: float) -> DataFrame:
    from .spatial_join import bucket_join
    n = nuclei.select("cell_id", "center_x_um", "center_y_um")
    pairs = bucket_join(tiles.select("patch_number", "cx", "cy"), n, ("cx", "cy"), ("center_x_um", "center_y_um"), size)
    dx, dy = F.abs(F.col("center_x_um") - F.col("cx")), F.abs(F.col("center_y_um") - F.col("cy"))
    half, inner = size / 2.0, core / 2.0
    return pairs.filter((dx <= half) & (dy <= half)).select(
        "patch_number", "cell_id", F.when((dx <= inner) & (dy <= inner), "core").otherwise("margin").alias("role"),
        (dx * dx + dy * dy).alias("dist2"))


def patch_index(patches: DataFrame, members: DataFrame) -> DataFrame:
    """One row per patch with its ordered core and margin cell lists (at most the cell cap)."""
    lists = members.groupBy("patch_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "core", F.col("cell_id").cast("string")))).alias("core_cell_ids"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "margin", F.col("cell_id").cast("string")))).alias("margin_cell_ids"),
        F.count("*").alias("n_patch_cells"))
    return patches.join(lists, "patch_id").select(
        *patches.columns, "n_patch_cells", F.size("core_cell_ids").alias("n_core_cells"), F.size("margin_cell_ids").alias("n_margin_cells"),
        F.to_json("core_cell_ids").alias("core_cell_ids"), F.to_json("margin_cell_ids").alias("margin_cell_ids"))


def best_patch_per_cell(core_members: DataFrame, scores: DataFrame) -> DataFrame:
    """Patch with the highest score per core cell; the earlier patch wins a tie."""
    joined = core_members.join(scores, "patch_id")
    best = joined.groupBy("cell_id").agg(F.min_by(F.struct("patch_id", "score"), F.struct((-F.col("score")).alias("s"), "patch_id")).alias("_b"))
    return best.select("cell_id", "_b.patch_id", "_b.score")


def patches_meeting(core_members: DataFrame, targets: DataFrame) -> DataFrame:
    """Patches whose core holds any target cell."""
    return core_members.join(targets.select("cell_id"), "cell_id", "left_semi").select("patch_id").distinct()
