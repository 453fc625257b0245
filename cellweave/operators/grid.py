"""Bin footprints, crop geometry and pixel-to-bin assignment on a regular grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import previous_value
from ..functions.scalars import attach_scalars

# Neighbour offsets.
EIGHT_NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
FOUR_NEIGHBOURS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def offset_rows(offsets: Sequence[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offsets]))


def place(row: Column, col: Column) -> Column:
    """Grid position as one number, so that a neighbour's is this one plus a constant."""
    return row.cast("long") * F.lit(1 << 32) + col.cast("long")


def place_col(at: Column) -> Column:
    return F.shiftright(F.shiftleft(at, 32), 32)


def place_row(at: Column) -> Column:
    return F.shiftright(at - place_col(at), 32)


def bin_footprints(positions: DataFrame) -> DataFrame:
    """Add the half-open pixel rectangle of every bin (half-to-even rounding)."""
    half = positions.agg(
        ((F.max("pxl_row_in_fullres") - F.min("pxl_row_in_fullres")) / (2.0 * (F.max("array_row") + 1))).alias("_hr"),
        ((F.max("pxl_col_in_fullres") - F.min("pxl_col_in_fullres")) / (2.0 * (F.max("array_col") + 1))).alias("_hc"),
    )
    row, col = F.col("pxl_row_in_fullres"), F.col("pxl_col_in_fullres")
    return attach_scalars(positions, half).select(
        *positions.columns,
        F.rint(row - F.col("_hr")).cast("int").alias("row_left"),
        F.rint(row + F.col("_hr")).cast("int").alias("row_right"),
        F.rint(col - F.col("_hc")).cast("int").alias("col_up"),
        F.rint(col + F.col("_hc")).cast("int").alias("col_down"),
    )


def array_bounds(positions: DataFrame) -> DataFrame:
    """In-tissue array rectangle, upper ends exclusive."""
    return positions.filter("in_tissue = 1").agg(
        F.min("array_row").alias("start_row"), (F.max("array_row") + 1).alias("end_row"),
        F.min("array_col").alias("start_col"), (F.max("array_col") + 1).alias("end_col"))


def crop_bins(footprints: DataFrame) -> DataFrame:
    inside = ((F.col("array_row") >= F.col("start_row")) & (F.col("array_row") < F.col("end_row"))
              & (F.col("array_col") >= F.col("start_col")) & (F.col("array_col") < F.col("end_col")))
    return attach_scalars(footprints, array_bounds(footprints)).filter(inside).select(*footprints.columns)


def crop_rectangle(cropped: DataFrame, image_height: int | None = None, image_width: int | None = None) -> DataFrame:
    """One row with the crop rectangle in pixels; optionally clipped to the image size."""
    bottom, right = F.max("row_right"), F.max("col_down")
    if image_height is not None:
        bottom = F.least(bottom, F.lit(image_height))
    if image_width is not None:
        right = F.least(right, F.lit(image_width))
    rect = cropped.agg(
        F.greatest(F.min("row_left"), F.lit(0)).alias("crop_top"), bottom.alias("crop_bottom"),
        F.greatest(F.min("col_up"), F.lit(0)).alias("crop_left"), right.alias("crop_right"))
    return rect.select("*", (F.col("crop_bottom") - F.col("crop_top")).alias("crop_height_px"),
                       (F.col("crop_right") - F.col("crop_left")).alias("crop_width_px"))


def crop_relative(cropped: DataFrame, rectangle: DataFrame) -> DataFrame:
    """Crop-relative footprints: y in [y_from, y_to), x in [x_from, x_to)."""
    rect = rectangle.select("crop_top", "crop_left")
    return attach_scalars(cropped, rect).select(
        *cropped.columns,
        (F.col("row_left") - F.col("crop_top")).alias("y_from"), (F.col("row_right") - F.col("crop_top")).alias("y_to"),
        (F.col("col_up") - F.col("crop_left")).alias("x_from"), (F.col("col_down") - F.col("crop_left")).alias("x_to"))


def signal_pixels(pixels: DataFrame) -> DataFrame:
    """Drop background pixels before anything is joined."""
    return pixels.filter((F.col("is_nuclear") > 0) | (F.col("is_cytoplasm") > 0) | (F.col("is_boundary") > 0))


def pixels_inside(pixels: DataFrame, rectangle: DataFrame) -> DataFrame:
    size = rectangle.select("crop_width_px", "crop_height_px")
    return attach_scalars(pixels, size).filter(
        (F.col("x") >= 0) & (F.col("x") < F.col("crop_width_px"))
        & (F.col("y") >= 0) & (F.col("y") < F.col("crop_height_px"))).select(*pixels.columns)


def bins_by_bucket(relative_bins: DataFrame) -> DataFrame:
    """(bucket_x, bucket_y) -> footprints that touch the bucket, with the bucket's ``side``.

    The side is the largest footprint, so a footprint touches at most four buckets and, on a
    regular grid, a bucket is touched by a handful of footprints. A footprint that starts
    before the crop covers nothing.
    """
    usable = relative_bins.filter("y_from >= 0 and x_from >= 0 and y_to > y_from and x_to > x_from")
    side = usable.agg(F.max(F.greatest(F.expr("x_to - x_from"), F.expr("y_to - y_from"))).cast("long").alias("side"))
    spread = attach_scalars(usable.select("bin_ordinal", "x_from", "x_to", "y_from", "y_to"), side).withColumn(
        "bucket_x", F.explode(F.expr("sequence(x_from div side, (x_to - 1) div side)"))).withColumn(
        "bucket_y", F.explode(F.expr("sequence(y_from div side, (y_to - 1) div side)")))
    return spread.groupBy("bucket_x", "bucket_y", "side").agg(
        F.collect_list(F.struct("bin_ordinal", "x_from", "x_to", "y_from", "y_to")).alias("footprints"))


def assign_pixels(pixels: DataFrame, buckets: DataFrame, rectangle: DataFrame) -> DataFrame:
    """Pixels with the bin that contains them; the later bin wins an overlap.

    A pixel lies in one bucket, so it meets that bucket's footprints by an equality join.
    """
    inside = attach_scalars(pixels_inside(signal_pixels(pixels), rectangle), buckets.agg(F.max("side").alias("_side")))
    placed = inside.withColumns({"bucket_x": F.expr("x div _side"), "bucket_y": F.expr("y div _side")})
    met = placed.join(buckets.drop("side"), ["bucket_x", "bucket_y"])
    covers = F.filter("footprints", lambda b: (b["x_from"] <= F.col("x")) & (F.col("x") < b["x_to"]) & (b["y_from"] <= F.col("y")) & (F.col("y") < b["y_to"]))
    owner = F.array_max(F.transform(covers, lambda b: b["bin_ordinal"]))
    return met.withColumn("bin_ordinal", owner).filter("bin_ordinal is not null").select(*pixels.columns, "bin_ordinal")


def to_microns(positions: DataFrame, microns_per_pixel: float) -> DataFrame:
    return positions.withColumns({
        "x_um": F.col("pxl_col_in_fullres") * F.lit(microns_per_pixel),
        "y_um": F.col("pxl_row_in_fullres") * F.lit(microns_per_pixel)})


def grid_step(values: DataFrame, column: str, how: str = "min", default: float = 1.0) -> DataFrame:
    """One-row spacing estimate: min or median positive gap between sorted distinct values."""
    distinct = values.select(F.col(column).cast("double").alias("v")).filter("v is not null").distinct()
    gaps = previous_value(distinct, [], ["v"], "v", "p").select((F.col("v") - F.col("p")).alias("gap")).filter("gap > 1.0e-6")
    if how == "min":
        return gaps.agg(F.coalesce(F.min("gap"), F.lit(default)).alias("step"))
    from ..functions.ordered import exact_quantiles
    return exact_quantiles(gaps, [], "gap", {"step": 0.5}).select(F.coalesce("step", F.lit(default)).alias("step"))


def grid_coordinates(table: DataFrame, x: str, y: str, step_x: DataFrame, step_y: DataFrame, shift_origin: bool = False) -> DataFrame:
    """Integer grid position by half-to-even rounding of coordinate / step."""
    scaled = attach_scalars(attach_scalars(table, step_x.toDF("_sx")), step_y.toDF("_sy"))
    if shift_origin:
        scaled = attach_scalars(scaled, table.agg(F.min(x).alias("_x0"), F.min(y).alias("_y0")))
    else:
        scaled = scaled.withColumns({"_x0": F.lit(0.0), "_y0": F.lit(0.0)})
    return scaled.select(*table.columns,
                         F.rint((F.col(x) - F.col("_x0")) / F.col("_sx")).cast("int").alias("gx"),
                         F.rint((F.col(y) - F.col("_y0")) / F.col("_sy")).cast("int").alias("gy"))


def neighbour_pairs(cells: DataFrame, keys: Sequence[str], x: str, y: str, carry: Sequence[str] = (),
                    offsets: Sequence[tuple[int, int]] = EIGHT_NEIGHBOURS) -> DataFrame:
    """Existing grid neighbours of each cell, as an equality join on the shifted key.

    Adds ``n_<c>`` for every carried column of the neighbour, plus dx / dy. Both sides hold all
    cells, and the size of their compressed files says little about rows in memory: never a broadcast.
    """
    other = cells.select(*keys, F.col(x).alias("_nx"), F.col(y).alias("_ny"), *[F.col(c).alias(f"n_{c}") for c in carry])
    shifted = cells.select("*", offset_rows(offsets).alias("_o")).select(
        *cells.columns, F.col("_o.dx").alias("dx"), F.col("_o.dy").alias("dy"),
        (F.col(x) + F.col("_o.dx")).alias("_nx"), (F.col(y) + F.col("_o.dy")).alias("_ny"))
    return shifted.join(other.hint("merge"), [*keys, "_nx", "_ny"])


def exposed_edges(cells: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Cell sides whose neighbour in that direction is not occupied (anti-join)."""
    occupied = cells.select(*keys, F.col(x).alias("_nx"), F.col(y).alias("_ny"))
    sides = cells.select(*keys, x, y, offset_rows(FOUR_NEIGHBOURS).alias("_o")).select(
        *keys, x, y, F.col("_o.dx").alias("dx"), F.col("_o.dy").alias("dy"),
        (F.col(x) + F.col("_o.dx")).alias("_nx"), (F.col(y) + F.col("_o.dy")).alias("_ny"))
    return sides.join(occupied, [*keys, "_nx", "_ny"], "left_anti").select(*keys, x, y, "dx", "dy")


def outline_segments(edges: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Segment end points (in half-bin units around the bin centre) of exposed sides."""
    vertical = F.col("dx") != 0
    half = F.lit(0.5)
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    return edges.select(
        *keys, x, y,
        F.when(vertical, cx + half * F.col("dx")).otherwise(cx - half).alias("x1"),
        F.when(vertical, cy - half).otherwise(cy + half * F.col("dy")).alias("y1"),
        F.when(vertical, cx + half * F.col("dx")).otherwise(cx + half).alias("x2"),
        F.when(vertical, cy + half).otherwise(cy + half * F.col("dy")).alias("y2"))


def occupancy_raster(cells: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """0/1 raster over each cell's bounding box with a one-bin border.

    The raster is the result itself; a bounding box is limited by the object's extent.
    """
    box = cells.groupBy(key).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    frame = (box.select(key, F.explode(F.expr("sequence(x0 - 1, x1 + 1)")).alias("gx"), "y0", "y1")
             .select(key, "gx", F.explode(F.expr("sequence(y0 - 1, y1 + 1)")).alias("gy")))
    marks = cells.select(key, F.col(x).alias("gx"), F.col(y).alias("gy"), F.lit(1).alias("_m")).distinct()
    return frame.join(marks, [key, "gx", "gy"], "left").select(key, "gx", "gy", F.coalesce("_m", F.lit(0)).alias("occupied"))


def synthetic_bins(pixels: DataFrame, microns_per_pixel: float, bin_um: float) -> DataFrame:
    """Distinct square bins per cell from pixel positions, flagged nuclear if any pixel is."""
    scale = F.lit(microns_per_pixel)
    return (pixels.filter("cell_id > 0").groupBy(
        "cell_id", F.floor(F.col("x") * scale / bin_um).cast("int").alias("bin_x"),
        F.floor(F.col("y") * scale / bin_um).cast("int").alias("bin_y"))
        .agg(F.max("is_nuclear").alias("is_nuclear")))


def pixel_classes(labels: DataFrame, cell: str = "cell_id", nucleus: str = "nucleus_id") -> DataFrame:
    """Boundary / interior / nuclear / cytoplasm flags from two label layers.

    A pixel is boundary when a 4-neighbour carries another label; a missing neighbour
    counts as the pixel's own label.
    """
    best = best_partner(labels.filter((F.col(cell) > 0) & (F.col(nucleus) > 0)), cell, nucleus)
    pairs = neighbour_pairs(labels.select("x", "y", cell), [], "x", "y", carry=[cell], offsets=FOUR_NEIGHBOURS)
    edge = pairs.filter(F.col(cell) != F.col(f"n_{cell}")).select("x", "y").distinct().withColumn("_edge", F.lit(1))
    joined = labels.join(edge, ["x", "y"], "left").join(best.select(cell, F.col(nucleus).alias("_best")), cell, "left")
    boundary = (F.col(cell) > 0) & F.col("_edge").isNotNull()
    interior = (F.col(cell) > 0) & F.col("_edge").isNull()
    nuclear = interior & (F.col(nucleus) > 0) & (F.col(nucleus) == F.coalesce(F.col("_best"), F.lit(0)))
    return joined.select("x", "y", cell, boundary.cast("int").alias("is_boundary"), interior.cast("int").alias("is_interior"),
                         nuclear.cast("int").alias("is_nuclear"), (interior & ~nuclear).cast("int").alias("is_cytoplasm"))


def best_partner(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Most frequent partner per left id; the smallest partner id wins a tie."""
    counts = rows.groupBy(left, right).agg(F.count("*").alias("n_px"))
    top = counts.groupBy(left).agg(F.max(F.struct("n_px", (-F.col(right)).alias("neg"))).alias("_m"))
    return top.select(left, (-F.col("_m.neg")).alias(right), F.col("_m.n_px").alias("n_px"))
