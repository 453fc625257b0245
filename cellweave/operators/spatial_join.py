"""Radius, nearest and within-distance joins on a bucketed plane.

A distance predicate alone would be planned as a nested-loop join. Points are therefore
keyed by a square bucket of the search radius, the searching side is repeated to its 3x3
bucket block, and the join is an equality on the bucket. Buckets that hold too many points
are divided into slices that different tasks handle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import attach_scalars
from ..session import write_stage

MAX_BUCKET_ROWS = 100_000
MAX_BROADCAST_BUCKETS = 100_000
#: Squares a side that one square of the level above holds; levels up to 4 ** 12 search radii.
PYRAMID_FAN = 4
PYRAMID_LEVELS = 12


def _bucketed(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return points.withColumns({"_bx": F.floor(F.col(x) / size).cast("long"), "_by": F.floor(F.col(y) / size).cast("long")})


def _overfull(points: DataFrame, max_rows: int) -> DataFrame | None:
    """Slice counts of buckets with more than ``max_rows`` points, or None if there are none.

    Only overfull buckets leave the aggregate. Up to a fixed number of them they are
    broadcast as a checked list; beyond it they stay a distributed table.
    """
    hot = (points.groupBy("_bx", "_by").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_rows)
           .select("_bx", "_by", F.ceil(F.col("_n") / max_rows).cast("int").alias("_slices")))
    rows = hot.limit(MAX_BROADCAST_BUCKETS + 1).collect()
    if not rows:
        return None
    if len(rows) > MAX_BROADCAST_BUCKETS:
        return hot
    return F.broadcast(points.sparkSession.createDataFrame(rows, hot.schema))


def bucket_join(searching: DataFrame, points: DataFrame, at: tuple[str, str], xy: tuple[str, str], radius: float,
                max_bucket_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """Pairs of (searching row, point) with ``dist_um`` up to ``radius``.

    Column names of both sides must differ. Points of an overfull bucket are spread over
    slices, and the searching rows of that bucket are copied to each slice, so no single
    join key holds more than ``max_bucket_rows`` points.
    """
    size = max(float(radius), 1.0e-9)
    pts = _bucketed(points, *xy, size)
    around = F.explode(F.expr("transform(sequence(0, 8), i -> struct(i div 3 - 1 as dx, i % 3 - 1 as dy))"))
    probe = _bucketed(searching, *at, size).withColumn("_o", around).select(
        *searching.columns, (F.col("_bx") + F.col("_o.dx")).alias("_bx"), (F.col("_by") + F.col("_o.dy")).alias("_by"))
    keys = ["_bx", "_by"]
    hot = _overfull(pts, max_bucket_rows)
    if hot is not None:
        own = F.when(F.col("_slices").isNotNull(), F.pmod(F.xxhash64(*points.columns), F.col("_slices"))).otherwise(F.lit(0))
        pts = pts.join(hot, keys, "left").withColumn("_slice", own.cast("int")).drop("_slices")
        probe = probe.join(hot, keys, "left").withColumn("_slice", F.explode(F.expr("sequence(0, coalesce(_slices, 1) - 1)"))).drop("_slices")
        keys = [*keys, "_slice"]
    dx, dy = F.col(at[0]) - F.col(xy[0]), F.col(at[1]) - F.col(xy[1])
    joined = probe.join(pts, keys).withColumn("dist_um", F.sqrt(dx * dx + dy * dy))
    return joined.filter(F.col("dist_um") <= radius).drop(*keys)


def candidate_bins(nuclei: DataFrame, bins: DataFrame, max_distance_um: float, band_um: float | None = None) -> DataFrame:
    """Bins around every nucleus, optionally only in an annulus around its radius."""
    cells = nuclei.select("cell_id", "center_x_um", "center_y_um", "radius_um")
    pairs = bucket_join(cells, bins, ("center_x_um", "center_y_um"), ("x_um", "y_um"), max_distance_um)
    return pairs if band_um is None else in_band(pairs, band_um)


def in_band(pairs: DataFrame, band_um: float) -> DataFrame:
    """Pairs whose bin lies within ``band_um`` of the nucleus' rim."""
    return pairs.filter(F.abs(F.col("radius_um") - F.col("dist_um")) <= band_um)


def candidate_counts(nuclei: DataFrame, candidates: DataFrame) -> DataFrame:
    """Number of candidate bins for every nucleus; nuclei without any count 0."""
    n = candidates.groupBy("cell_id").agg(F.count("*").alias("n"))
    return nuclei.join(n, "cell_id", "left").withColumn("n_candidate_bins", F.coalesce("n", F.lit(0))).drop("n")


def _two_closest(pairs: DataFrame) -> DataFrame:
    """(barcode, first, second) of pairs (barcode, cell_id, dist_um).

    ``row_number() <= 2`` is a group limit applied before the shuffle, so a crowded bin
    sends at most two nuclei per task.
    """
    entry = F.struct(F.col("dist_um").alias("d"), F.col("cell_id").alias("c"))
    w = Window.partitionBy("barcode").orderBy("dist_um", "cell_id")
    ranked = pairs.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    return ranked.groupBy("barcode").agg(
        F.min(entry).alias("first"), F.max(F.when(F.col("_rn") == 2, entry)).alias("second"))


def _pyramid(centres: DataFrame, size: float) -> DataFrame:
    """Occupied squares (level, cx, cy) with their number of centres, counted up to 2, and parent square.

    A square of level k has the side ``size * PYRAMID_FAN ** k``.
    """
    side = F.lit(float(size)) * F.pow(F.lit(float(PYRAMID_FAN)), F.col("level"))
    placed = centres.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(PYRAMID_LEVELS - 1)))).select(
        "level", F.floor(F.col("center_x_um") / side).cast("long").alias("cx"), F.floor(F.col("center_y_um") / side).cast("long").alias("cy"))
    up = lambda c: F.floor(F.col(c) / PYRAMID_FAN).cast("long")
    return placed.groupBy("level", "cx", "cy").agg(F.least(F.count("*"), F.lit(2)).alias("n")).select("level", "cx", "cy", "n", up("cx").alias("ux"), up("cy").alias("uy"))


def far_two(bins: DataFrame, centres: DataFrame, size: float) -> DataFrame:
    """The two closest centres of bins, at any distance: (barcode, first, second).

    Bins of one square look together. From the root of the pyramid downwards a square keeps
    those occupied squares that may hold one of the two closest centres of any of its points:
    their least distance is not above the second smallest of the greatest distances. What is
    kept is a ring around the closest centres on every level, a few squares whatever lies
    inside or outside of it, so that a level costs an equality join and one group per square.
    """
    half = float(size) / 2.0
    at = lambda c: F.floor(F.col(c) / half).cast("long")
    placed = bins.select("barcode", "x_um", "y_um", at("x_um").alias("bx"), at("y_um").alias("by"))
    squares = write_stage(_pyramid(centres, size), "pyramid")
    rings = placed.select("bx", "by").distinct().withColumn("kept", F.array(F.struct(F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))))
    # the search starts under the lowest level that has a few squares only, all of them under one root
    few = squares.groupBy("level").count().filter(F.col("count") <= PYRAMID_FAN ** 2).agg(F.min("level")).first()[0]
    top = PYRAMID_LEVELS - 1 if few is None else few
    for level in range(top, -1, -1):
        side = float(size) * PYRAMID_FAN ** level
        above = lambda c: F.lit(0).cast("long").alias(c) if level == top else F.col(c)
        children = squares.filter(F.col("level") == level).select(above("ux"), above("uy"), "cx", "cy", "n")
        rows = rings.select("bx", "by", F.explode("kept").alias("k")).select("bx", "by", F.col("k.cx").alias("ux"), F.col("k.cy").alias("uy")).join(children, ["ux", "uy"])

        def apart(c: str, b: str) -> tuple[Column, Column]:
            low, own = F.col(c) * side, F.col(b) * half
            return (F.greatest(F.lit(0.0), low - own - half, own - low - side), F.greatest(low + side - own, own + half - low))

        (dx, far_x), (dy, far_y) = apart("cx", "bx"), apart("cy", "by")
        entry = F.struct(F.sqrt(far_x * far_x + far_y * far_y).alias("far"), "n", F.sqrt(dx * dx + dy * dy).alias("near"), "cx", "cy")
        met = rows.groupBy("bx", "by").agg(F.sort_array(F.collect_list(entry)).alias("all"))
        bound = F.when(F.get("all", F.lit(0))["n"] > 1, F.get("all", F.lit(0))["far"]).otherwise(F.coalesce(F.get("all", F.lit(1))["far"], F.lit(float("inf"))))
        kept = met.withColumn("bound", bound * (1.0 + 1.0e-12)).select("bx", "by", F.filter("all", lambda e: e["near"] <= F.col("bound")).alias("all"))
        rings = kept.select("bx", "by", F.transform("all", lambda e: F.struct(e["cx"].alias("cx"), e["cy"].alias("cy"))).alias("kept"))
    ends = rings.select("bx", "by", F.explode("kept").alias("k")).select("bx", "by", "k.cx", "k.cy")
    homes = centres.select("cell_id", "center_x_um", "center_y_um", F.floor(F.col("center_x_um") / size).cast("long").alias("cx"), F.floor(F.col("center_y_um") / size).cast("long").alias("cy"))
    dx, dy = F.col("center_x_um") - F.col("x_um"), F.col("center_y_um") - F.col("y_um")
    pairs = ends.join(homes, ["cx", "cy"]).join(placed, ["bx", "by"]).select("barcode", "cell_id", F.sqrt(dx * dx + dy * dy).alias("dist_um"))
    return _two_closest(pairs)


def nearest_other_nucleus(candidates: DataFrame, nuclei: DataFrame, start_radius: float) -> DataFrame:
    """``d_other``: distance from a candidate bin to the closest nucleus other than its cell's.

    Bins whose two closest nuclei lie within the start radius are settled by a radius join,
    the others by a search through a pyramid of occupied squares; null then means there is
    no other nucleus.
    """
    centres = nuclei.select("cell_id", "center_x_um", "center_y_um")
    bins = candidates.select("barcode", "x_um", "y_um").distinct()
    near = bucket_join(centres, bins, ("center_x_um", "center_y_um"), ("x_um", "y_um"), start_radius)
    found = write_stage(bins.join(_two_closest(near), "barcode", "left"), "nearest")
    top, alone = found.filter("second is not null").select("barcode", "first", "second"), found.filter("second is null")
    if not alone.isEmpty():
        top = top.unionByName(far_two(alone.select("barcode", "x_um", "y_um"), centres, start_radius))
    own_first = F.col("first.c") == F.col("cell_id")
    return candidates.join(top, "barcode", "left").select(
        *candidates.columns,
        F.when(own_first, F.col("second.d")).otherwise(F.col("first.d")).alias("d_other"))


def context_cells(targets: DataFrame, nuclei: DataFrame, radius_um: float, max_cells: int) -> DataFrame:
    """Context of every target: itself first, then the nearest cells within the radius.

    ``row_number() <= cap`` is a group limit, which Spark applies before the shuffle, so a
    crowded target never brings all its neighbours into one task.
    """
    t = targets.select(F.col("cell_id").alias("target_id"), F.col("center_x_um").alias("tx"), F.col("center_y_um").alias("ty"))
    n = nuclei.select("cell_id", "center_x_um", "center_y_um")
    pairs = bucket_join(t, n, ("tx", "ty"), ("center_x_um", "center_y_um"), radius_um)
    is_other = (F.col("cell_id") != F.col("target_id")).cast("int")
    w = Window.partitionBy("target_id").orderBy(is_other, "dist_um", "cell_id")
    ranked = pairs.withColumn("context_rank", F.row_number().over(w))
    if max_cells > 0:
        ranked = ranked.filter(F.col("context_rank") <= max_cells)
    return ranked.select("target_id", "cell_id", "dist_um", "context_rank")


def within_distance(rows: DataFrame, targets: DataFrame, radius: float, x: str = "array_col", y: str = "array_row") -> DataFrame:
    """Rows that have any target strictly nearer than ``radius`` (semi-join)."""
    distinct = rows.select(F.col(x).alias("_rx"), F.col(y).alias("_ry")).distinct()
    t = targets.select(F.col(x).cast("double").alias("_tx"), F.col(y).cast("double").alias("_ty")).distinct()
    near = bucket_join(distinct, t, ("_rx", "_ry"), ("_tx", "_ty"), radius).filter(F.col("dist_um") < radius)
    hits = near.select(F.col("_rx").alias(x), F.col("_ry").alias(y)).distinct()
    return rows.join(hits, [x, y], "left_semi")


def rows_in_boxes(points: DataFrame, boxes: DataFrame, box_size: float, keys: Sequence[str], x: str = "x_um", y: str = "y_um") -> DataFrame:
    """Points inside inclusive boxes no larger than ``box_size``, via a bucket equality.

    A box touches at most a 3x3 block of buckets of its size.
    """
    centre = boxes.select(*keys, "x_min", "x_max", "y_min", "y_max",
                          ((F.col("x_min") + F.col("x_max")) / 2).alias("_cx"), ((F.col("y_min") + F.col("y_max")) / 2).alias("_cy"))
    extent = boxes.agg(F.min("x_min").alias("_x0"), F.max("x_max").alias("_x1"), F.min("y_min").alias("_y0"), F.max("y_max").alias("_y1"))
    inside_any = attach_scalars(points, extent).filter(
        F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(F.col("_y0"), F.col("_y1"))).select(*points.columns)
    pts = inside_any.withColumns({"_px": F.col(x), "_py": F.col(y)})
    pairs = bucket_join(centre, pts, ("_cx", "_cy"), ("_px", "_py"), box_size)
    hit = F.col(x).between(F.col("x_min"), F.col("x_max")) & F.col(y).between(F.col("y_min"), F.col("y_max"))
    return pairs.filter(hit).drop("_cx", "_cy", "_px", "_py", "dist_um", "x_min", "x_max", "y_min", "y_max")


def expand_labels(bins: DataFrame, label: str, max_bin_distance: int) -> DataFrame:
    """Unlabelled bins take the nearest labelled bin's label (then the smaller label)."""
    k = int(max_bin_distance)
    offsets = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if (a or b) and a * a + b * b <= k * k]
    spread = bins.filter(F.col(label) > 0).select(
        "array_row", "array_col", F.col(label).alias("_l"),
        F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(a * a + b * b).alias("d2"))
                            for a, b in offsets])).alias("_o"))
    best = spread.groupBy((F.col("array_row") + F.col("_o.dr")).alias("array_row"), (F.col("array_col") + F.col("_o.dc")).alias("array_col")
                          ).agg(F.min(F.struct("_o.d2", "_l")).alias("_b"))
    joined = bins.join(best, ["array_row", "array_col"], "left")
    return joined.select(*bins.columns, F.when(F.col(label) > 0, F.col(label)).otherwise(
        F.coalesce(F.col("_b._l"), F.lit(0))).alias("expanded_label"))
