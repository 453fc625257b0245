"""Pixels to bins, claims, nuclei: literal cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import ids
from cellweave.operators import claims, grid, nuclei, spatial_join as sj
from cellweave.schema import assert_unique, check_quality, quality_report, require_columns, resolve_coordinate_pair


def positions(spark):
    rows = [(f"s_002um_{r:05d}_{c:05d}-1", 1, r, c, 1.0 + 2 * r, 1.0 + 2 * c, 2 * r + c) for r in range(2) for c in range(2)]
    return spark.createDataFrame(rows, "barcode string, in_tissue int, array_row int, array_col int, pxl_row_in_fullres double, pxl_col_in_fullres double, bin_ordinal long")


def pixels(spark, rows):
    return spark.createDataFrame(rows, "x int, y int, cell_id long, is_boundary int, is_interior int, is_nuclear int, is_cytoplasm int")


def test_four_nuclear_pixels_fill_two_bins(spark):
    foot = grid.bin_footprints(positions(spark))
    cropped = grid.crop_bins(foot)
    rect = grid.crop_rectangle(cropped)
    rel = grid.crop_relative(cropped, rect)
    px = pixels(spark, [(x, 0, 7, 0, 1, 1, 0) for x in range(4)])
    assigned = grid.assign_pixels(px, grid.bins_by_bucket(rel), rect).withColumn("cell_type", F.lit(None).cast("string"))
    counts = claims.with_bin_metadata(claims.pixel_counts(assigned), grid.to_microns(positions(spark), 1.0))
    rows = claims.split_compartments(counts).collect()
    assert len({x.barcode for x in rows}) == 2
    assert all(x.weight == 1.0 and x.bin_id == x.barcode for x in rows)
    assert sum(x.nuclear_pixel_count for x in rows) + 0 <= 4


def test_later_bin_wins_overlapping_footprints(spark):
    rel = spark.createDataFrame([(0, 0, 2, 0, 2), (1, 0, 2, 1, 3), (2, -1, 1, 0, 1)], "bin_ordinal long, y_from int, y_to int, x_from int, x_to int")
    rect = spark.createDataFrame([(5, 5)], "crop_width_px int, crop_height_px int")
    px = pixels(spark, [(x, y, 7, 0, 1, 1, 0) for x in range(5) for y in range(5)] + [(0, 0, 8, 0, 1, 1, 0)])
    rows = grid.assign_pixels(px, grid.bins_by_bucket(rel), rect).collect()
    owner = {(r.x, r.y): r.bin_ordinal for r in rows}
    assert len(rows) == 7 and len(owner) == 6
    assert owner[(0, 0)] == 0 and owner[(1, 0)] == 1 and owner[(2, 1)] == 1
    assert 2 not in owner.values()


def test_boundary_row_only_without_other_compartments(spark):
    c = spark.createDataFrame([("b0", 3, 2, 4, 5, 9), ("b1", 0, 0, 4, 0, 4)], "barcode string, nuclear_pixel_count long, cytoplasm_pixel_count long, boundary_pixel_count long, interior_pixel_count long, total_compartment_pixels long")
    rows = {(r.barcode, r.is_nuclear, r.is_cytoplasm, r.is_boundary): r.weight for r in claims.split_compartments(c).collect()}
    assert rows == {("b0", 1, 0, 0): 3 / 9, ("b0", 0, 1, 0): 2 / 9, ("b1", 0, 0, 1): 1.0}


def test_claims_to_bin_metadata(spark):
    claim = spark.createDataFrame([("BC0", 1, "T", 1.0, 5), ("BC2", 2, "T", 0.4, 4), ("BC2", 3, "B", 0.6, 6)], "barcode string, cell_id long, cell_type string, weight double, nuclear_pixel_count long")
    bars = spark.createDataFrame([("BC0", 0), ("BC1", 1), ("BC2", 2)], "barcode string, matrix_col_index long")
    pos = spark.createDataFrame([(f"BC{i}", 1, 0, i, 0.0, float(i), float(i), 0.0) for i in range(3)], "barcode string, in_tissue int, array_row int, array_col int, pxl_row_in_fullres double, pxl_col_in_fullres double, x_um double, y_um double")
    meta = claims.bin_metadata(bars, pos, claims.claims_by_barcode(claim))
    out = {r.barcode: r for r in meta.collect()}
    assert [out[f"BC{i}"].has_nuclear_annotation for i in range(3)] == [True, False, True]
    assert [out[f"BC{i}"].total_nuclear_pixel_count for i in range(3)] == [5, 0, 10]
    assert [out[f"BC{i}"].n_cell_claims for i in range(3)] == [1, 0, 2]
    assert out["BC2"].dominant_cell_id == 3 and out["BC2"].ambiguous_nuclear_assignment
    assert sorted(r.matrix_col_index for r in claims.with_column_index(claim, meta).collect()) == [0, 2, 2]


def test_nuclei_centroids(spark):
    px = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 1, 1), (4, 3, 2, 1), (5, 4, 2, 1), (4, 4, 2, 1), (9, 9, 0, 1), (9, 9, 3, 0)], "x int, y int, cell_id long, is_nuclear int")
    rect = spark.createDataFrame([(0, 0)], "crop_left int, crop_top int")
    out = {r.cell_id: r for r in nuclei.nuclei_table(nuclei.nucleus_moments(px), rect, 1.0).collect()}
    assert (out[1].center_x_um, out[1].center_y_um, out[1].nuclear_pixel_count) == (0.5, 0.0, 2)
    assert out[2].center_x_um == pytest.approx(13 / 3) and out[2].center_y_um == pytest.approx(11 / 3)
    assert out[2].radius_um == pytest.approx(math.sqrt(3 / math.pi)) and set(out) == {1, 2}


def test_identifiers(spark):
    raw = spark.createDataFrame([("12.0",), ("12.000",), (" 7 ",), ("",), ("a.0",), ("-3.00",), (None,)], "v string")
    assert [r[0] for r in raw.select(ids.normalize_cell_id(F.col("v"))).collect()] == ["12", "12", "7", None, "a.0", "-3", None]
    nums = spark.createDataFrame([(12.0,), (1.5,), (float("nan"),), (float("inf"),)], "v double")
    assert [r[0] for r in nums.select(ids.normalize_numeric_id(F.col("v"))).collect()] == ["12", "1.5", None, None]
    one = spark.range(1).select(ids.barcode_row(F.lit("s_002um_00001_00002-1")).alias("r"), ids.barcode_col(F.lit("s_002um_00001_00002-1")).alias("c"),
                                ids.barcode_row(F.lit("x"), F.lit(5.0)).alias("f")).first()
    assert (one.r, one.c, one.f) == (1, 2, 2)  # 5 / 2 rounds half to even


def test_load_checks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan"))], "k string, v double")
    with pytest.raises(ValueError):
        require_columns(df, ["missing"], "t")
    with pytest.raises(ValueError):
        assert_unique(df, ["k"], "t")
    with pytest.raises(ValueError, match="non_finite:v=1"):
        check_quality(quality_report(df, ["k"], ["v"]), "t")
    assert resolve_coordinate_pair(["x", "y", "bin_x_index", "bin_y_index"]) == ("bin_x_index", "bin_y_index")


def test_pixel_classes(spark):
    lab = spark.createDataFrame([(x, y, 1 if x < 3 else 2, 5 if x < 2 else 0) for x in range(5) for y in range(3)], "x int, y int, cell_id long, nucleus_id long")
    out = {(r.x, r.y): r for r in grid.pixel_classes(lab).collect()}
    assert out[(0, 0)].is_nuclear == 1 and out[(2, 1)].is_boundary == 1 and out[(3, 1)].is_boundary == 1
    assert out[(4, 0)].is_cytoplasm == 1 and out[(1, 1)].is_interior == 1


def test_radius_join_with_overfull_buckets_equals_brute_force(spark):
    pts = spark.range(400).selectExpr("concat('b', id) as barcode", "cast(id % 20 as double) as x_um", "cast(floor(id / 20) as double) * 0.05 as y_um")
    cells = spark.range(12).selectExpr("id as cell_id", "cast(id * 2 as double) as center_x_um", "0.4D as center_y_um", "1D as radius_um")
    got = {(r.cell_id, r.barcode) for r in sj.bucket_join(cells, pts, ("center_x_um", "center_y_um"), ("x_um", "y_um"), 3.0, max_bucket_rows=7).collect()}
    want = {(c, f"b{i}") for c in range(12) for i in range(400) if math.sqrt((2 * c - i % 20) ** 2 + (0.4 - (i // 20) * 0.05) ** 2) <= 3.0}
    assert got == want


def test_nearest_other_grows_its_radius(spark):
    nuc = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 0.0), (3, 95.0, 0.0)], "cell_id long, center_x_um double, center_y_um double")
    cand = spark.createDataFrame([(1, "a", 1.0, 0.0, 1.0), (2, "b", 91.0, 0.0, 1.0), (1, "c", 0.0, 2.0, 2.0)], "cell_id long, barcode string, x_um double, y_um double, dist_um double")
    out = {r.barcode: r.d_other for r in sj.nearest_other_nucleus(cand, nuc, 2.0).collect()}
    assert out["a"] == 89.0 and out["b"] == 4.0 and out["c"] == pytest.approx(math.hypot(90, 2))
    alone = sj.nearest_other_nucleus(cand.filter("cell_id = 1"), nuc.filter("cell_id = 1"), 2.0)
    assert {r.d_other for r in alone.collect()} == {None}


def test_nearest_other_far_from_a_crowd(spark):
    rng = random.Random(8)
    nuc = [(i, rng.gauss(0, 5), rng.gauss(0, 5)) for i in range(150)] + [(500, 3.0e5, -2.0e4), (501, -900.0, 4000.0), (502, -900.0, 4000.0)] + [(600 + i, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for i in range(40)]
    cand = [(c, f"{c}-{k}", x + rng.uniform(-2, 2), y + rng.uniform(-2, 2), 1.0) for c, x, y in nuc for k in range(2)]
    out = {r.barcode: r.d_other for r in sj.nearest_other_nucleus(
        spark.createDataFrame(cand, "cell_id long, barcode string, x_um double, y_um double, dist_um double"),
        spark.createDataFrame(nuc, "cell_id long, center_x_um double, center_y_um double"), 3.0).collect()}
    want = {b: min(math.hypot(nx - x, ny - y) for n, nx, ny in nuc if n != c) for c, b, x, y, _ in cand}
    assert out == pytest.approx(want)


def test_within_distance_is_strict(spark):
    rows = spark.createDataFrame([(0, 0), (3, 0)], "array_col int, array_row int")
    target = spark.createDataFrame([(1, 0)], "array_col int, array_row int")
    assert [tuple(r) for r in sj.within_distance(rows, target, 2.0).collect()] == [(0, 0)]


def test_label_expansion_tie_takes_smaller_label(spark):
    bins = spark.createDataFrame([(0, 0, 5), (0, 1, 0), (0, 2, 3), (0, 9, 0)], "array_row int, array_col int, l long")
    out = {r.array_col: r.expanded_label for r in sj.expand_labels(bins, "l", 2).collect()}
    assert out == {0: 5, 1: 3, 2: 3, 9: 0}


def test_quality_report_tells_nulls_duplicates_and_text_apart(spark):
    df = spark.createDataFrame([(None, "1"), (None, "x"), (1, None), (1, "inf"), (2, "2.5")], "k long, v string")
    got = {r.check_name: r.n_bad for r in quality_report(df, ["k"], ["v"]).collect()}
    assert got == {"null:k": 2, "null:v": 1, "non_numeric:v": 1, "non_finite:v": 1, "duplicate:k": 1}
    assert {r.check_name: r.n_bad for r in quality_report(df, ["k"], ["k"]).collect()}["null:k"] == 2


def test_bad_load_stops(spark):
    where = spark.createDataFrame([("a",), ("b",)], "barcode string")
    with pytest.raises(ValueError, match="no position"):
        claims.check_positions(spark.createDataFrame([("a",), ("z",)], "barcode string"), where)
    claims.check_positions(where, where)
    labels = spark.createDataFrame([("z", "1")], "barcode string, cell_id string")
    with pytest.raises(ValueError, match="in common"):
        claims.inject_labels(where, labels, claims.dense_label_codes(labels))
