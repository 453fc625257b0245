"""Queries: scans, pixel ingest, claims, bin metadata and nuclei."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ordered import exact_quantiles, ordinal
from ..functions.scalars import attach_scalars
from ..operators import claims, grid, nuclei, spatial_join as sj
from . import steps
from .registry import R, RS, big, bigs, query, r, rs

@query("s1_table_scan", "select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity > 45")
def _(ws):
    return ws["lineitem"].filter("l_quantity > 45").select("l_orderkey", "l_partkey", "l_quantity")


@query("s3_barcode_order", "select barcode, matrix_col_index from bin_metadata")
def _(ws):
    return ws["barcodes"]


@query("s4_feature_dictionary", """
select gene, matrix_feature_index, (select count(*) from genes) as n_total_features from selected_genes""")
def _(ws):
    return attach_scalars(ws["selected_genes"], ws["genes"].agg(F.count("*").alias("n_total_features"))).drop("feature_type")


@query("s6_manifest", """
select count(*) as n_rows, count(distinct barcode) as n_barcodes, count(distinct cell_id) as n_cells, cast(sum(is_nuclear) as bigint) as n_nuclear_rows,
 any_value(crop_height_px) as crop_height_px, any_value(crop_width_px) as crop_width_px from compartments, crop_rectangle""")
def _(ws):
    from ..sources.manifest import claims_manifest
    return claims_manifest(ws["compartments"], ws["crop_rectangle"])


@query("p1_quality_report", """
select * from (
 select 'null:cell_id' as check_name, count(*) filter (cell_id is null) as n_bad from pixels
 union all select 'null:x', count(*) filter (x is null) from pixels
 union all select 'non_numeric:x', 0 from (select 1) o
 union all select 'non_finite:x', 0 from (select 1) o
 union all select 'null:y', count(*) filter (y is null) from pixels
 union all select 'non_numeric:y', 0 from (select 1) o
 union all select 'non_finite:y', 0 from (select 1) o
 union all select 'non_positive:cell_id', count(*) filter (not cell_id > 0) from pixels
 union all select 'duplicate:cell_id', count(cell_id) - count(distinct cell_id) from pixels) q""")
def _(ws):
    from ..schema import quality_report
    return quality_report(ws["pixels"], ["cell_id"], ["x", "y"], ["cell_id"])


@query("p1_mixed_report", """
with t as (select nullif(o_custkey % 7, 0) as k, case when o_orderkey % 11 = 0 then 'n/a' when o_orderkey % 13 = 0 then 'Infinity' when o_orderkey % 17 <> 0 then cast(cast(o_orderkey as double) - 5000.0e0 as varchar) end as v from orders)
select 'null:k' as check_name, count(*) filter (k is null) as n_bad from t union all select 'null:v', count(*) filter (v is null) from t
union all select 'non_numeric:v', count(*) filter (v is not null and try_cast(v as double) is null) from t
union all select 'non_finite:v', count(*) filter (isinf(try_cast(v as double)) or isnan(try_cast(v as double))) from t
union all select 'non_positive:k', count(*) filter (not k > 0) from t
union all select 'duplicate:k', count(k) - count(distinct k) from t""")
def _(ws):
    from ..schema import quality_report
    number = F.when(F.expr("o_orderkey % 11 = 0"), "n/a").when(F.expr("o_orderkey % 13 = 0"), "Infinity").when(
        F.expr("o_orderkey % 17 <> 0"), (F.col("o_orderkey").cast("double") - 5000.0).cast("string"))
    t = ws["orders"].select(F.expr("nullif(o_custkey % 7, 0)").alias("k"), number.alias("v"))
    return quality_report(t, ["k"], ["v"], ["k"])


@query("p2_signal_pixels", "select x, y, cell_id from pixels where is_nuclear > 0 or is_cytoplasm > 0 or is_boundary > 0")
def _(ws):
    return grid.signal_pixels(ws["pixels"]).select("x", "y", "cell_id")


@query("p3_inside_crop", """
select x, y, cell_id from pixels, crop_rectangle where x >= 0 and x < crop_width_px and y >= 0 and y < crop_height_px""")
def _(ws):
    return grid.pixels_inside(ws["pixels"], ws["crop_rectangle"]).select("x", "y", "cell_id")


@query("p4_bin_footprints", "select barcode, row_left, row_right, col_up, col_down from footprints")
def _(ws):
    return ws["footprints"].select("barcode", "row_left", "row_right", "col_up", "col_down")


@query("p5_crop_metadata", """
select r.*, (select min(array_row) from tissue_positions where in_tissue = 1) as start_row, (select max(array_row)+1 from tissue_positions where in_tissue = 1) as end_row,
 (select min(array_col) from tissue_positions where in_tissue = 1) as start_col, (select max(array_col)+1 from tissue_positions where in_tissue = 1) as end_col from crop_rectangle r""")
def _(ws):
    return attach_scalars(ws["crop_rectangle"], grid.array_bounds(ws["footprints"]))


@query("p5_crop_relative_bins", "select barcode, y_from, y_to, x_from, x_to from crop_relative")
def _(ws):
    return ws["crop_relative"].select("barcode", "y_from", "y_to", "x_from", "x_to")


@query("p6_microns", f"select barcode, {RS('x_um', 'y_um')} from positions_um")
def _(ws):
    return ws["positions_um"].select("barcode", *rs("x_um", "y_um"))


@query("p7_output_filters", f"select barcode, cell_id, {RS('weight')} from compartments where is_nuclear = 1 and in_tissue = 1")
def _(ws):
    return claims.filter_claims(ws["compartments"], nuclear_only=True, in_tissue_only=True).select("barcode", "cell_id", *rs("weight"))


@query("p12_box_containment", """
select cell_id from nuclei where center_x_um between 104 and 140 and center_y_um between 60 and 90""")
def _(ws):
    return ws["nuclei"].filter(F.col("center_x_um").between(104, 140) & F.col("center_y_um").between(60, 90)).select("cell_id")


@query("p19_synthetic_bins", """
select cell_id, cast(floor(x*0.5e0/2.0e0) as int) as bin_x, cast(floor(y*0.5e0/2.0e0) as int) as bin_y, max(is_nuclear) as is_nuclear
from pixels where cell_id > 0 group by 1, 2, 3""")
def _(ws):
    return grid.synthetic_bins(ws["pixels"], steps.MPP, 2.0)


@query("p20_central_region", """
select barcode from tissue_positions, (select quantile_cont(array_row, 0.4) r0, quantile_cont(array_row, 0.6) r1, quantile_cont(array_col, 0.4) c0, quantile_cont(array_col, 0.6) c1 from tissue_positions) q
where array_row between r0 and r1 and array_col between c0 and c1""")
def _(ws):
    t = ws["tissue_positions"]
    for c in ("array_row", "array_col"):
        t = attach_scalars(t, exact_quantiles(ws["tissue_positions"], [], c, {f"{c}_lo": 0.4, f"{c}_hi": 0.6}))
    return t.filter("array_row between array_row_lo and array_row_hi and array_col between array_col_lo and array_col_hi").select("barcode")


@query("j1_pixel_to_bin", "select x, y, cell_id, bin_ordinal from assigned_pixels")
def _(ws):
    return ws["assigned_pixels"].select("x", "y", "cell_id", "bin_ordinal")


@query("j2_many_to_one_metadata", f"select barcode, cell_id, array_row, array_col, in_tissue, {RS('x_um', 'y_um')} from pixel_counts")
def _(ws):
    return ws["pixel_counts"].select("barcode", "cell_id", "array_row", "array_col", "in_tissue", *rs("x_um", "y_um"))


@query("j2_repeated_keys", "select barcode, count(*) as n_rows from pixel_counts group by 1 having count(*) > 1")
def _(ws):
    from ..schema import duplicate_keys
    return duplicate_keys(ws["pixel_counts"], ["barcode"])


@query("j3_barcodes_without_position", "select distinct barcode from expression where barcode not in (select barcode from tissue_positions where in_tissue = 1)")
def _(ws):
    return claims.barcodes_without_position(ws["expression"].select("barcode").distinct(), ws["tissue_positions"].filter("in_tissue = 1"))


@query("a1_compartment_counts", """
select barcode, cell_id, cell_type, nuclear_pixel_count, cytoplasm_pixel_count, boundary_pixel_count, interior_pixel_count, total_compartment_pixels from pixel_counts""")
def _(ws):
    return ws["pixel_counts"].select("barcode", "cell_id", "cell_type", *claims.COUNTS, "total_compartment_pixels")


@query("a2_compartment_split", f"""
select barcode, cell_id, {RS('weight')}, is_nuclear, is_cytoplasm, is_boundary, is_interior from compartments""")
def _(ws):
    return ws["compartments"].select("barcode", "cell_id", *rs("weight"), "is_nuclear", "is_cytoplasm", "is_boundary", "is_interior")


@query("a3_claims_by_barcode", f"""
select barcode, total_nuclear_pixel_count, max_nuclear_pixel_count, n_cell_claims, dominant_cell_id, {RS('max_weight', 'dominant_weight')},
 n_cell_claims > 1 as ambiguous_nuclear_assignment from claims_by_barcode""")
def _(ws):
    return claims.claims_by_barcode(ws["nuclear_claims"]).select(
        "barcode", "total_nuclear_pixel_count", "max_nuclear_pixel_count", "n_cell_claims", "dominant_cell_id",
        *rs("max_weight", "dominant_weight"), "ambiguous_nuclear_assignment")


BIN_METADATA_SQL = f"""
select matrix_col_index, bin_id, barcode, array_row, array_col, in_tissue, {RS('x_um', 'y_um')}, has_nuclear_annotation, dominant_cell_id,
 {RS('dominant_weight')}, total_nuclear_pixel_count, max_nuclear_pixel_count, n_cell_claims, ambiguous_nuclear_assignment, {RS('max_weight')} from bin_metadata"""


def bin_metadata_rows(ws) -> DataFrame:
    return ws["bin_metadata"].select(
        "matrix_col_index", "bin_id", "barcode", "array_row", "array_col", "in_tissue", *rs("x_um", "y_um"), "has_nuclear_annotation",
        "dominant_cell_id", *rs("dominant_weight"), "total_nuclear_pixel_count", "max_nuclear_pixel_count", "n_cell_claims",
        "ambiguous_nuclear_assignment", *rs("max_weight"))


query("j3_bin_metadata", BIN_METADATA_SQL)(bin_metadata_rows)


@query("j4_claims_column_index", "select c.barcode, c.cell_id, b.matrix_col_index from nuclear_claims c join bin_metadata b using (barcode)")
def _(ws):
    return claims.with_column_index(ws["nuclear_claims"], ws["bin_metadata"]).select("barcode", "cell_id", "matrix_col_index")


@query("a4_nuclei", f"""
select cell_id, {RS('center_x_um', 'center_y_um', 'radius_um')}, nuclear_pixel_count, {RS('center_x_fullres_px', 'center_y_fullres_px')},
 bbox_min_x, bbox_max_x, bbox_min_y, bbox_max_y from nuclei""")
def _(ws):
    return ws["nuclei"].select("cell_id", *rs("center_x_um", "center_y_um", "radius_um"), "nuclear_pixel_count",
                               *rs("center_x_fullres_px", "center_y_fullres_px"), "bbox_min_x", "bbox_max_x", "bbox_min_y", "bbox_max_y")


@query("a5_nuclei_summary", f"""
select count(*) as n_nuclei, {R('avg(radius_um)')} as mean_radius_um, {R('max(radius_um)')} as max_radius_um, {R('quantile_cont(radius_um, 0.5)')} as median_radius_um from nuclei""")
def _(ws):
    return nuclei.nuclei_summary(ws["nuclei"]).select("n_nuclei", *rs("mean_radius_um", "max_radius_um", "median_radius_um"))


@query("a26_signal_levels", """
with s as (select b.barcode, coalesce(c.v, 0) as nuclear_signal, ln(1.0e0 + coalesce(c.v, 0)) as lg from crop_bins b
 left join (select barcode, cast(sum(nuclear_pixel_count) as bigint) as v from nuclear_claims group by 1) c using (barcode)),
q as (select quantile_cont(lg, 0.99) as vmax from s where lg > 0)
select barcode, nuclear_signal, cast(round_even(least(greatest(lg/greatest(vmax, 1.0e-8), 0.0e0), 1.0e0)*255.0e0, 0) as int) as level from s, q""")
def _(ws):
    return claims.signal_levels(ws["nuclear_claims"], ws["crop_bins"])


_LABELS = ("(select x, y, cell_id, cast(floor((y+5)/20.0e0) as bigint)*9 + cast(floor((x+4)/20.0e0) as bigint) + 1 as nid, "
           "case when is_nuclear = 1 or (x + y) % 3 = 0 then 1 else 0 end as has_n from pixels) l")


def label_layers(ws) -> DataFrame:
    """Cell labels with a shifted nucleus label layer over part of the pixels."""
    nid = (F.floor((F.col("y") + 5) / 20.0).cast("bigint") * 9 + F.floor((F.col("x") + 4) / 20.0).cast("bigint") + 1)
    has = (F.col("is_nuclear") == 1) | ((F.col("x") + F.col("y")) % 3 == 0)
    return ws["pixels"].select("x", "y", "cell_id", F.when(has, nid).otherwise(F.lit(0)).alias("nucleus_id"))


@query("a27_nucleus_cell_match", f"""
select cell_id, nucleus_id, n_px from (select cell_id, nid as nucleus_id, count(*) as n_px, row_number() over (partition by cell_id order by count(*) desc, nid) as rn
 from {_LABELS} where has_n = 1 and cell_id > 0 group by 1, 2) q where rn = 1""")
def _(ws):
    return grid.best_partner(label_layers(ws).filter("cell_id > 0 and nucleus_id > 0"), "cell_id", "nucleus_id")


@query("a28_pixel_classes", f"""
with l0 as (select x, y, cell_id, case when has_n = 1 then nid else 0 end as nucleus_id from {_LABELS}),
best as (select cell_id, nucleus_id from (select cell_id, nucleus_id, row_number() over (partition by cell_id order by count(*) desc, nucleus_id) as rn
 from l0 where nucleus_id > 0 and cell_id > 0 group by 1, 2) q where rn = 1),
edge as (select distinct a.x, a.y from l0 a join l0 b on b.cell_id <> a.cell_id and ((b.x = a.x + 1 and b.y = a.y) or (b.x = a.x - 1 and b.y = a.y) or (b.x = a.x and b.y = a.y + 1) or (b.x = a.x and b.y = a.y - 1))),
f as (select l0.x, l0.y, l0.cell_id, case when e.x is not null then 1 else 0 end as is_boundary,
 case when e.x is null and l0.nucleus_id > 0 and l0.nucleus_id = b.nucleus_id then 1 else 0 end as is_nuclear
 from l0 left join edge e on e.x = l0.x and e.y = l0.y left join best b on b.cell_id = l0.cell_id)
select x, y, cell_id, is_boundary, 1 - is_boundary as is_interior, is_nuclear, 1 - is_boundary - is_nuclear as is_cytoplasm from f""")
def _(ws):
    return grid.pixel_classes(label_layers(ws))


@query("u1_union_compartments", "select barcode, cell_id, 'nuclear' as compartment from compartments where is_nuclear = 1 union all select barcode, cell_id, 'cytoplasm' from compartments where is_cytoplasm = 1 union all select barcode, cell_id, 'boundary' from compartments where is_boundary = 1")
def _(ws):
    c = ws["compartments"]
    part = lambda flag, name: c.filter(F.col(flag) == 1).select("barcode", "cell_id", F.lit(name).alias("compartment"))
    return part("is_nuclear", "nuclear").unionByName(part("is_cytoplasm", "cytoplasm")).unionByName(part("is_boundary", "boundary"))
