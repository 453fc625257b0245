"""Queries: spatial joins, adjacency, label joins and identifier expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import ids
from ..functions.ordered import exact_quantiles, ordinal
from ..functions.scalars import attach_scalars
from ..operators import claims, grid, patches, spatial_join as sj
from ..schema import resolve_coordinate_pair, unpivot_prefix
from . import steps
from .registry import R, RS, big, bigs, cte, query, r, rs


@query("j5_candidate_radius_join", f"select cell_id, barcode, matrix_col_index, {RS('dist_um')} from candidates")
def _(ws):
    return ws["candidates"].select("cell_id", "barcode", "matrix_col_index", *rs("dist_um"))


@query("j5_candidate_annulus", f"select cell_id, barcode, {RS('dist_um')} from candidates where abs(radius_um - dist_um) <= 2.0e0")
def _(ws):
    return ws["candidates"].filter(F.abs(F.col("radius_um") - F.col("dist_um")) <= 2.0).select("cell_id", "barcode", *rs("dist_um"))


cte("candidate_counts", """
select n.cell_id, n.center_x_um, n.center_y_um, n.radius_um, coalesce(c.n, 0) as n_candidate_bins from nuclei n
left join (select cell_id, count(*) as n from candidates group by 1) c using (cell_id)""")


@query("a12_candidate_summary", f"""
select count(*) as n_cells, cast(sum(n_candidate_bins) as bigint) as total_candidates, count(*) filter (n_candidate_bins = 0) as n_empty,
 count(*) filter (n_candidate_bins > 0) as n_nonempty, {R('count(*) filter (n_candidate_bins = 0)/count(*)')} as empty_rate,
 {R('avg(n_candidate_bins)')} as mean_candidates, {R('quantile_cont(n_candidate_bins, 0.5)')} as median_candidates,
 {R('quantile_cont(n_candidate_bins, 0.9)')} as p90_candidates, {R('quantile_cont(n_candidate_bins, 0.99)')} as p99_candidates from candidate_counts""")
def _(ws):
    counts = sj.candidate_counts(ws["nuclei"], ws["candidates"])
    n = F.col("n_candidate_bins")
    # a count is limited by the search disc, so the percentile state stays small
    pct = lambda p, name: r(F.percentile(n, p)).alias(name)
    return counts.agg(
        F.count("*").alias("n_cells"), F.sum(n).alias("total_candidates"), F.count_if(n == 0).alias("n_empty"),
        F.count_if(n > 0).alias("n_nonempty"), r(F.count_if(n == 0) / F.count("*")).alias("empty_rate"), r(F.avg(n)).alias("mean_candidates"),
        pct(0.5, "median_candidates"), pct(0.9, "p90_candidates"), pct(0.99, "p99_candidates"))


@query("s7_candidate_store_index", f"""
select row_number() over (order by cell_id) - 1 as episode_index, cell_id, {RS('center_x_um', 'center_y_um', 'radius_um')}, n_candidate_bins from candidate_counts""")
def _(ws):
    from ..sources.candidate_store import index_rows
    return index_rows(ws["nuclei"], ws["candidates"]).select(
        "episode_index", "cell_id", *rs("center_x_um", "center_y_um", "radius_um"), "n_candidate_bins")


cte("nearest_other", """
select c.cell_id, c.barcode, c.dist_um, min(sqrt((n.center_x_um-c.x_um)*(n.center_x_um-c.x_um) + (n.center_y_um-c.y_um)*(n.center_y_um-c.y_um))) as d_other
from candidates c left join nuclei n on n.cell_id <> c.cell_id group by 1, 2, 3""")


@query("j6_nearest_other_nucleus", f"select cell_id, barcode, {RS('d_other')} from nearest_other")
def _(ws):
    return sj.nearest_other_nucleus(ws["candidates"], ws["nuclei"], steps.R_MAX_UM).select("cell_id", "barcode", *rs("d_other"))


@query("j7_context_cells", f"""
select target_id, cell_id, {RS('dist_um')}, context_rank from (select *, row_number() over (partition by target_id order by case when cell_id = target_id then 0 else 1 end, dist_um, cell_id) as context_rank from (
 select a.cell_id as target_id, b.cell_id, sqrt((a.center_x_um-b.center_x_um)*(a.center_x_um-b.center_x_um)+(a.center_y_um-b.center_y_um)*(a.center_y_um-b.center_y_um)) as dist_um from nuclei a, nuclei b) d
 where dist_um <= 50.0e0) q where context_rank <= 24""")
def _(ws):
    return sj.context_cells(ws["nuclei"], ws["nuclei"], 50.0, 24).select("target_id", "cell_id", *rs("dist_um"), "context_rank")


@query("j8_within_distance", """
with target as (select distinct array_row as r, array_col as c from candidates where cell_id % 10 = 1),
near as (select distinct n.cell_id from nuclear_claims n, target t where sqrt((n.array_col-t.c)*(n.array_col-t.c)*1.0e0 + (n.array_row-t.r)*(n.array_row-t.r)*1.0e0) < 2.0e0)
select distinct n.cell_id, n.barcode from nuclear_claims n where n.cell_id in (select cell_id from near) or n.cell_id % 10 = 1""")
def _(ws):
    wanted = F.col("cell_id") % 10 == 1
    targets = ws["candidates"].filter(wanted).select("array_row", "array_col")
    nuclear = ws["nuclear_claims"].select("cell_id", "barcode", "array_row", "array_col")
    near = sj.within_distance(nuclear, targets, 2.0).select("cell_id")
    keep = near.union(nuclear.filter(wanted).select("cell_id")).distinct()
    return nuclear.join(keep, "cell_id", "left_semi").select("cell_id", "barcode").distinct()


@query("j9_eight_neighbours", """
select a.cell_id, a.barcode, b.barcode as n_barcode
from (select cell_id, barcode, array_row + dr as array_row, array_col + dc as array_col from candidates, (values (-1), (0), (1)) r(dr), (values (-1), (0), (1)) c(dc) where dr <> 0 or dc <> 0) a
join candidates b using (cell_id, array_row, array_col)""")
def _(ws):
    c = ws["candidates"].select("cell_id", "barcode", "array_col", "array_row")
    return grid.neighbour_pairs(c, ["cell_id"], "array_col", "array_row", carry=["barcode"]).select("cell_id", "barcode", "n_barcode")


_EDGES = """
select g.cell_id, g.array_col, g.array_row, o.dx, o.dy from gt_cell_bins g, (values (-1,0),(1,0),(0,-1),(0,1)) o(dx, dy)
where not exists (select 1 from gt_cell_bins h where h.cell_id = g.cell_id and h.array_col = g.array_col + o.dx and h.array_row = g.array_row + o.dy)"""
cte("gt_edges", _EDGES)


def gt_edges(ws) -> DataFrame:
    return grid.exposed_edges(ws["gt_cell_bins"], ["cell_id"], "array_col", "array_row")


@query("j10_exposed_edges", "select cell_id, array_col, array_row, dx, dy from gt_edges")
def _(ws):
    return gt_edges(ws)


@query("j10_outline_segments", """
select cell_id, array_col, array_row,
 case when dx <> 0 then array_col + 0.5e0*dx else array_col - 0.5e0 end as x1, case when dx <> 0 then array_row - 0.5e0 else array_row + 0.5e0*dy end as y1,
 case when dx <> 0 then array_col + 0.5e0*dx else array_col + 0.5e0 end as x2, case when dx <> 0 then array_row + 0.5e0 else array_row + 0.5e0*dy end as y2 from gt_edges""")
def _(ws):
    return grid.outline_segments(gt_edges(ws), ["cell_id"], "array_col", "array_row")


@query("j10_boundary_bins", "select distinct cell_id, array_col, array_row from gt_edges")
def _(ws):
    return gt_edges(ws).select("cell_id", "array_col", "array_row").distinct()


@query("j11_occupancy_raster", """
with box as (select cell_id, min(array_col) x0, max(array_col) x1, min(array_row) y0, max(array_row) y1 from gt_cell_bins group by 1),
frame as (select cell_id, cast(unnest(generate_series(x0-1, x1+1)) as int) as gx, y0, y1 from box),
cells as (select cell_id, gx, cast(unnest(generate_series(y0-1, y1+1)) as int) as gy from frame)
select c.cell_id, c.gx, c.gy, case when g.cell_id is null then 0 else 1 end as occupied from cells c left join gt_cell_bins g on g.cell_id = c.cell_id and g.array_col = c.gx and g.array_row = c.gy""")
def _(ws):
    return grid.occupancy_raster(ws["gt_cell_bins"], "cell_id", "array_col", "array_row")


@query("j12_barcode_semi_join", """
select cell_id, barcode from gt_cell_bins where is_nuclear = 1 and barcode in (select barcode from bin_metadata where has_nuclear_annotation)""")
def _(ws):
    seeds = ws["bin_metadata"].filter("has_nuclear_annotation").select("barcode")
    return ws["gt_cell_bins"].filter("is_nuclear = 1").join(seeds, "barcode", "left_semi").select("cell_id", "barcode")


@query("j18_annotation_join", """
select g.cell_id, coalesce(a.label, concat('embedded_', cast(g.is_nuclear as varchar))) as label from gt_cell_bins g
left join (select cast(vec_id as varchar) as cell_id, concat('label_', cast(label as varchar)) as label from embeddings where vec_id % 3 <> 0) a using (cell_id)""")
def _(ws):
    notes = ws["embeddings"].filter("vec_id % 3 <> 0").select(
        F.col("vec_id").cast("string").alias("cell_id"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("label"), F.col("vec_id").alias("o"))
    first = notes.groupBy("cell_id").agg(F.min_by("label", "o").alias("label"))
    return ws["gt_cell_bins"].join(first, "cell_id", "left").select(
        "cell_id", F.coalesce("label", F.concat(F.lit("embedded_"), F.col("is_nuclear").cast("string"))).alias("label"))


_EXTERNAL = """(select barcode, cast(cell_id as varchar) as cell_id, row_number() over (order by barcode, cell_id) as ordinal from nuclear_claims) x"""


def external_labels(ws) -> DataFrame:
    """Nuclear claims as an external label file: several rows per barcode, in file order."""
    rows = ws["nuclear_claims"].select("barcode", F.col("cell_id").alias("c"), F.lit("true").alias("is_nuclear"))
    return ordinal(rows, ["barcode", "c"], "ordinal", start=1).withColumn("cell_id", F.col("c").cast("string")).drop("c")


@query("j22_external_labels_to_bins", f"""
with l as (select barcode, max_by(cell_id, ordinal) as cell_id from {_EXTERNAL} group by 1)
select t.barcode, coalesce(cast(l.cell_id as bigint), 0) as label_id from tissue_positions t left join l using (barcode)""")
def _(ws):
    labels = claims.nuclear_label_per_bin(external_labels(ws))
    return claims.inject_labels(ws["tissue_positions"].select("barcode"), labels, claims.dense_label_codes(labels))


@query("j22_text_label_codes", """
select concat('n', cast(cell_id as varchar)) as cell_id, dense_rank() over (order by concat('n', cast(cell_id as varchar))) as label_id from (select distinct cell_id from nuclear_claims) q""")
def _(ws):
    labels = ws["nuclear_claims"].select(F.concat(F.lit("n"), F.col("cell_id").cast("string")).alias("cell_id")).distinct()
    return claims.dense_label_codes(labels)


@query("j22_force_nuclear", """
select p.barcode, coalesce(b.dominant_cell_id, p.cell_id) as forced_cell_id from pred_assignments p
left join (select barcode, dominant_cell_id from bin_metadata where has_nuclear_annotation and not ambiguous_nuclear_assignment) b using (barcode)""")
def _(ws):
    seeds = ws["bin_metadata"].filter("has_nuclear_annotation and not ambiguous_nuclear_assignment").select("barcode", "dominant_cell_id")
    joined = ws["pred_assignments"].join(seeds, "barcode", "left")
    return claims.force_nuclear(joined, "dominant_cell_id", "cell_id", "forced_cell_id").select("barcode", "forced_cell_id")


@query("j24_matrix_positions", "select barcode, array_row, array_col, in_tissue from tissue_positions where barcode in (select barcode from expression)")
def _(ws):
    return claims.matrix_with_positions(ws["expression"], ws["tissue_positions"]).select("barcode", "array_row", "array_col", "in_tissue")


cte("he_labels", """
select barcode, array_row, array_col, case when has_nuclear_annotation and not ambiguous_nuclear_assignment and max_nuclear_pixel_count >= 12 then dominant_cell_id else 0 end as labels_he from bin_metadata""")
cte("he_expanded", """
select barcode, array_row, array_col, labels_he, case when labels_he > 0 then labels_he else coalesce(best, 0) end as expanded_label from he_labels h left join (
 select u.barcode as b0, arg_min(l.labels_he, ((u.array_row-l.array_row)*(u.array_row-l.array_row)+(u.array_col-l.array_col)*(u.array_col-l.array_col))*1000000 + l.labels_he) as best
 from he_labels u join he_labels l on l.labels_he > 0 and (u.array_row-l.array_row)*(u.array_row-l.array_row)+(u.array_col-l.array_col)*(u.array_col-l.array_col) between 1 and 4 group by 1) b on b.b0 = h.barcode""")


def he_labels(ws) -> DataFrame:
    sure = F.expr("has_nuclear_annotation and not ambiguous_nuclear_assignment and max_nuclear_pixel_count >= 12")
    return ws["bin_metadata"].select("barcode", "array_row", "array_col", F.when(sure, F.col("dominant_cell_id")).otherwise(F.lit(0)).alias("labels_he"))


@query("j25_label_expansion", "select barcode, labels_he, expanded_label from he_expanded")
def _(ws):
    return sj.expand_labels(he_labels(ws), "labels_he", 2).select("barcode", "labels_he", "expanded_label")


@query("j26_label_combination", """
select h.barcode, case when expanded_label > 0 then expanded_label else coalesce(p.cell_id, 0) end as labels_joint,
 case when expanded_label > 0 then 'primary' when coalesce(p.cell_id, 0) > 0 then 'secondary' else 'none' end as labels_joint_source
from he_expanded h left join pred_assignments p using (barcode)""")
def _(ws):
    he = sj.expand_labels(he_labels(ws), "labels_he", 2)
    both = he.join(ws["pred_assignments"].select("barcode", F.col("cell_id").alias("gex")), "barcode", "left")
    both = both.withColumn("gex", F.coalesce("gex", F.lit(0)))
    return claims.combine_labels(both, "expanded_label", "gex").select("barcode", "labels_joint", "labels_joint_source")


# ---- identifier expressions ----

_RAW_ID = "(case o_orderkey % 5 when 0 then concat(' ', cast(o_custkey as varchar), '.000 ') when 1 then cast(o_custkey as varchar) when 2 then '  ' when 3 then concat('c', cast(o_custkey as varchar)) else concat('-', cast(o_custkey as varchar), '.0') end)"


def raw_ids(ws) -> DataFrame:
    return ws["orders"].select("o_orderkey", F.expr(_RAW_ID.replace("varchar", "string")).alias("raw"))


@query("p8_cell_id_normalisation", f"""
select o_orderkey, case when trim({_RAW_ID}) = '' then null when regexp_matches(trim({_RAW_ID}), '^[+-]?[0-9]+\\.0+$') then split_part(trim({_RAW_ID}), '.', 1) else trim({_RAW_ID}) end as cell_id from orders""")
def _(ws):
    return raw_ids(ws).select("o_orderkey", ids.normalize_cell_id(F.col("raw")).alias("cell_id"))


@query("p8_numeric_id_normalisation", """
select l_orderkey, l_linenumber, case when l_quantity*l_discount*10 = floor(l_quantity*l_discount*10) then cast(cast(l_quantity*l_discount*10 as bigint) as varchar) else 'fraction' end as cell_id from lineitem""")
def _(ws):
    v = F.col("l_quantity") * F.col("l_discount") * 10
    return ws["lineitem"].select("l_orderkey", "l_linenumber", F.when(v == F.floor(v), ids.normalize_numeric_id(v)).otherwise("fraction").alias("cell_id"))


_FLAG = "(case o_orderkey % 6 when 0 then ' TRUE ' when 1 then 'y' when 2 then '0' when 3 then 'no' when 4 then null else '1' end)"


@query("p9_boolean_coercion", f"select o_orderkey, coalesce(lower(trim({_FLAG})) in ('1','true','t','yes','y'), false) as flag from orders")
def _(ws):
    return ws["orders"].select("o_orderkey", ids.coerce_bool(F.expr(_FLAG)).alias("flag"))


@query("p10_barcode_parse", """
select barcode, cast(regexp_extract(barcode, '^s_[0-9]+um_([0-9]+)_([0-9]+)(-[0-9]+)?$', 1) as int) as bin_row, cast(regexp_extract(barcode, '^s_[0-9]+um_([0-9]+)_([0-9]+)(-[0-9]+)?$', 2) as int) as bin_col,
 cast(round_even(y_um/2.0e0, 0) as int) as fallback_row from positions_um""")
def _(ws):
    b = F.col("barcode")
    return ws["positions_um"].select("barcode", ids.barcode_row(b, F.col("y_um")).alias("bin_row"), ids.barcode_col(b, F.col("x_um")).alias("bin_col"),
                                     ids.barcode_row(F.lit("other"), F.col("y_um")).alias("fallback_row"))


@query("p11_grid_coordinates", """
with gx as (select min(g) as s from (select x_um - lag(x_um) over (order by x_um) as g from (select distinct x_um from positions_um) d) q where g > 1.0e-6),
gy as (select quantile_cont(g, 0.5) as s from (select y_um - lag(y_um) over (order by y_um) as g from (select distinct y_um from positions_um) d) q where g > 1.0e-6),
o as (select min(x_um) as x0, min(y_um) as y0 from positions_um)
select barcode, cast(round_even((x_um - x0)/gx.s, 0) as int) as gx, cast(round_even((y_um - y0)/gy.s, 0) as int) as gy from positions_um, gx, gy, o""")
def _(ws):
    p = ws["positions_um"]
    out = grid.grid_coordinates(p, "x_um", "y_um", grid.grid_step(p, "x_um", "min"), grid.grid_step(p, "y_um", "median", 2.0), shift_origin=True)
    return out.select("barcode", "gx", "gy")


@query("p13_gene_allowlist", """
select trim(raw) as gene, min(o) as first_position from (select l_orderkey*10 + l_linenumber as o, case l_linenumber when 1 then concat(' G', cast(l_suppkey % 50 as varchar), ' ') when 2 then 'NaN' when 3 then '# note' when 4 then ''
 else concat('G', cast(l_suppkey % 50 as varchar)) end as raw from lineitem) q where trim(raw) <> '' and lower(trim(raw)) <> 'nan' and not starts_with(trim(raw), '#') group by 1""")
def _(ws):
    from ..operators.expression import gene_allowlist
    raw = F.expr("case l_linenumber when 1 then concat(' G', cast(l_suppkey % 50 as string), ' ') when 2 then 'NaN' when 3 then '# note' when 4 then '' else concat('G', cast(l_suppkey % 50 as string)) end")
    return gene_allowlist(ws["lineitem"].select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), raw.alias("name")), "name", first_seen="o")


@query("p14_slug", "select p_partkey, case when trim(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '_') = '' then 'run' else trim(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '_') end as slug from part")
def _(ws):
    return ws["part"].select("p_partkey", ids.slug(F.col("p_name"), "run").alias("slug"))


@query("p15_json_id_list", """
select o_orderkey, case when o_orderkey % 4 = 0 then concat(cast(o_custkey as varchar), '|x') else concat(cast(o_custkey as varchar), '|x|7') end as ids from orders""")
def _(ws):
    text = F.expr("concat('[\"', cast(o_custkey as string), '.0\", \"x\", ', case when o_orderkey % 4 = 0 then '\" \"' else '7' end, ']')")
    return ws["orders"].select("o_orderkey", F.array_join(ids.json_id_list(text), "|").alias("ids"))


@query("p16_overlap_category", """
select p_partkey, case when pred is null and gt is null then 'unscored' when pred is null then 'gt_only' when gt is null then 'pred_only' when m is null then 'unmatched_owner' when m = gt then 'correct_owner' else 'wrong_owner' end as category
from (select p_partkey, case when p_partkey % 5 > 0 then 'a' end as pred, case when p_partkey % 7 > 1 then cast(p_size % 3 as varchar) end as gt, case when p_partkey % 11 > 1 then cast(p_partkey % 3 as varchar) end as m from part) q""")
def _(ws):
    t = ws["part"].select("p_partkey", F.expr("case when p_partkey % 5 > 0 then 'a' end").alias("p"),
                          F.expr("case when p_partkey % 7 > 1 then cast(p_size % 3 as string) end").alias("g"),
                          F.expr("case when p_partkey % 11 > 1 then cast(p_partkey % 3 as string) end").alias("m"))
    return t.select("p_partkey", ids.overlap_category(F.col("p"), F.col("m"), F.col("g")).alias("category"))


@query("p17_safe_ratio", f"select l_orderkey, l_linenumber, case when floor(l_discount*100) - 3 > 0 then {R('l_quantity/(floor(l_discount*100) - 3)')} end as ratio from lineitem")
def _(ws):
    d = F.floor(F.col("l_discount") * 100) - 3
    return ws["lineitem"].select("l_orderkey", "l_linenumber", r(ids.finite_or_null(ids.safe_ratio(F.col("l_quantity"), d))).alias("ratio"))


@query("p18_column_pair_and_prefix", """
select cell_id, gx, gy, unnest(['nuclear','px']) as metric, unnest([is_nuclear, n_px]) as value from (select cell_id, array_col as gx, array_row as gy, cast(is_nuclear as bigint) as is_nuclear, n_px from gt_cell_bins) q""")
def _(ws):
    g = ws["gt_cell_bins"]
    x, y = resolve_coordinate_pair(g.columns)
    wide = g.select("cell_id", F.col(x).alias("gx"), F.col(y).alias("gy"), F.col("is_nuclear").cast("bigint").alias("expr_nuclear"), F.col("n_px").alias("expr_px"))
    return unpivot_prefix(wide, ["cell_id", "gx", "gy"], "expr_", "metric", "value")


@query("p21_evaluation_subset", """
with t as (select trim(replace(raw, '.0', '')) as cell_id, min(o) as pos from (select l_orderkey*10+l_linenumber as o, concat(cast(l_partkey % 60 as varchar), '.0') as raw from lineitem) q group by 1)
select cell_id, array_row, array_col from gt_cell_bins where cell_id in (select cell_id from t order by pos limit 40)""")
def _(ws):
    listed = ws["lineitem"].select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.concat((F.col("l_partkey") % 60).cast("string"), F.lit(".0")).alias("raw"))
    first = listed.groupBy(ids.normalize_cell_id(F.col("raw")).alias("cell_id")).agg(F.min("o").alias("pos"))
    head = first.orderBy("pos").limit(40)
    return ws["gt_cell_bins"].join(head, "cell_id", "left_semi").select("cell_id", "array_row", "array_col")
