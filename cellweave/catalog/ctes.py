"""Oracle building blocks: the derived tables written as plain SQL, independent of Spark code."""

from .registry import cte

cte("events_log", """
select event_id, user_id as episode_id, row_number() over (partition by user_id order by ts, event_id) as step_index,
 case event_type when 'click' then 'add' when 'view' then 'replace' when 'purchase' then 'add' when 'error' then 'noop' else 'stop' end as action,
 event_id % 7 as cell_id, event_id % 120 as k, event_id % 5 <> 0 as applied,
 round(value/100.0e0 - 0.5e0, 4) as reward, round((event_id % 11)/10.0e0, 1) as value_est, event_type = 'signup' as done from events""")
cte("step_log", """
select event_id, episode_id, step_index, action, cell_id,
 concat('s_002um_', lpad(cast(cast(floor(k/40.0e0) as int) as string), 5, '0'), '_', lpad(cast(cast(k % 40 as int) as string), 5, '0'), '-1') as barcode,
 applied, reward, value_est, done from events_log""")
cte("footprints", """
select t.*, cast(round_even(pxl_row_in_fullres - hr, 0) as int) as row_left, cast(round_even(pxl_row_in_fullres + hr, 0) as int) as row_right,
 cast(round_even(pxl_col_in_fullres - hc, 0) as int) as col_up, cast(round_even(pxl_col_in_fullres + hc, 0) as int) as col_down
from tissue_positions t, (select (max(pxl_row_in_fullres)-min(pxl_row_in_fullres))/(2.0e0*(max(array_row)+1)) as hr,
 (max(pxl_col_in_fullres)-min(pxl_col_in_fullres))/(2.0e0*(max(array_col)+1)) as hc from tissue_positions) h""")
cte("crop_bins", """
select f.* from footprints f, (select min(array_row) r0, max(array_row)+1 r1, min(array_col) c0, max(array_col)+1 c1 from tissue_positions where in_tissue = 1) b
where array_row >= r0 and array_row < r1 and array_col >= c0 and array_col < c1""")
cte("crop_rectangle", """
select *, crop_bottom - crop_top as crop_height_px, crop_right - crop_left as crop_width_px from (
 select greatest(min(row_left), 0) as crop_top, max(row_right) as crop_bottom, greatest(min(col_up), 0) as crop_left, max(col_down) as crop_right from crop_bins) q""")
cte("crop_relative", """
select b.*, row_left - crop_top as y_from, row_right - crop_top as y_to, col_up - crop_left as x_from, col_down - crop_left as x_to from crop_bins b, crop_rectangle""")
cte("positions_um", "select *, pxl_col_in_fullres*0.5e0 as x_um, pxl_row_in_fullres*0.5e0 as y_um from tissue_positions")
cte("assigned_pixels", """
select * exclude (rn) from (select p.*, b.bin_ordinal, row_number() over (partition by p.x, p.y order by b.bin_ordinal desc) as rn
 from pixels p join crop_relative b on p.x >= b.x_from and p.x < b.x_to and p.y >= b.y_from and p.y < b.y_to
 where (p.is_nuclear > 0 or p.is_cytoplasm > 0 or p.is_boundary > 0) and b.x_from >= 0 and b.y_from >= 0) q where rn = 1""")
cte("pixel_counts", """
select a.bin_ordinal, cell_id, cast(null as varchar) as cell_type, t.barcode, t.array_row, t.array_col, t.in_tissue, t.x_um, t.y_um,
 cast(sum(is_nuclear) as bigint) as nuclear_pixel_count, cast(sum(is_cytoplasm) as bigint) as cytoplasm_pixel_count,
 cast(sum(is_boundary) as bigint) as boundary_pixel_count, cast(sum(is_interior) as bigint) as interior_pixel_count,
 cast(sum(is_nuclear + is_cytoplasm + is_boundary) as bigint) as total_compartment_pixels
from assigned_pixels a join positions_um t using (bin_ordinal) group by all having sum(is_nuclear + is_cytoplasm + is_boundary) > 0""")
cte("compartments", """
select *, nuclear_pixel_count/total_compartment_pixels as weight, 1 as is_nuclear, 0 as is_cytoplasm, 0 as is_boundary, 1 as is_interior from pixel_counts where nuclear_pixel_count > 0
union all select *, cytoplasm_pixel_count/total_compartment_pixels, 0, 1, 0, 1 from pixel_counts where cytoplasm_pixel_count > 0
union all select *, 1.0e0, 0, 0, 1, 0 from pixel_counts where boundary_pixel_count > 0 and nuclear_pixel_count = 0 and cytoplasm_pixel_count = 0""")
cte("nuclear_claims", "select * from compartments where is_nuclear = 1")
cte("claims_by_barcode", """
select barcode, cast(sum(nuclear_pixel_count) as bigint) as total_nuclear_pixel_count, max(nuclear_pixel_count) as max_nuclear_pixel_count,
 count(distinct cell_id) as n_cell_claims, max(weight) as max_weight, max(case when rn = 1 then cell_id end) as dominant_cell_id,
 max(case when rn = 1 then weight end) as dominant_weight
from (select *, row_number() over (partition by barcode order by nuclear_pixel_count desc, weight desc, cell_id) as rn from nuclear_claims) q group by barcode""")
cte("bin_metadata", """
select row_number() over (order by t.bin_ordinal) - 1 as matrix_col_index, t.barcode as bin_id, t.barcode, t.array_row, t.array_col, t.in_tissue, t.x_um, t.y_um,
 t.pxl_row_in_fullres, t.pxl_col_in_fullres, c.barcode is not null as has_nuclear_annotation, c.dominant_cell_id,
 coalesce(c.dominant_weight, 0.0e0) as dominant_weight, coalesce(c.total_nuclear_pixel_count, 0) as total_nuclear_pixel_count,
 coalesce(c.max_nuclear_pixel_count, 0) as max_nuclear_pixel_count, coalesce(c.n_cell_claims, 0) as n_cell_claims,
 coalesce(c.n_cell_claims, 0) > 1 as ambiguous_nuclear_assignment, coalesce(c.max_weight, 0.0e0) as max_weight
from positions_um t left join claims_by_barcode c using (barcode)""")
cte("nuclei", """
select cell_id, (sx/n + crop_left)*0.5e0 as center_x_um, (sy/n + crop_top)*0.5e0 as center_y_um, sqrt(n*0.5e0*0.5e0/pi()) as radius_um, n as nuclear_pixel_count,
 sx/n + crop_left as center_x_fullres_px, sy/n + crop_top as center_y_fullres_px, x0 + crop_left as bbox_min_x, x1 + crop_left as bbox_max_x,
 y0 + crop_top as bbox_min_y, y1 + crop_top as bbox_max_y
from (select cell_id, cast(sum(is_nuclear) as bigint) as n, cast(sum(x) as bigint) as sx, cast(sum(y) as bigint) as sy, min(x) x0, max(x) x1, min(y) y0, max(y) y1
 from pixels where is_nuclear > 0 and cell_id > 0 group by cell_id) m, crop_rectangle""")
cte("candidates", """
select * from (select n.cell_id, n.center_x_um, n.center_y_um, n.radius_um, b.barcode, b.matrix_col_index, b.array_row, b.array_col, b.x_um, b.y_um,
 sqrt((n.center_x_um-b.x_um)*(n.center_x_um-b.x_um) + (n.center_y_um-b.y_um)*(n.center_y_um-b.y_um)) as dist_um
from nuclei n, bin_metadata b) q where dist_um <= 20.0e0""")
cte("genes", """
select gene, case when gene < 'G45' then 'Gene Expression' else 'Antibody Capture' end as feature_type, row_number() over (order by gene) - 1 as matrix_feature_index
from (select distinct gene from expression) g""")
cte("selected_genes", "select * from genes where feature_type = 'Gene Expression'")
cte("typed_cells", """
select m.sc_barcode, m.cell_type, s.n_cells from sc_metadata m join (
 select cell_type, count(*) as n_cells from sc_metadata where cell_type is not null and sc_barcode in (select sc_barcode from sc_expression)
 group by 1 having count(*) >= 20) s using (cell_type) where m.sc_barcode in (select sc_barcode from sc_expression)""")
cte("reference_counts", """
select cell_type, gene, cast(sum(cnt) as bigint) as count from sc_expression join typed_cells using (sc_barcode)
where gene in (select gene from selected_genes) group by 1, 2""")
cte("types", "select cell_type, max(n_cells) as n_cells, row_number() over (order by max(n_cells) desc, cell_type) - 1 as type_index from typed_cells group by 1")
cte("dense_reference", """
select t.cell_type, g.gene, coalesce(c.count, 0) as count from types t cross join selected_genes g left join reference_counts c on c.cell_type = t.cell_type and c.gene = g.gene""")
cte("theta", """
select cell_type, gene, (count + 1.0e-8)/sum(count + 1.0e-8) over (partition by cell_type) as theta, ln((count + 1.0e-8)/sum(count + 1.0e-8) over (partition by cell_type)) as log_theta from dense_reference""")
cte("bin_totals", """
select t.barcode, cast(coalesce(sum(e.cnt), 0) as bigint) as bin_total from tissue_positions t left join (select * from expression where gene in (select gene from selected_genes)) e using (barcode) group by 1""")
cte("ll", """
select t.barcode, k.cell_type, k.type_index, coalesce(s.v, 0.0e0) as ll from tissue_positions t cross join types k left join (
 select barcode, cell_type, sum(cnt*log_theta)/sum(cnt) as v from expression join theta using (gene) group by 1, 2) s on s.barcode = t.barcode and s.cell_type = k.cell_type""")
cte("bin_conf", "select barcode, bin_total, bin_total/(bin_total + 5.0e0) as expr_conf from bin_totals")
