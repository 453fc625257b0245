"""Queries: matching, overlap, gene agreement, patch comparison and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate as ev, expression as ex
from ..workspace import step
from . import steps
from .registry import R, RS, big, bigs, cte, query, r, rs

# ---- derived tables ----


def target_pairs(table: DataFrame, name: str) -> DataFrame:
    return table.filter("is_nuclear = 1").select(F.col("cell_id").cast("string").alias("target_id"), "barcode")


@step("pred_match", stored=True)
def _pred_match(ws):
    return ev.match_by_nuclear_overlap(ev.source_nuclear_bins(ws["bin_metadata"]), target_pairs(ws["pred_assignments"], "pred"))


@step("gt_match", stored=True)
def _gt_match(ws):
    return ev.match_by_nuclear_overlap(ev.source_nuclear_bins(ws["bin_metadata"]), target_pairs(ws["gt_cell_bins"], "gt"))


@step("records", stored=True)
def _records(ws):
    p = ws["pred_match"].select("cell_id", F.col("matched_id").alias("pred_id"), "overlap_bins", F.col("match_method").alias("pred_match_method"))
    g = ws["gt_match"].select("cell_id", F.col("matched_id").alias("gt_id"), "match_method")
    return ev.overlap_metrics(p.join(g, "cell_id"), predicted(ws), truth(ws))


def predicted(ws) -> DataFrame:
    return ws["pred_assignments"].select(F.col("cell_id").cast("string").alias("pred_id"), "barcode")


def truth(ws) -> DataFrame:
    return ws["gt_cell_bins"].select(F.col("cell_id").alias("gt_id"), "barcode")


cte("src_nuclear", "select distinct cast(dominant_cell_id as varchar) as cell_id, barcode from bin_metadata where has_nuclear_annotation and dominant_cell_id is not null")
_MATCH = """
with c as (select s.cell_id, t.target_id, count(*) as c from src_nuclear s join (select distinct cast(cell_id as varchar) as target_id, barcode from {t} where is_nuclear = 1) t using (barcode) group by 1, 2),
b as (select *, row_number() over (partition by cell_id order by c desc, target_id desc) as rn from c), n as (select cell_id, count(*) as n from src_nuclear group by 1)
select n.cell_id, case when ok then target_id end as matched_id, coalesce(case when ok then c end, 0) as overlap_bins, case when ok then c/n end as overlap_frac, case when ok then 'nuclear_overlap' else 'unmatched' end as match_method
from (select n.cell_id, n.n, b.target_id, b.c, coalesce(b.c >= 2 and b.c/n.n >= 0.3, false) as ok from n left join b on b.cell_id = n.cell_id and b.rn = 1) n"""
cte("pred_match", _MATCH.format(t="pred_assignments"))
cte("gt_match", _MATCH.format(t="gt_cell_bins"))
cte("records", """
select *, case when gt_id is not null and u > 0 then i/u end as pred_iou, case when gt_id is not null and pred_n_bins + gt_n_bins > 0 then 2*i/(pred_n_bins + gt_n_bins) end as pred_dice,
 case when gt_id is not null then p end as pred_precision, case when gt_id is not null then r end as pred_recall, case when gt_id is not null then case when p + r > 0 then 2*p*r/(p+r) else 0.0e0 end end as pred_f1,
 case when gt_id is not null then i else 0 end as gt_assigned_intersection, case when gt_id is not null then u else 0 end as gt_assigned_union from (
 select *, pred_n_bins + gt_n_bins - i as u, case when pred_n_bins > 0 then i/pred_n_bins else 0.0e0 end as p, case when gt_n_bins > 0 then i/gt_n_bins else 0.0e0 end as r from (
  select p.cell_id, p.matched_id as pred_id, g.matched_id as gt_id, p.overlap_bins, p.match_method as pred_match_method, g.match_method,
   (select count(distinct a.barcode) from pred_assignments a where cast(a.cell_id as varchar) = p.matched_id) as pred_n_bins,
   (select count(distinct b.barcode) from gt_cell_bins b where b.cell_id = g.matched_id) as gt_n_bins,
   (select count(distinct a.barcode) from pred_assignments a join gt_cell_bins b on a.barcode = b.barcode where cast(a.cell_id as varchar) = p.matched_id and b.cell_id = g.matched_id) as i
  from pred_match p join gt_match g using (cell_id)) x) y""")


@query("j13_nuclear_match_prediction", f"select cell_id, matched_id, overlap_bins, {RS('overlap_frac')}, match_method from pred_match")
def _(ws):
    return ws["pred_match"].select("cell_id", "matched_id", "overlap_bins", *rs("overlap_frac"), "match_method")


@query("j13_nuclear_match_truth", f"select cell_id, matched_id, overlap_bins, {RS('overlap_frac')}, match_method from gt_match")
def _(ws):
    return ws["gt_match"].select("cell_id", "matched_id", "overlap_bins", *rs("overlap_frac"), "match_method")


@query("a22_overlap_metrics", f"select cell_id, pred_id, gt_id, pred_n_bins, gt_n_bins, gt_assigned_intersection, gt_assigned_union, {RS(*ev.OVERLAP_METRICS)} from records")
def _(ws):
    return ws["records"].select("cell_id", "pred_id", "gt_id", "pred_n_bins", "gt_n_bins", "gt_assigned_intersection", "gt_assigned_union", *rs(*ev.OVERLAP_METRICS))


def gene_agreement(ws) -> DataFrame:
    """Predicted cell profiles against the single cell assigned to the matched truth cell."""
    pairs = ws["records"].filter("pred_id is not null and gt_id is not null").select("cell_id", "pred_id", F.concat(F.lit("C"), "gt_id").alias("sc_barcode"))
    genes = ex.common_genes(ws["genes"], ws["sc_expression"])
    n = genes.count()
    members = pairs.join(ws["pred_assignments"].select(F.col("cell_id").cast("string").alias("pred_id"), "barcode"), "pred_id").select("cell_id", "barcode")
    pred = ex.rollup(members, ws["expression"])
    if n < 10:
        raise ValueError("fewer than 10 common genes")
    return ex.spearman_inputs(pred, ws["sc_expression"], pairs.select("cell_id", "sc_barcode"), genes, n)


_GENE = ("gene_spearman_r", "gene_rmse", "pred_gene_total_counts", "gt_gene_total_counts")
cte("gene_grid", """
select q.cell_id, g.gene, coalesce(p.cnt, 0) as p, coalesce(t.cnt, 0) as t from (select cell_id, pred_id, concat('C', gt_id) as sc_barcode from records where pred_id is not null and gt_id is not null) q
cross join (select distinct gene from genes where gene in (select gene from sc_expression)) g
left join (select cast(a.cell_id as varchar) as pred_id, e.gene, sum(e.cnt) as cnt from (select distinct cell_id, barcode from pred_assignments) a join expression e using (barcode) group by 1, 2) p on p.pred_id = q.pred_id and p.gene = g.gene
left join sc_expression t on t.sc_barcode = q.sc_barcode and t.gene = g.gene""")
cte("gene_agreement", """
select cell_id, case when sum(p) > 0 and sum(t) > 0 and stddev_pop(p) > 0 and stddev_pop(t) > 0 then corr(rp, rt) end as gene_spearman_r, sqrt(avg((p - t)*(p - t)*1.0e0)) as gene_rmse,
 cast(sum(p) as double) as pred_gene_total_counts, cast(sum(t) as double) as gt_gene_total_counts, count(*) filter (p > 0) as pred_genes_detected, count(*) filter (t > 0) as gt_genes_detected, count(*) as gene_common_count
from (select *, rank() over (partition by cell_id order by p) + (count(*) over (partition by cell_id, p) - 1)/2.0e0 as rp, rank() over (partition by cell_id order by t) + (count(*) over (partition by cell_id, t) - 1)/2.0e0 as rt from gene_grid) q group by 1""")


@query("a23_gene_agreement", f"select cell_id, {RS(*_GENE)}, pred_genes_detected, gt_genes_detected, gene_common_count from gene_agreement where pred_gene_total_counts > 0 or gt_gene_total_counts > 0")
def _(ws):
    return gene_agreement(ws).select("cell_id", *rs(*_GENE), "pred_genes_detected", "gt_genes_detected", F.col("gene_common_count").cast("bigint").alias("gene_common_count"))


@query("a13_metric_summary", " union all ".join(
    f"select '{m}' as metric, {R(f'avg({m})')} as mean, count({m}) as n_valid, {R(f'quantile_cont({m}, 0.5)')} as median from records" for m in ev.OVERLAP_METRICS))
def _(ws):
    return ev.metric_summary(ws["records"], ev.OVERLAP_METRICS).select("metric", *rs("mean", "median"), "n_valid")


_FRAC = ("matched_pred_fraction", "matched_gt_fraction", "pred_fraction_among_gt_matched", "matched_only_mean_iou")


@query("a13_match_fractions", f"""
select count(*) as n_episodes, count(pred_id) as n_matched_pred, count(gt_id) as n_matched_gt, {R('count(pred_id)/count(*)')} as matched_pred_fraction, {R('count(gt_id)/count(*)')} as matched_gt_fraction,
 {R('count(*) filter (pred_id is not null and gt_id is not null)/count(gt_id)')} as pred_fraction_among_gt_matched, {R('avg(pred_iou) filter (pred_id is not null)')} as matched_only_mean_iou from records""")
def _(ws):
    return ev.match_fractions(ws["records"]).select("n_episodes", "n_matched_pred", "n_matched_gt", *rs(*_FRAC))


@query("a13_method_counts", "select coalesce(pred_match_method, 'unmatched') as method, count(*) as n from records group by 1")
def _(ws):
    return ev.method_counts(ws["records"], "pred_match_method")


@query("a25_metric_histogram", """
select metric, cast(least(floor(value*25), 24) as int) as bin, count(*) as n from (select 'pred_iou' as metric, pred_iou as value from records union all select 'pred_dice', pred_dice from records) q where value is not null group by 1, 2""")
def _(ws):
    return ev.unit_histogram(ws["records"], ["pred_iou", "pred_dice"])


@query("a25_size_histogram", """
select cast(least(floor((pred_n_bins - lo)/(hi - lo)*32), 31) as int) as bin, count(*) as n from records, (select cast(min(pred_n_bins) as double) as lo, cast(max(pred_n_bins) as double) as hi from records) q group by 1""")
def _(ws):
    return ev.range_histogram(ws["records"], "pred_n_bins")


@query("a25_size_relation", f"select cell_id, pred_n_bins > gt_n_bins as overgrown, {R('least(pred_n_bins/greatest(gt_n_bins, 1), 2.5e0)')} as size_ratio from records where gt_id is not null")
def _(ws):
    return ev.size_relation(ws["records"]).select("cell_id", "overgrown", *rs("size_ratio"))


@query("a25_bin_classes", """
with pr as (select cell_id, pred_id, gt_id from records where pred_id is not null and gt_id is not null),
p as (select distinct pr.cell_id, a.barcode from pr join pred_assignments a on cast(a.cell_id as varchar) = pr.pred_id), g as (select distinct pr.cell_id, b.barcode from pr join gt_cell_bins b on b.cell_id = pr.gt_id)
select coalesce(p.cell_id, g.cell_id) as cell_id, coalesce(p.barcode, g.barcode) as barcode, case when p.cell_id is null then 'fn' when g.cell_id is null then 'fp' else 'tp' end as bin_class
from p full outer join g on p.cell_id = g.cell_id and p.barcode = g.barcode""")
def _(ws):
    return ev.bin_classes(ws["records"], predicted(ws), truth(ws))


@query("u2_set_sizes", """
select (select count(*) from (select barcode from pred_assignments intersect select barcode from gt_cell_bins) a) as n_intersection, (select count(*) from (select barcode from pred_assignments union select barcode from gt_cell_bins) a) as n_union""")
def _(ws):
    from ..functions.scalars import attach_scalars
    p, g = ws["pred_assignments"].select("barcode"), ws["gt_cell_bins"].select("barcode")
    return attach_scalars(p.intersect(g).agg(F.count("*").alias("n_intersection")), p.union(g).distinct().agg(F.count("*").alias("n_union")))


@query("l2_pick_worst", f"select cell_id, {RS('pred_iou')} from records order by pred_iou asc nulls last, cell_id limit 10")
def _(ws):
    return ev.pick_records(ws["records"], 10, "worst_iou").select("cell_id", *rs("pred_iou"))


@query("l2_pick_first", "select cell_id from records order by cell_id limit 10")
def _(ws):
    return ev.pick_records(ws["records"], 10, "first").select("cell_id")


@query("l2_pick_best", f"select cell_id, {RS('pred_iou')} from records order by pred_iou desc nulls last, cell_id limit 10")
def _(ws):
    return ev.pick_records(ws["records"], 10, "best_iou").select("cell_id", *rs("pred_iou"))


@query("l2_pick_top_reward", f"""
select r.cell_id, {R('e.total_reward')} as total_reward from records r left join (select cast(cell_id as varchar) as cell_id, round(sum(reward), 6) as total_reward from step_log group by 1) e on e.cell_id = r.cell_id
order by e.total_reward desc nulls last, r.cell_id limit 10""")
def _(ws):
    total = ws["step_log"].groupBy(F.col("cell_id").cast("string").alias("cell_id")).agg(F.round(F.sum("reward"), 6).alias("total_reward"))
    return ev.pick_records(ws["records"].join(total, "cell_id", "left"), 10, "top_reward").select("cell_id", *rs("total_reward"))


@query("l2_pick_random", "select cell_id from records order by md5(concat('3:', cell_id)), cell_id limit 10")
def _(ws):
    return ev.pick_records(ws["records"], 10, "random", seed=3).select("cell_id")


@query("j23_owner_map", """
select pred_id, gt_id from (select pred_id, gt_id, row_number() over (partition by pred_id order by overlap_bins desc, cast(cell_id as bigint)) as rn from records where pred_id is not null and gt_id is not null) q where rn = 1""")
def _(ws):
    return ev.owner_to_truth(ws["records"].withColumn("o", F.col("cell_id").cast("bigint")), "o")


# ---- patch comparison ----

def cell_truth(ws) -> DataFrame:
    return ws["gt_match"].filter("matched_id is not null").select(F.col("cell_id").alias("pred_id"), F.col("matched_id").alias("gt_id"))


@step("patch_predicted", stored=True)
def _patch_predicted(ws):
    """Bins within 6 um of core cells: neighbouring cells dispute some of them."""
    core = ws["patch_members"].filter("role = 'core'").select("patch_id", "cell_id")
    near = ws["candidates"].filter("dist_um <= 7").select("cell_id", "barcode", "x_um", "y_um", "dist_um")
    box = ws["patches"].select("patch_id", "outer_x_min", "outer_x_max", "outer_y_min", "outer_y_max")
    return core.join(near, "cell_id").join(box, "patch_id").filter(
        "x_um between outer_x_min and outer_x_max and y_um between outer_y_min and outer_y_max").select(
        "patch_id", F.col("cell_id").cast("string").alias("cell_id"), "barcode", "x_um", "y_um", "dist_um")


@step("patch_truth", stored=True)
def _patch_truth(ws):
    t = ws["gt_cell_bins"].select(F.col("cell_id").alias("gt_id"), "barcode", "array_row", "array_col", "x_um", "y_um", "is_nuclear", F.col("n_px").cast("double").alias("weight"))
    return ev.truth_by_patch(t, ws["patches"], cell_truth(ws), steps.PATCH["size"])


@step("patch_bins", stored=True)
def _patch_bins(ws):
    p = ws["patch_predicted"]
    return ev.patch_bins(p.filter("dist_um <= 6"), ws["patch_truth"], p.filter("dist_um > 6"), cell_truth(ws), ws["patches"])


@step("patch_cells", stored=True)
def _patch_cells(ws):
    core = ws["patch_members"].filter("role = 'core'").select("patch_id", F.col("cell_id").cast("string").alias("cell_id"))
    return ev.patch_cells(core, ws["patch_predicted"].filter("dist_um <= 6"), ws["patch_truth"], cell_truth(ws))


cte("cell_truth", "select cell_id as pred_id, matched_id as gt_id from gt_match where matched_id is not null")
cte("pp", """
select m.patch_id, cast(m.cell_id as varchar) as cell_id, c.barcode, c.x_um, c.y_um, c.dist_um from pmem m join candidates c using (cell_id) join pbox b using (patch_id)
where m.role = 'core' and c.dist_um <= 7 and abs(c.x_um - b.cx) <= 32.0e0 and abs(c.y_um - b.cy) <= 32.0e0""")
cte("ptruth", """
select * from (select b.patch_id, g.cell_id as gt_id, g.barcode, g.x_um, g.y_um, g.is_nuclear, g.n_px, row_number() over (partition by b.patch_id, g.barcode order by g.n_px desc, g.cell_id) as rn
 from gt_cell_bins g, pbox b where g.cell_id in (select gt_id from cell_truth) and abs(g.x_um - b.cx) <= 32.0e0 and abs(g.y_um - b.cy) <= 32.0e0) q where rn = 1""")
cte("pbins", """
with p as (select patch_id, barcode, min(cell_id) as owner, count(distinct cell_id) as n_owner, min(x_um) as x, min(y_um) as y from pp where dist_um <= 6 group by 1, 2),
t as (select patch_id, barcode, min(x_um) as x, min(y_um) as y from pp where dist_um > 6 group by 1, 2),
k as (select patch_id, barcode from p union select patch_id, barcode from ptruth union select patch_id, barcode from t)
select k.patch_id, k.barcode, coalesce(p.x, g.x_um, t.x) as x_um, coalesce(p.y, g.y_um, t.y) as y_um, p.owner as predicted_owner, m.gt_id as predicted_matched_gt, g.gt_id as gt_owner,
 coalesce(g.is_nuclear > 0, false) as gt_is_nuclear, coalesce(p.n_owner > 1, false) as owner_conflict, p.owner is null and g.gt_id is null as trace_only,
 abs(coalesce(p.x, g.x_um, t.x) - b.cx) <= 24.0e0 and abs(coalesce(p.y, g.y_um, t.y) - b.cy) <= 24.0e0 as inside_core,
 case when p.owner is null and g.gt_id is null then 'unscored' when p.owner is null then 'gt_only' when g.gt_id is null then 'pred_only' when m.gt_id is null then 'unmatched_owner' when m.gt_id = g.gt_id then 'correct_owner' else 'wrong_owner' end as overlap_category
from k join pbox b using (patch_id) left join p on p.patch_id = k.patch_id and p.barcode = k.barcode left join ptruth g on g.patch_id = k.patch_id and g.barcode = k.barcode
left join t on t.patch_id = k.patch_id and t.barcode = k.barcode left join cell_truth m on m.pred_id = p.owner""")
cte("pcells", """
select patch_id, cell_id, matched_gt, np as predicted_bins, ng as gt_bins, ni as intersection, np + ng - ni as union_bins, case when np + ng - ni > 0 then ni/(np + ng - ni) end as patch_iou,
 case when np + ng > 0 then 2*ni/(np + ng) end as patch_dice, case when np > 0 then ni/np end as patch_precision, case when ng > 0 then ni/ng end as patch_recall from (
 select c.*, (select count(*) from pp where pp.patch_id = c.patch_id and pp.cell_id = c.cell_id and dist_um <= 6) as np, (select count(*) from ptruth g where g.patch_id = c.patch_id and g.gt_id = c.matched_gt) as ng,
  (select count(*) from pp join ptruth g on g.patch_id = pp.patch_id and g.barcode = pp.barcode where pp.patch_id = c.patch_id and pp.cell_id = c.cell_id and dist_um <= 6 and g.gt_id = c.matched_gt) as ni
 from (select m.patch_id, cast(m.cell_id as varchar) as cell_id, t.gt_id as matched_gt from pmem m left join cell_truth t on t.pred_id = cast(m.cell_id as varchar) where m.role = 'core') c) q""")


@query("j17_truth_by_patch", "select patch_id, barcode, gt_id, n_px*1.0e0 as weight from ptruth")
def _(ws):
    return ws["patch_truth"].select("patch_id", "barcode", "gt_id", "weight")


@query("j20_patch_bins", """
select patch_id, barcode, x_um, y_um, predicted_owner, predicted_matched_gt, gt_owner, gt_is_nuclear, owner_conflict, overlap_category, trace_only, inside_core from pbins""")
def _(ws):
    return ws["patch_bins"]


_PC = ("patch_iou", "patch_dice", "patch_precision", "patch_recall")


@query("a24_patch_cells", f"select patch_id, cell_id, matched_gt, predicted_bins, gt_bins, intersection, union_bins, {RS(*_PC)} from pcells")
def _(ws):
    return ws["patch_cells"].select("patch_id", "cell_id", "matched_gt", "predicted_bins", "gt_bins", "intersection", "union_bins", *rs(*_PC))


_PM = ("foreground_iou", "foreground_precision", "foreground_recall", "owner_accuracy", "owner_micro_iou", "macro_cell_iou")
_PMC = ("predicted_bins", "gt_bins", "foreground_intersection_bins", "foreground_union_bins", "correct_owner_bins", "wrong_owner_bins", "unmatched_owner_bins",
        "pred_only_bins", "gt_only_bins", "display_bins", "trace_only_bins", "owner_conflicts", "core_cells")
cte("pmetrics", """
select b.*, p + g - i as foreground_union_bins, case when p+g-i > 0 then i/(p+g-i) end as foreground_iou, case when p > 0 then i/p end as foreground_precision, case when g > 0 then i/g end as foreground_recall,
 case when i > 0 then c/i end as owner_accuracy, case when p+g-c > 0 then c/(p+g-c) end as owner_micro_iou, m.macro_cell_iou, m.core_cells, p as predicted_bins, g as gt_bins, i as foreground_intersection_bins, c as correct_owner_bins from (
 select patch_id, count(predicted_owner) as p, count(gt_owner) as g, count(*) filter (predicted_owner is not null and gt_owner is not null) as i, count(*) filter (overlap_category = 'correct_owner') as c,
  count(*) filter (overlap_category = 'wrong_owner') as wrong_owner_bins, count(*) filter (overlap_category = 'unmatched_owner') as unmatched_owner_bins, count(*) filter (overlap_category = 'pred_only') as pred_only_bins,
  count(*) filter (overlap_category = 'gt_only') as gt_only_bins, count(*) as display_bins, count(*) filter (trace_only) as trace_only_bins, count(*) filter (owner_conflict) as owner_conflicts from pbins group by 1) b
left join (select patch_id, avg(patch_iou) as macro_cell_iou, count(*) as core_cells from pcells group by 1) m using (patch_id)""")


@query("a24_patch_metrics", f"select patch_id, {', '.join(_PMC)}, {RS(*_PM)} from pmetrics")
def _(ws):
    return ev.patch_metrics(ws["patch_bins"], ws["patch_cells"]).select("patch_id", *_PMC, *rs(*_PM))


@query("s11_patch_manifest", f"""
select m.patch_id, {R('m.foreground_iou')} as foreground_iou, m.display_bins as n_bins, m.core_cells as n_cells, (select count(*) from pmem x where x.patch_id = m.patch_id and x.role = 'margin') as n_margin_cells from pmetrics m""")
def _(ws):
    from ..sources.patch_documents import documents, manifest
    docs = documents(ws["patches"], ws["patch_members"], ws["patch_bins"], ws["patch_cells"], ev.patch_metrics(ws["patch_bins"], ws["patch_cells"]))
    return manifest(docs).select("patch_id", *rs("foreground_iou"), "n_bins", "n_cells", "n_margin_cells")


@query("l5_patch_list", f"select patch_id, {RS('macro_cell_iou')} from pmetrics where patch_id like '%0%' order by macro_cell_iou asc nulls last, patch_id limit 20")
def _(ws):
    m = ev.patch_metrics(ws["patch_bins"], ws["patch_cells"]).filter(F.col("patch_id").contains("0"))
    return m.orderBy(F.asc_nulls_last("macro_cell_iou"), "patch_id").limit(20).select("patch_id", *rs("macro_cell_iou"))


@query("l5_patch_list_by_id", "select patch_id, core_cells from pmetrics order by patch_id limit 20")
def _(ws):
    return ev.patch_metrics(ws["patch_bins"], ws["patch_cells"]).orderBy("patch_id").limit(20).select("patch_id", "core_cells")


@query("l5_worst_first_cells", f"select patch_id, cell_id, {RS('patch_iou')} from pcells order by patch_iou asc nulls last, patch_id, cell_id limit 50")
def _(ws):
    return ws["patch_cells"].orderBy(F.asc_nulls_last("patch_iou"), "patch_id", "cell_id").limit(50).select("patch_id", "cell_id", *rs("patch_iou"))
