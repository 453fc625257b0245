"""Queries: reference profiles, likelihoods, roll-ups and gene tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import attach_scalars
from ..functions.stats import zscore_small_group
from ..operators import expression as ex
from . import steps
from .registry import R, RS, big, bigs, cte, query, r, rs


@query("a6_reference_counts", "select cell_type, gene, count from dense_reference")
def _(ws):
    return ex.dense_counts(ws["reference_counts"], ws["selected_genes"], steps.types_of(ws))


@query("a6_type_sizes", "select cell_type, n_cells, type_index from types")
def _(ws):
    sizes = ws["typed_cells"].select("cell_type", "n_cells").distinct()
    order = F.create_map(*[v for i, t in enumerate(steps.types_of(ws)) for v in (F.lit(t), F.lit(i).cast("bigint"))])
    return sizes.select("cell_type", "n_cells", order[F.col("cell_type")].alias("type_index"))


@query("a7_reference_distribution", f"select cell_type, gene, {RS('log_theta')}, {R('theta', 8)} as theta from theta")
def _(ws):
    return ex.theta_long(ws["theta"], steps.types_of(ws)).select(
        "cell_type", "gene", *rs("log_theta"), r(F.exp("log_theta"), 8).alias("theta"))


@query("a8_bin_log_likelihood", f"select barcode, cell_type, {RS('ll')} from ll")
def _(ws):
    names = F.array(*[F.lit(t) for t in steps.types_of(ws)]).alias("cell_type")
    z = ws["bin_ll"].select("barcode", F.explode(F.arrays_zip(names, F.col("ll").alias("ll"))).alias("z"))
    return z.select("barcode", F.col("z.cell_type").alias("cell_type"), r("z.ll").alias("ll"))


@query("a9_bin_confidence", f"select barcode, bin_total, {RS('expr_conf')} from bin_conf")
def _(ws):
    return ws["bin_ll"].select("barcode", "bin_total", *rs("expr_conf"))


@query("a10_cell_rollup", """
select p.cell_id, e.gene, cast(sum(e.cnt) as bigint) as cnt from (select distinct cell_id, barcode from pred_assignments) p join expression e using (barcode)
where e.gene in (select gene from selected_genes) group by 1, 2""")
def _(ws):
    return ex.rollup(ws["pred_assignments"], ws["expression"], ws["selected_genes"])


@query("a10_mean_pseudobulk", f"""
with m as (select cell_id, barcode, is_seed from ctx), s as (select cell_id, count(*) filter (is_seed) as ns, count(*) as n from m group by 1)
select m.cell_id, e.gene, {R('sum(e.cnt)/max(case when ns > 0 then ns else n end)')} as mean_count from m join s using (cell_id) join expression e using (barcode)
where (is_seed or ns = 0) and e.gene in (select gene from selected_genes) group by 1, 2""")
def _(ws):
    expr = ws["expression"].join(ws["selected_genes"].select("gene"), "gene", "left_semi")
    return ex.mean_rollup(ws["context"].select("cell_id", "barcode", "is_seed"), expr, "is_seed").select("cell_id", "gene", *rs("mean_count"))


cte("nuclear_sums", """
select dominant_cell_id as cell_id, cast(sum(bin_total) as bigint) as nuclear_sum from bin_metadata join bin_totals using (barcode)
where has_nuclear_annotation and not ambiguous_nuclear_assignment group by 1""")
_THRESHOLD = 2500.0


@query("a11_nuclear_expression_filter", f"select cell_id from nuclei where cell_id in (select cell_id from nuclear_sums where nuclear_sum > {_THRESHOLD})")
def _(ws):
    return ex.nuclear_expression_filter(ws["bin_metadata"], ws["bin_ll"], ws["nuclei"], _THRESHOLD)[0].select("cell_id")


@query("a11_nuclear_filter_counters", f"""
select (select count(*) from nuclei) as n_input_nuclei, (select count(*) from nuclei where cell_id in (select cell_id from nuclear_sums where nuclear_sum > {_THRESHOLD})) as n_kept_nuclei,
 (select count(*) from nuclei where cell_id not in (select cell_id from nuclear_sums where nuclear_sum > {_THRESHOLD})) as n_filtered_nuclei,
 (select count(*) from nuclear_sums) as n_cells_with_confident_bins, (select count(*) from nuclear_sums where nuclear_sum > {_THRESHOLD}) as n_cells_with_expression, {_THRESHOLD}e0 as threshold""")
def _(ws):
    return ex.nuclear_expression_filter(ws["bin_metadata"], ws["bin_ll"], ws["nuclei"], _THRESHOLD)[1]


@query("a30_qc_filter", """
select barcode, gene, cnt from expression where gene in (select gene from expression where cnt > 0 group by 1 having count(*) >= 880) and barcode in (select barcode from expression group by 1 having sum(cnt) >= 700)""")
def _(ws):
    return ex.qc_filter(ws["expression"], 880, 700)


@query("a31_top_variance_genes", f"""
select gene, {R('greatest(q/n - (s/n)*(s/n), 0.0e0)')} as variance from (select gene, sum(cast(cnt as double)) as s, sum(cast(cnt as double)*cnt) as q from expression group by 1) a,
 (select count(*) as n from tissue_positions) b order by greatest(q/n - (s/n)*(s/n), 0.0e0) desc, gene limit 20""")
def _(ws):
    n = ws["tissue_positions"].agg(F.count("*").alias("n"))
    return ex.top_variance_genes(ws["expression"], n, 20).select("gene", *rs("variance"))


@query("a32_normalize_log1p", f"""
select barcode, gene, {R('ln(1.0e0 + cnt*(10000.0e0/t))')} as value from expression join (select barcode, sum(cnt) as t from expression group by 1) q using (barcode)""")
def _(ws):
    return ex.normalize_log1p(ws["expression"], 10000.0).select("barcode", "gene", *rs("value"))


@query("j14_gene_alignment", """
select r.gene, f.i as matrix_feature_index from (select distinct gene from sc_expression union select 'G99') r left join (select gene, min(matrix_feature_index) as i from selected_genes group by 1) f using (gene)""")
def _(ws):
    extra = ws["sc_expression"].select("gene").distinct().union(ws["sc_expression"].select(F.lit("G99").alias("gene")).distinct())
    return ex.align_genes(extra, ws["selected_genes"])


@query("j15_common_genes", "select gene, matrix_feature_index as spatial_index from genes where gene in (select gene from sc_expression)")
def _(ws):
    return ex.common_genes(ws["genes"], ws["sc_expression"])


@query("l3_top_genes_per_bin", """
select barcode, gene, cnt, rank, bin_sum, bin_max, n_genes from (select barcode, gene, cnt, cast(row_number() over (partition by barcode order by cnt desc, gene) as int) as rank,
 cast(sum(cnt) over (partition by barcode) as bigint) as bin_sum, max(cnt) over (partition by barcode) as bin_max, count(*) filter (cnt > 0) over (partition by barcode) as n_genes from expression) q where rank <= 5""")
def _(ws):
    return ex.top_genes_per_bin(ws["expression"], 5)


@query("u3_unassigned_bins", "select barcode from bin_metadata where barcode not in (select barcode from pred_assignments)")
def _(ws):
    return ws["bin_metadata"].select("barcode").join(ws["pred_assignments"].select("barcode"), "barcode", "left_anti")


@query("u3_missing_genes", "select distinct gene from expression where gene not in (select gene from selected_genes)")
def _(ws):
    return ws["expression"].select("gene").distinct().join(ws["selected_genes"], "gene", "left_anti")
