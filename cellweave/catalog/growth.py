"""Queries: tiles, competition to completion, fill targets, joint rounds, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.scalars import attach_scalars
from ..operators import claims, evaluate as ev, expression as ex, growth as gr, patches as pt, scoring as sc
from ..operators.components import pca_scores
from ..session import stage_root
from ..sources import matrix, models, tables
from ..streaming import ingest as stream
from ..workspace import step
from . import steps
from .registry import R, RS, big, bigs, cte, query, r, rs

_BOX = ("outer_x_min", "outer_x_max", "outer_y_min", "outer_y_max")


@query("j16_tile_patches", f"select patch_id, source, {RS('cx', 'cy')} from pbox")
def _(ws):
    return ws["patches"].select("patch_id", "source", *rs("cx", "cy"))


@query("j16_tile_membership", f"select patch_id, cell_id, role, {RS('dist2')} from pmem")
def _(ws):
    return ws["patch_members"].select("patch_id", "cell_id", "role", *rs("dist2"))


cte("capped", """
select ix, iy, cell_id, role from (select *, row_number() over (partition by ix, iy order by case when role = 'core' then 0 else 1 end, dist2, cell_id) as rn from tile_members) q where rn <= 12""")


@query("l4_patch_cap", "select ix, iy, cell_id, role from capped")
def _(ws):
    m = pt.tile_members(ws["nuclei"], 64.0, 32.0, 48.0)
    return pt.cap_members(m, ["ix", "iy"], 12).select("ix", "iy", "cell_id", "role")


@query("j16_jittered_tiles", """
with o as (select 1 as pass, 5.5e0 as ox, -7.25e0 as oy), t as (select pass, ix, iy, cx + ox as cx, cy + oy as cy from tiles, o)
select pass, ix, iy, cell_id, case when abs(center_x_um - cx) <= 24.0e0 and abs(center_y_um - cy) <= 24.0e0 then 'core' else 'margin' end as role
from t, nuclei where abs(center_x_um - cx) <= 32.0e0 and abs(center_y_um - cy) <= 32.0e0""")
def _(ws):
    m = pt.tile_members(ws["nuclei"], 64.0, 32.0, 48.0, offsets=((0.0, 0.0), (5.5, -7.25)))
    return m.filter("pass = 1").select("pass", "ix", "iy", "cell_id", "role")


@query("u4_patches_meeting_targets", "select distinct patch_id from pmem where role = 'core' and cell_id % 12 = 5")
def _(ws):
    return pt.patches_meeting(ws["patch_members"].filter("role = 'core'"), ws["nuclei"].filter("cell_id % 12 = 5"))


cte("patch_scores", "select patch_id, sum(objective)/count(*) as score from pmem join objective using (cell_id) where role = 'core' group by 1")


@query("w12_best_patch_per_cell", f"""
select cell_id, patch_id, {R('score')} as score from (select m.cell_id, m.patch_id, s.score, row_number() over (partition by m.cell_id order by s.score desc, m.patch_id) as rn from pmem m join patch_scores s using (patch_id) where m.role = 'core') q where rn = 1""")
def _(ws):
    core = ws["patch_members"].filter("role = 'core'")
    obj = sc.cell_objective(ws["cells"], ["cell_id"], steps.WEIGHTS)
    scores = sc.patch_objective(obj, core, "mean_core_cells").withColumnRenamed("patch_score", "score")
    return pt.best_patch_per_cell(core.select("cell_id", "patch_id"), scores).select("cell_id", "patch_id", *rs("score"))


@step("grown", stored=True)
def _grown(ws):
    """Tile patches grown to completion; core cells come first in patch order."""
    core_first = Window.partitionBy("patch_id").orderBy(F.col("role") != "core", "cell_id")
    ranked = ws["patch_members"].withColumn("cell_rank", F.row_number().over(core_first))
    return gr.grow_members(ranked, ws["context"], steps.WEIGHTS)


@query("g16_growth_summary")
def _(ws):
    return ws["grown"].filter("kind = 'summary'").select("patch_id", "step_index", "stop_reason", "n_cells", "n_conflicts", "n_contested", "n_blocked")


@query("g16_growth_steps")
def _(ws):
    return ws["grown"].filter("kind = 'step'").select("patch_id", "step_index", "cell_id", "barcode", *rs("add_score", digits=4))


cte("growth_input", "select m.patch_id, s.cell_id, s.barcode, s.is_seed from pmem m join st s using (cell_id) where m.cell_id in (select cell_id from st where is_seed)")


@query("g16_growth_starting_point", """
select patch_id, count(*) filter (is_seed) as n_seed_bins, count(distinct cell_id) as n_cells, count(distinct barcode) as n_barcodes from growth_input group by 1""")
def _(ws):
    return gr.starting_point(ws["patch_members"], ws["context"])


@query("g22_assignment_rows")
def _(ws):
    owners = gr.final_owners(ws["grown"])
    return gr.assignment_rows(owners, ws["patch_members"], ws["context"], "patch_growth").select(
        "patch_id", "cell_id", "barcode", "array_row", "array_col", *rs("x_um", "y_um"), "is_nuclear", "assignment_source")


@query("g22_seed_assignment_rows", f"""
select m.patch_id, s.cell_id, s.barcode, s.array_row, s.array_col, {RS('x_um', 'y_um')}, true as is_nuclear, 'seed' as assignment_source from pmem m join st s using (cell_id) where m.role = 'core' and s.is_seed""")
def _(ws):
    seeds = gr.final_owners(ws["grown"]).filter("step_index = -1")
    return gr.assignment_rows(seeds, ws["patch_members"], ws["context"], "seed").select(
        "patch_id", "cell_id", "barcode", "array_row", "array_col", *rs("x_um", "y_um"), "is_nuclear", "assignment_source")


cte("inbox", """
select m.patch_id, s.cell_id, s.barcode, s.array_row, s.array_col, s.is_seed, s.bin_total from pmem m join pbox b using (patch_id) join st s using (cell_id)
where abs(s.x_um - b.cx) <= 32.0e0 and abs(s.y_um - b.cy) <= 32.0e0""")


@query("g20_fill_target", """
with recursive w as (select patch_id, cell_id, barcode, array_row, array_col from inbox where is_seed
 union select i.patch_id, i.cell_id, i.barcode, i.array_row, i.array_col from w join inbox i on i.patch_id = w.patch_id and i.cell_id = w.cell_id and abs(i.array_row - w.array_row) <= 1 and abs(i.array_col - w.array_col) <= 1)
select distinct w.patch_id, w.barcode from w join inbox i using (patch_id, cell_id, barcode) where i.bin_total > 0""")
def _(ws):
    return fill_target(ws)


def fill_target(ws):
    placed = ws["patch_members"].select("patch_id", "cell_id").join(ws["patches"].select("patch_id", *_BOX), "patch_id").join(
        ws["context"].select("cell_id", "barcode", "array_row", "array_col", "x_um", "y_um", "is_seed", "bin_total"), "cell_id")
    box = F.col("x_um").between(F.col(_BOX[0]), F.col(_BOX[1])) & F.col("y_um").between(F.col(_BOX[2]), F.col(_BOX[3]))
    return gr.fill_target(placed, box)


@query("g18_patch_objective_bins", f"""
with recursive w as (select patch_id, cell_id, barcode, array_row, array_col from inbox where is_seed
 union select i.patch_id, i.cell_id, i.barcode, i.array_row, i.array_col from w join inbox i on i.patch_id = w.patch_id and i.cell_id = w.cell_id and abs(i.array_row - w.array_row) <= 1 and abs(i.array_col - w.array_col) <= 1),
f as (select w.patch_id, count(distinct w.barcode) as n from w join inbox i using (patch_id, cell_id, barcode) where i.bin_total > 0 group by 1),
t as (select patch_id, sum(objective) as total from pmem join objective using (cell_id) where role = 'core' group by 1)
select patch_id, {R('total/greatest(coalesce(f.n, 0), 1)')} as mean_score, {R('total/sqrt(greatest(coalesce(f.n, 0), 1))')} as sqrt_score from t left join f using (patch_id)""")
def _(ws):
    objectives = sc.cell_objective(ws["cells"], ["cell_id"], steps.WEIGHTS)
    core = ws["patch_members"].filter("role = 'core'")
    n_fill = fill_target(ws).groupBy("patch_id").agg(F.count("*").alias("n_fill"))
    score = lambda mode, name: sc.patch_objective(objectives, core, mode, n_fill).select("patch_id", r("patch_score").alias(name))
    return score("mean_expression_bins", "mean_score").join(score("sqrt_expression_bins", "sqrt_score"), "patch_id")


@query("g20_fill_progress", """
with recursive w as (select patch_id, cell_id, barcode, array_row, array_col from inbox where is_seed
 union select i.patch_id, i.cell_id, i.barcode, i.array_row, i.array_col from w join inbox i on i.patch_id = w.patch_id and i.cell_id = w.cell_id and abs(i.array_row - w.array_row) <= 1 and abs(i.array_col - w.array_col) <= 1),
t as (select distinct w.patch_id, w.barcode from w join inbox i using (patch_id, cell_id, barcode) where i.bin_total > 0)
select t.patch_id, count(*) as n_fill, count(o.barcode) as n_owned from t left join (select distinct m.patch_id, s.barcode from pmem m join st s using (cell_id) where s.is_seed) o on o.patch_id = t.patch_id and o.barcode = t.barcode group by 1""")
def _(ws):
    owned = ws["patch_members"].select("patch_id", "cell_id").join(ws["context"].filter("is_seed").select("cell_id", "barcode"), "cell_id")
    return gr.fill_progress(fill_target(ws), owned)


cte("props", """
select s.patch_id, s.cell_id, s.barcode, s.add_score as delta, rn - 1 as round, m.cell_rank from (select *, row_number() over (partition by patch_id, cell_id order by round(add_score, 6) desc, matrix_col_index) as rn from psco where is_legal) s
join (select patch_id, cell_id, row_number() over (partition by patch_id order by cell_id) - 1 as cell_rank from pmem) m on m.patch_id = s.patch_id and m.cell_id = s.cell_id""")
cte("props_kept", """
select * from (select p.*, row_number() over (partition by p.patch_id, round, barcode order by (cell_rank - round + n) % n, p.cell_id) as k from props p join (select patch_id, count(*) as n from pmem group by 1) c on c.patch_id = p.patch_id) q where k = 1""")


def joint(ws):
    # a patch holds at most its cell cap, so the windows over a patch stay small; ranks and sizes came with the members
    w = Window.partitionBy("patch_id", "cell_id").orderBy(F.desc(F.round("add_score", 6)), "matrix_col_index")
    props = ws["patch_legal"].withColumn("round", F.row_number().over(w) - 1).select(
        "patch_id", "cell_id", "barcode", F.col("add_score").alias("delta"), "round", "cell_rank", "n_cells")
    return gr.joint_rounds(props, eps=0.0)


@query("g23_joint_kept_proposals", f"select patch_id, cast(round as bigint) as round, barcode, cell_id, {R('delta', 4)} as delta from props_kept")
def _(ws):
    return joint(ws)[0].select("patch_id", F.col("round").cast("bigint").alias("round"), "barcode", "cell_id", *rs("delta", digits=4))


@query("g23_joint_rounds", f"select patch_id, cast(round as bigint) as round, {R('sum(delta)', 4)} as gain, count(*) as n_actions, sum(delta) > 0 as accepted from props_kept group by 1, 2")
def _(ws):
    return joint(ws)[1].select("patch_id", F.col("round").cast("bigint").alias("round"), *rs("gain", digits=4), "n_actions", "accepted")


# ---- transcriptomic distance ----

cte("nl", "select barcode, gene, ln(1.0e0 + cnt*(10000.0e0/t)) as v from expression join (select barcode, sum(cnt) as t from expression group by 1) q using (barcode)")
cte("pb", """
with m as (select cell_id, barcode, is_seed from ctx), s as (select cell_id, count(*) filter (is_seed) as ns, count(*) as n from m group by 1),
b as (select m.cell_id, e.gene, sum(e.cnt)/max(case when ns > 0 then ns else n end) as mc from m join s using (cell_id) join expression e using (barcode) where is_seed or ns = 0 group by 1, 2)
select cell_id, gene, ln(1.0e0 + mc*(10000.0e0/t)) as v from b join (select cell_id, sum(mc) as t from b group by 1) q using (cell_id)""")
cte("tdist", """
select c.cell_id, c.barcode, sum((coalesce(n.v, 0.0e0) - coalesce(p.v, 0.0e0))*(coalesce(n.v, 0.0e0) - coalesce(p.v, 0.0e0))) as t from candidates c cross join (select distinct gene from expression) g
left join nl n on n.barcode = c.barcode and n.gene = g.gene left join pb p on p.cell_id = c.cell_id and p.gene = g.gene group by 1, 2""")
cte("sdist", """
select c.cell_id, c.barcode, coalesce(min(sqrt((c.x_um - s.x_um)*(c.x_um - s.x_um) + (c.y_um - s.y_um)*(c.y_um - s.y_um))), any_value(c.dist_um))/2.0e0 as d from ctx c left join ctx s on s.cell_id = c.cell_id and s.is_seed group by 1, 2""")


@query("a34_transcriptomic_distance_score", f"""
with l as (select m.patch_id, t.cell_id, t.barcode, ln(greatest(t.t, 1.0e-8)) as lt, s.d from tdist t join sdist s using (cell_id, barcode) join pmem m using (cell_id)),
z as (select patch_id, min(lt) as lo, max(lt) as hi from l group by 1)
select patch_id, cell_id, barcode, {R('-((lt - lo)/greatest(hi - lo, 1.0e-8) + 0.1e0*d)', 5)} as score from l join z using (patch_id)""")
def _(ws):
    return ex.transcriptomic_scores(ws["context"], ws["expression"], ws["patch_members"], 10000.0, 0.1, 2.0).select("patch_id", "cell_id", "barcode", *rs("score", digits=5))


@query("a34_component_distance_score", f"""
with pl as (select m.patch_id, c.cell_id, c.barcode, c.is_seed from pmem m join ctx c using (cell_id)), sz as (select patch_id, count(*) as n from pl group by 1),
sq as (select patch_id, gene, cast(sum(cnt) as double) as s, cast(sum(cnt*cnt) as double) as q from pl join expression using (barcode) group by 1, 2),
tg as (select patch_id, gene from (select patch_id, gene, row_number() over (partition by patch_id order by greatest(q/n - (s/n)*(s/n), 0.0e0) desc, gene) as rn from sq join sz using (patch_id)) z where rn <= 20),
ub as (select distinct patch_id, barcode from pl), be as (select u.patch_id, u.barcode, e.gene, cast(e.cnt as double) as c from ub u join expression e using (barcode) join tg on tg.patch_id = u.patch_id and tg.gene = e.gene),
bv as (select patch_id, barcode, gene, ln(1.0e0 + c*(10000.0e0/sum(c) over (partition by patch_id, barcode))) as v from be),
cs as (select patch_id, cell_id, count(*) filter (is_seed) as ns, count(*) as n from pl group by 1, 2),
cm as (select p.patch_id, p.cell_id, b.gene, sum(b.c)/max(case when ns > 0 then ns else n end) as c from pl p join cs using (patch_id, cell_id) join be b on b.patch_id = p.patch_id and b.barcode = p.barcode where is_seed or ns = 0 group by 1, 2, 3),
cv as (select patch_id, cell_id, gene, ln(1.0e0 + c*(10000.0e0/sum(c) over (partition by patch_id, cell_id))) as v from cm),
d as (select p.patch_id, p.cell_id, p.barcode, sum((coalesce(b.v, 0.0e0) - coalesce(c.v, 0.0e0))*(coalesce(b.v, 0.0e0) - coalesce(c.v, 0.0e0))) as t from pl p join tg g using (patch_id)
 left join bv b on b.patch_id = p.patch_id and b.barcode = p.barcode and b.gene = g.gene left join cv c on c.patch_id = p.patch_id and c.cell_id = p.cell_id and c.gene = g.gene group by 1, 2, 3),
l as (select d.patch_id, d.cell_id, d.barcode, ln(greatest(d.t, 1.0e-8)) as lt, s.d from d join sdist s using (cell_id, barcode)), z as (select patch_id, min(lt) as lo, max(lt) as hi from l group by 1)
select patch_id, cell_id, barcode, {R('-((lt - lo)/greatest(hi - lo, 1.0e-8) + 0.1e0*d)', 5)} as score from l join z using (patch_id)""")
def _(ws):
    # 20 genes have at most 20 components, so that the 50 leading ones are all of them
    out = ex.component_scores(ws["context"], ws["expression"], ws["patch_members"], 20, 50, 10000.0, 0.1, 2.0)
    return out.select("patch_id", "cell_id", "barcode", *rs("score", digits=5))


cte("top_genes", """
select gene from (select gene, greatest(q/n - (s/n)*(s/n), 0.0e0) as v from (select gene, sum(cast(cnt as double)) as s, sum(cast(cnt as double)*cnt) as q from expression group by 1) a, (select count(*) as n from tissue_positions) b) z order by v desc, gene limit 20""")


@query("a33_pca_scores", f"""
with v as (select * from nl where gene in (select gene from top_genes)), n as (select count(distinct barcode) as n from v)
select any_value(n) as n_rows, {R('sum(q - n*(s/n)*(s/n))', 3)} as total_energy from (select gene, sum(v) as s, sum(v*v) as q from v group by 1) a, n""")
def _(ws):
    # signs and order are arbitrary; with every component kept the total energy is the centred sum of squares
    values = ex.normalize_log1p(ws["expression"], 10000.0)
    top = ex.top_variance_genes(ws["expression"], ws["tissue_positions"].agg(F.count("*").alias("n")), 20)
    scores, explained = pca_scores(values, top, 20)
    energy = F.aggregate("pc", F.lit(0.0), lambda s, v: s + v * v)
    return scores.agg(F.count("*").alias("n_rows"), r(F.sum(energy), 3).alias("total_energy"))


@query("a33_first_component", f"""
with top as (select gene from (select gene, greatest(q/n - (s/n)*(s/n), 0.0e0) as v from (select gene, sum(cast(cnt as double)) as s, sum(cast(cnt as double)*cnt) as q from expression group by 1) a, (select count(*) as n from tissue_positions) b) z order by v desc, gene limit 2),
v as (select nl.barcode, nl.v, gene = (select min(gene) from top) as is_first from nl where gene in (select gene from top)),
b as (select barcode, coalesce(sum(v) filter (is_first), 0.0e0) as x, coalesce(sum(v) filter (not is_first), 0.0e0) as y from v group by 1),
m as (select count(*) as n, var_pop(x) as xx, var_pop(y) as yy, covar_pop(x, y) as xy from b)
select n as n_rows, {R('n*(xx + yy + sqrt((xx - yy)*(xx - yy) + 4.0e0*xy*xy))/2.0e0', 3)} as first_energy from m""")
def _(ws):
    # of two genes, the leading component's variance is known in closed form
    values = ex.normalize_log1p(ws["expression"], 10000.0)
    top = ex.top_variance_genes(ws["expression"], ws["tissue_positions"].agg(F.count("*").alias("n")), 2)
    scores, _ = pca_scores(values, top, 1)
    return scores.agg(F.count("*").alias("n_rows"), r(F.sum(F.col("pc")[0] * F.col("pc")[0]), 3).alias("first_energy"))


@query("a33_leading_components", f"""
with top as (select gene, row_number() over (order by gene) as i from (select gene from (select gene, greatest(q/n - (s/n)*(s/n), 0.0e0) as v from (select gene, sum(cast(cnt as double)) as s, sum(cast(cnt as double)*cnt) as q from expression group by 1) a, (select count(*) as n from tissue_positions) b) z order by v desc, gene limit 3) y),
b as (select barcode, coalesce(sum(v) filter (i = 1), 0.0e0) as x, coalesce(sum(v) filter (i = 2), 0.0e0) as y, coalesce(sum(v) filter (i = 3), 0.0e0) as z from nl join top using (gene) group by 1),
m as (select count(*) as n, var_pop(x) as a, var_pop(y) as d, var_pop(z) as f, covar_pop(x, y) as b, covar_pop(x, z) as c, covar_pop(y, z) as e from b),
q as (select *, (a + d + f)/3.0e0 as q from m),
p as (select *, sqrt(((a - q)*(a - q) + (d - q)*(d - q) + (f - q)*(f - q) + 2.0e0*(b*b + c*c + e*e))/6.0e0) as p from q),
t as (select *, acos(greatest(-1.0e0, least(1.0e0, ((a - q)*((d - q)*(f - q) - e*e) - b*(b*(f - q) - e*c) + c*(b*e - (d - q)*c))/(2.0e0*p*p*p))))/3.0e0 as phi from p),
w as (select n, q + 2.0e0*p*cos(phi) as first, q + 2.0e0*p*cos(phi + 4.0e0*acos(0.0e0)/3.0e0) as third, q from t)
select n as n_rows, {R('210.0e0*n*first', 3)} as first_energy, {R('210.0e0*n*(3.0e0*q - first - third)', 3)} as second_energy, true as orthogonal from w""")
def _(ws):
    # three genes, each at the weights 2, 5, 9 and 10 (squares: 210), make 12; their leading two components are known in closed form
    top = ex.top_variance_genes(ws["expression"], ws["tissue_positions"].agg(F.count("*").alias("n")), 3)
    copies = F.explode(F.array(*[F.lit(w) for w in (2.0, 5.0, 9.0, 10.0)])).alias("w")
    named = F.concat("gene", F.lit("*"), F.col("w").cast("int").cast("string"))
    values = ex.normalize_log1p(ws["expression"], 10000.0).join(top.select("gene"), "gene").select("barcode", "gene", "value", copies)
    scores, _ = pca_scores(values.select("barcode", named.alias("gene"), (F.col("value") * F.col("w")).alias("value")), top.select("gene", copies).select(named.alias("gene")), 2)
    a, b = F.col("pc")[0], F.col("pc")[1]
    cross = F.abs(F.sum(a * b)) <= F.lit(1e-6) * F.sum(a * a)
    return scores.agg(F.count("*").alias("n_rows"), r(F.sum(a * a), 3).alias("first_energy"), r(F.sum(b * b), 3).alias("second_energy"), cross.alias("orthogonal"))


@query("a34_leading_component_score")
def _(ws):
    """The reference's own limits, 5,000 genes and 50 components, over every patch."""
    return ex.component_scores(ws["context"], ws["expression"], ws["patch_members"], 5000, 50, 10000.0, 0.5, 2.0).select("patch_id", "cell_id", "barcode", *rs("score", digits=5))


@query("f1_custom_score_growth")
def _(ws):
    """Growth with another score function: nearest bins first, up to half the disc."""
    def nearest_first(cell, legal, step):
        return 0.5 - cell.base

    core_first = Window.partitionBy("patch_id").orderBy(F.col("role") != "core", "cell_id")
    ranked = ws["patch_members"].withColumn("cell_rank", F.row_number().over(core_first))
    grown = gr.grow_members(ranked, ws["context"], steps.WEIGHTS, score=nearest_first)
    return grown.filter("kind = 'summary'").select("patch_id", "step_index", "stop_reason", "n_cells")


@query("f2_transition_rewards", f"""
select l.episode_id, l.step_index, case when l.action = 'add' then {R('coalesce(s.add_score, 0.0e0)', 4)} when l.action = 'stop' then {R('coalesce(-0.7e0*t.stop_delta, 0.0e0)', 4)} when l.action = 'replace' then -0.25e0 else 0.0e0 end as step_reward
from step_log l left join sco s on s.cell_id = l.cell_id and s.barcode = l.barcode left join topk t on t.cell_id = l.cell_id""")
def _(ws):
    from ..operators.logs import with_rewards
    scored = ws["scores"].select("cell_id", "barcode", "add_score")
    stop = sc.stop_scores(ws["scores"], ["cell_id"], "is_frontier", steps.WEIGHTS).select("cell_id", "stop_score")
    # every transition meets only the table that its action asks for
    log = ws["step_log"].select("episode_id", "step_index", "action", "cell_id", "barcode")
    asks = lambda action: log.filter(F.col("action") == action)
    rest = log.filter(F.col("action").isNull() | ~F.col("action").isin("add", "stop"))
    joined = asks("add").join(scored, ["cell_id", "barcode"], "left").unionByName(asks("stop").join(stop, "cell_id", "left"), True).unionByName(rest, True)

    def reward(log):
        z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        return F.when(F.col("action") == "add", z("add_score")).when(F.col("action") == "stop", z("stop_score")).when(F.col("action") == "replace", -0.25).otherwise(0.0)

    return with_rewards(joined, reward, "step_reward").select("episode_id", "step_index", *rs("step_reward", digits=4))


# ---- assignment tables ----

cte("two_source", """
select cell_id, barcode, array_row, array_col, is_nuclear, case when is_nuclear = 1 then 'seed' when (array_row + array_col) % 2 = 0 then 'expanded' else 'secondary' end as source from pred_assignments""")


@query("a20_assignment_summary", f"""
with m as (select cell_id, source, row_number() over (partition by cell_id order by count(*) desc, source) as rn from two_source group by 1, 2)
select t.cell_id, count(*) as total_bins, cast(sum(is_nuclear) as bigint) as nuclear_bins, count(*) - cast(sum(is_nuclear) as bigint) as cytoplasm_bins, {R('avg(array_row)')} as centroid_row, {R('avg(array_col)')} as centroid_col,
 {R('sum(is_nuclear)/count(*)')} as nuclear_ratio, {R('sum(is_nuclear)/count(*)*100.0e0')} as nuclear_percentage, any_value(m.source) as main_source from two_source t join m on m.cell_id = t.cell_id and m.rn = 1 group by 1""")
def _(ws):
    src = F.expr("case when is_nuclear = 1 then 'seed' when (array_row + array_col) % 2 = 0 then 'expanded' else 'secondary' end")
    s = claims.assignment_summary(ws["pred_assignments"].withColumn("source", src))
    return s.select("cell_id", "total_bins", "nuclear_bins", "cytoplasm_bins", *rs("centroid_row", "centroid_col", "nuclear_ratio", "nuclear_percentage"), "main_source")


def shares(ws):
    """Cell shares of a bin: claim pixel counts over the bin's total."""
    totals = ws["pixel_counts"].groupBy("barcode").agg(F.sum("total_compartment_pixels").alias("t"))
    return ws["pixel_counts"].join(totals, "barcode").select("barcode", "cell_id", (F.col("total_compartment_pixels") / F.col("t") * 1.00001).alias("share"))


cte("shares", "select barcode, cell_id, total_compartment_pixels/sum(total_compartment_pixels) over (partition by barcode)*1.00001e0 as share from pixel_counts")


@query("a21_spot_composition", f"select barcode, cell_id, {R('share/sum(share) over (partition by barcode)')} as share, abs(sum(share) over (partition by barcode) - 1.0e0) <= 1.0e-4 as sum_ok from shares")
def _(ws):
    return claims.spot_composition(shares(ws)).select("barcode", "cell_id", *rs("share"), "sum_ok")


@query("a21_dominant_cell", f"""
with c as (select barcode, cell_id, round(share/sum(share) over (partition by barcode), 9) as share from shares)
select barcode, cell_id, {R('share')} as dominant_probability from (select *, row_number() over (partition by barcode order by share desc, cell_id desc) as rn from c) q where rn = 1""")
def _(ws):
    c = claims.spot_composition(shares(ws)).withColumn("share", F.round("share", 9))
    return claims.dominant_by_share(c).select("barcode", "cell_id", *rs("dominant_probability"))


cte("conf_cells", "select cell_id, nuclear_pixel_count/180.0e0 as confidence from nuclei")


@query("a29_confidence_filter", f"select cell_id, {R('confidence')} as confidence, row_number() over (order by cell_id) as new_id from conf_cells where confidence >= 0.6")
def _(ws):
    cells = ws["nuclei"].select("cell_id", (F.col("nuclear_pixel_count") / 180.0).alias("confidence"))
    return claims.filter_and_relabel(cells, "confidence", 0.6).select("cell_id", *rs("confidence"), "new_id")


@query("a29_confidence_stats", f"""
select count(*) as n_cells, {R('avg(confidence)')} as mean, {R('quantile_cont(confidence, 0.5)')} as median, {R('min(confidence)')} as min, {R('max(confidence)')} as max, count(*) filter (confidence >= 0.8) as n_ge_08, count(*) filter (confidence >= 0.9) as n_ge_09 from conf_cells""")
def _(ws):
    from ..functions.ordered import exact_quantiles
    cells = ws["nuclei"].select("cell_id", (F.col("nuclear_pixel_count") / 180.0).alias("confidence"))
    return claims.confidence_stats(cells, "confidence", exact_quantiles(cells, [], "confidence", {"median": 0.5})).select("n_cells", *rs("mean", "median", "min", "max"), "n_ge_08", "n_ge_09")


@query("w1_keep_first_and_last", """
select barcode, arg_min(cell_id, (weight_rank)) as first_cell, arg_max(cell_id, weight_rank) as last_cell from (select barcode, cell_id, row_number() over (order by nuclear_pixel_count desc, barcode, cell_id) as weight_rank from nuclear_claims) q group by 1""")
def _(ws):
    order = F.struct((-F.col("nuclear_pixel_count")).alias("n"), "barcode", "cell_id")
    return ws["nuclear_claims"].groupBy("barcode").agg(F.min_by("cell_id", order).alias("first_cell"), F.max_by("cell_id", order).alias("last_cell"))


@query("l1_stable_order", "select cell_id, barcode, array_row, array_col from pred_assignments")
def _(ws):
    return ws["pred_assignments"].select("cell_id", "barcode", "array_row", "array_col").orderBy("cell_id", "barcode")


# ---- sources and sinks ----

def scratch(ws, name: str) -> str:
    import uuid
    return f"{stage_root(ws.spark)}/{ws.spark.sparkContext.applicationId}/io-{name}-{uuid.uuid4().hex}"


@query("s2_matrix_directory", "select barcode, gene, cnt from expression where barcode in (select barcode from tissue_positions)")
def _(ws):
    folder = scratch(ws, "mtx")
    matrix.write_matrix(ws["expression"], ws["barcodes"], ws["genes"], folder)
    return matrix.read_matrix(ws.spark, folder)


@query("s5_table_sink_roundtrip", f"select cell_id, {RS('center_x_um', 'center_y_um', 'radius_um')}, nuclear_pixel_count from nuclei")
def _(ws):
    path = scratch(ws, "nuclei") + ".csv.gz"
    out = ws["nuclei"].select("cell_id", "center_x_um", "center_y_um", "radius_um", "nuclear_pixel_count")
    tables.write_table(out, path, order=["cell_id"])
    return tables.read_table(ws.spark, path, schema=out.schema).select("cell_id", *rs("center_x_um", "center_y_um", "radius_um"), "nuclear_pixel_count")


@query("s7_candidate_store_roundtrip", f"select cell_id, row_number() over (partition by cell_id order by matrix_col_index) - 1 as candidate_index, barcode, {RS('dist_um')} from candidates")
def _(ws):
    from ..sources import candidate_store
    path = scratch(ws, "store")
    candidate_store.write_store(ws["nuclei"], ws["candidates"], path)
    return candidate_store.read_store(ws.spark, path).select("cell_id", F.col("candidate_index").cast("bigint").alias("candidate_index"), "barcode", *rs("dist_um"))


@query("s8_reference_bundle", "select cell_type, gene, count, n_cells from reference_counts join types using (cell_type)")
def _(ws):
    path = scratch(ws, "reference")
    models.write_reference(ws["reference_counts"], ws["typed_cells"].select("cell_type", "n_cells").distinct(), path)
    counts, types = models.read_reference(ws.spark, path)
    return counts.join(types, "cell_type").select("cell_type", "gene", "count", "n_cells")


@query("s9_shape_model_roundtrip", f"select label, n, {R('prior')} as prior from gauss")
def _(ws):
    path = scratch(ws, "model")
    models.write_shape_model(ws["cluster_model"], path)
    return models.read_shape_model(ws.spark, path).select("label", "n", *rs("prior"))


@query("s11_patch_documents_roundtrip", "select patch_id, cell_id, predicted_bins, gt_bins from pcells")
def _(ws):
    from ..sources import patch_documents as pd_
    path = scratch(ws, "documents")
    docs = pd_.documents(ws["patches"], ws["patch_members"], ws["patch_bins"], ws["patch_cells"], ev.patch_metrics(ws["patch_bins"], ws["patch_cells"]))
    pd_.write_documents(docs, path)
    back = pd_.read_documents(ws.spark, path)
    return back.select("patch_id", F.explode("cells").alias("c")).select("patch_id", "c.cell_id", "c.predicted_bins", "c.gt_bins")


@query("s12_seeded_sample", "select c_custkey, c_mktsegment from customer order by md5(concat('5:', c_custkey)), c_custkey limit 200")
def _(ws):
    return tables.sample_rows(ws["customer"], "c_custkey", 200, seed=5).select("c_custkey", "c_mktsegment")


@query("s12_sample_with_replacement", """
with c as (select c_custkey, row_number() over (order by c_custkey) - 1 as place from customer)
select draw, c_custkey from (select draw, cast(concat('0x', substr(md5(concat('7:', draw)), 1, 15)) as bigint) % (select count(*) from customer) as place
 from (select unnest(generate_series(1, 3000)) as draw) d) q join c using (place)""")
def _(ws):
    return tables.sample_with_replacement(ws["customer"].select("c_custkey"), "c_custkey", 3000, seed=7)


# ---- streams ----

@query("st1_streaming_nuclei", "select cell_id, nuclear_pixel_count, cast(round((center_x_fullres_px - crop_left)*nuclear_pixel_count) as bigint) as sum_x, bbox_min_x - crop_left as min_x, bbox_max_y - crop_top as max_y from nuclei, crop_rectangle")
def _(ws):
    path = scratch(ws, "pixels")
    ws["pixels"].repartition(4).write.parquet(path)
    s = stream.file_stream(ws.spark, path, ws["pixels"].schema)
    return stream.nucleus_moments(s).select("cell_id", "nuclear_pixel_count", "sum_x", "min_x", "max_y")


@query("st1_streaming_pixel_counts", "select bin_ordinal, cell_id, nuclear_pixel_count, cytoplasm_pixel_count, boundary_pixel_count, interior_pixel_count, total_compartment_pixels from pixel_counts")
def _(ws):
    from ..operators import grid
    path = scratch(ws, "pixels")
    ws["pixels"].repartition(4).write.parquet(path)
    s = stream.file_stream(ws.spark, path, ws["pixels"].schema)
    return stream.pixel_counts(s, grid.bins_by_bucket(ws["crop_relative"]), ws["crop_rectangle"]).drop("cell_type")


@query("st2_streaming_step_monitor", f"select episode_id, count(*) as n_steps, {R('sum(reward)')} as total_reward, max(step_index) as last_step from step_log group by 1")
def _(ws):
    path = scratch(ws, "steps")
    log = ws["step_log"].select("episode_id", "step_index", "reward")
    log.repartition(4).write.parquet(path)
    return stream.episode_monitor(stream.file_stream(ws.spark, path, log.schema)).select("episode_id", "n_steps", *rs("total_reward"), "last_step")
