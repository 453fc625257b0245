"""Queries: shape features, reference clusters and the shape prior."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions.ordered import ordinal
from ..operators import clusters, scoring as sc, shape as sh
from ..workspace import step
from . import steps
from .registry import R, RS, big, bigs, cte, query, r, rs

_RAW = ("log_area", "compactness", "solidity", "anisotropy")


@step("shape_table", stored=True)
def _shape_table(ws):
    return fixtures.shape_table(ws["embeddings"])


@step("shape_states", stored=True)
def _shape_states(ws):
    return sh.shape_states(ws["pred_assignments"], ["cell_id"], "array_col", "array_row")


@step("shape_features", stored=True)
def _shape_features(ws):
    return sh.shape_features(ws["shape_states"], ["cell_id"])


@step("cluster_model", stored=True)
def _cluster_model(ws):
    return sh.fit_gaussians(sh.cluster_moments(sh.feature_matrix(ws["shape_table"], ["cell_id", "cell_type"]), "cell_type"))


@step("raw_model", stored=True)
def _raw_model(ws):
    m = sh.feature_matrix(ws["shape_features"], ["cell_id"]).withColumn("label", F.concat(F.lit("c"), (F.col("cell_id") % 3).cast("string")))
    return sh.fit_gaussians(sh.cluster_moments(m, "label"))


@step("seed_states")
def _seed_states(ws):
    # a cell's seeds are the places it holds, a short list in its row
    return sh.states_of_places(ws["cells"], ["cell_id"], "held")


def seed_candidates(ws, state=None):
    """Seeds (occupied) and frontier bins of every seeded cell, of the cells of ``state`` if given."""
    if state is None:
        # the cells of a task are few and hold short lists: looked up without ordering the candidate rows
        state = sc.with_cell_states(ws["context"], ws["cells"].hint("shuffle_hash"), ["cell_id"])
    return state.filter("is_assigned or (is_frontier and n_assigned > 0)").select(
        "cell_id", "barcode", "array_col", "array_row", F.col("is_assigned").alias("_occupied"))


_HULL = """
cor{t} as (select distinct k, x+i as x, y+j as y from {g}, (values (0),(1)) a(i), (values (0),(1)) b(j)),
ext{t} as (select k, y, min(x) as lo, max(x) as hi from cor{t} group by 1, 2),
pt{t} as (select k, lo as x, y from ext{t} union select k, hi, y from ext{t}),
eg{t} as (select a.k, a.x ax, a.y ay, b.x bx, b.y b_y from pt{t} a join pt{t} b on a.k=b.k and (a.x<>b.x or a.y<>b.y)
 where not exists (select 1 from pt{t} q where q.k=a.k and ((b.x-a.x)*(q.y-a.y)-(b.y-a.y)*(q.x-a.x) < 0
  or ((b.x-a.x)*(q.y-a.y)-(b.y-a.y)*(q.x-a.x) = 0 and (q.x-a.x)*(q.x-b.x)+(q.y-a.y)*(q.y-b.y) > 0)))),
hu{t} as (select k, sum(ax*b_y - bx*ay)/2.0e0 as hull from eg{t} group by 1)"""
cte("shape_cells", "select distinct cell_id as k, cast(array_col as bigint) as x, cast(array_row as bigint) as y from pred_assignments")
_ANISO = ("case when {n} < 3 or {M} <= 1.0e-8 then 1.0e0 else {M}/greatest({m}, 1.0e-8) end")
cte("shape_sums", """
select *, greatest((xx + yy + sqrt((xx-yy)*(xx-yy) + 4.0e0*xy*xy))/2.0e0, 0.0e0) as major, greatest((xx + yy - sqrt((xx-yy)*(xx-yy) + 4.0e0*xy*xy))/2.0e0, 0.0e0) as minor from (
 select k, n, sx, sy, sxx, syy, sxy, sxx/n - (sx/n)*(sx/n) as xx, syy/n - (sy/n)*(sy/n) as yy, sxy/n - (sx/n)*(sy/n) as xy from (
  select k, count(*) as n, cast(sum(x) as bigint) as sx, cast(sum(y) as bigint) as sy, cast(sum(x*x) as bigint) as sxx, cast(sum(y*y) as bigint) as syy, cast(sum(x*y) as bigint) as sxy from shape_cells group by 1) a) b""")
cte("shape_perimeter", """
select c.k, count(*) as perimeter from shape_cells c, (values (-1,0),(1,0),(0,-1),(0,1)) o(dx, dy) where not exists (select 1 from shape_cells h where h.k = c.k and h.x = c.x + o.dx and h.y = c.y + o.dy) group by 1""")
cte("shape_features", "with " + _HULL.format(t="0", g="shape_cells") + f"""
select s.k as cell_id, n as area, ln(n + 1.0e0) as log_area, perimeter, perimeter*2.0e0 as perimeter_um, 4.0e0*pi()*n/greatest(perimeter*perimeter*1.0e0, 1.0e-8) as compactness,
 case when n <= 2 then n*1.0e0 else greatest(hull, n) end as convex_hull_area, n/(case when n <= 2 then n*1.0e0 else greatest(hull, n) end) as solidity,
 {_ANISO.format(n='n', M='major', m='minor')} as anisotropy, sx/n as centroid_x, sy/n as centroid_y from shape_sums s join shape_perimeter using (k) join hu0 using (k)""")


@query("a14_area_perimeter_compactness", f"select cell_id, area, {RS('log_area')}, perimeter, {RS('perimeter_um', 'compactness', 'centroid_x', 'centroid_y')} from shape_features")
def _(ws):
    return ws["shape_features"].select("cell_id", "area", *rs("log_area"), "perimeter", *rs("perimeter_um", "compactness", "centroid_x", "centroid_y"))


@query("a15_anisotropy", f"select cell_id, {RS('anisotropy')} from shape_features")
def _(ws):
    return ws["shape_features"].select("cell_id", *rs("anisotropy"))


@query("a16_hull_and_solidity", f"select cell_id, {RS('convex_hull_area', 'solidity')} from shape_features")
def _(ws):
    return ws["shape_features"].select("cell_id", *rs("convex_hull_area", "solidity"))


@query("a17_global_zscores", "select cell_id, " + ", ".join(f"{R(f'({n} - avg({n}) over ())/greatest(stddev_pop({n}) over (), 1.0e-8)')} as {n}_z" for n in _RAW) + " from shape_features")
def _(ws):
    return sh.global_zscores(ws["shape_features"], _RAW)[0].select("cell_id", *rs(*[f"{n}_z" for n in _RAW]))


@query("a17_normalisation_table", " union all ".join(f"select '{n}' as feature, {R(f'avg({n})')} as mean, {R(f'stddev_pop({n})')} as std, {R(f'greatest(stddev_pop({n}), 1.0e-8)')} as std_used from shape_features" for n in _RAW))
def _(ws):
    return sh.global_zscores(ws["shape_features"], _RAW)[1].select("feature", *rs("mean", "std", "std_used"))


_TYPE = "concat('t', cast(cell_id % 4 as {s}))"


@query("a18_type_feature_summary", " union all ".join(
    f"select cell_type, '{n}' as feature, count(*) as n_cells, {R(f'avg({n})')} as mean, {R(f'stddev_pop({n})')} as std, {R(f'quantile_cont({n}, 0.5)')} as median from (select *, {_TYPE.format(s='varchar')} as cell_type from shape_features) q group by 1" for n in _RAW))
def _(ws):
    t = ws["shape_features"].withColumn("cell_type", F.expr(_TYPE.format(s="string")))
    return sh.feature_summary(t, "cell_type", _RAW).select("cell_type", "feature", "n_cells", *rs("mean", "std", "median"))


cte("shape_table", "select vec_id as cell_id, cast(label as varchar) as cell_type, " + ", ".join(f"cast(embedding[{i+1}] as double) as feature_{n}" for i, n in enumerate(_RAW)) + " from embeddings")
_FEAT = tuple(f"feature_{n}" for n in _RAW)


@query("a19_scaled_group_means", f"""
with m as (select cell_type, unnest([{', '.join(f"'{n}'" for n in _FEAT)}]) as feature, unnest([{', '.join(f'avg({n})' for n in _FEAT)}]) as mean from shape_table group by 1)
select cell_type, feature, {R('mean')} as mean, {R('greatest(least((mean - avg(mean) over (partition by feature))/(case when stddev_pop(mean) over (partition by feature) > 1.0e-8 then stddev_pop(mean) over (partition by feature) else 1.0e0 end), 2.5e0), -2.5e0)')} as scaled from m""")
def _(ws):
    return sh.scaled_group_means(ws["shape_table"], "cell_type", _FEAT).select("cell_type", "feature", *rs("mean", "scaled"))


@query("a19_contingency", """
select cell_type, count(*) filter (cell_id % 3 = 0) as g0, count(*) filter (cell_id % 3 = 1) as g1, count(*) filter (cell_id % 3 = 2) as g2 from shape_table group by 1""")
def _(ws):
    t = ws["shape_table"].withColumn("g", F.concat(F.lit("g"), (F.col("cell_id") % 3).cast("string")))
    return sh.contingency(t, "cell_type", "g", ["g0", "g1", "g2"])


@query("a40_feature_matrix", "select cell_id, " + ", ".join(f"{R(f'({n} - avg({n}) over ())/(case when stddev_pop({n}) over () > 1.0e-12 then stddev_pop({n}) over () else 1.0e0 end)')} as z_{n}" for n in _RAW) + " from shape_features")
def _(ws):
    m = sh.feature_matrix(ws["shape_features"], ["cell_id"])
    return m.select("cell_id", *[r(F.col("z")[i]).alias(f"z_{n}") for i, n in enumerate(_RAW)])


# labels i*i mod 8: clusters of unequal size
_SIZES = "case when cell_id % 25 = 0 then 'tiny_a' when cell_id % 31 = 1 then 'tiny_b' else concat('big_', cell_type) end"
_DIST = " + ".join(f"(s.c{i} - l.c{i})*(s.c{i} - l.c{i})" for i in range(4))


@query("a37_merge_small_clusters", f"""
with t as (select *, {_SIZES} as lab from shape_table), n as (select lab, count(*) as n, {', '.join(f'avg({f}) as c{i}' for i, f in enumerate(_FEAT))} from t group by 1),
m as (select s.lab, case when s.n >= 25 then s.lab else (select arg_min(l.lab, {_DIST}) from n l where l.n >= 25) end as into_lab from n s),
k as (select lab, concat('cluster_', lpad(cast(dense_rank() over (order by into_lab) - 1 as varchar), 2, '0')) as merged_label from m)
select cell_id, merged_label from t join k using (lab)""")
def _(ws):
    t = ws["shape_table"].withColumn("lab", F.expr(_SIZES))
    m = sh.feature_matrix(t, ["cell_id", "lab"])
    return sh.merge_small_clusters(m, "lab", 25).select("cell_id", "merged_label")


@query("w15_dense_relabel", "select cell_type, dense_rank() over (order by cell_type) - 1 as code from (select distinct cell_type from shape_table) q")
def _(ws):
    return ordinal(ws["shape_table"].select("cell_type").distinct(), ["cell_type"], "code")


_PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
cte("gauss", "select cell_type as label, count(*) as n, " + ", ".join(f"avg({f}) as m{i}" for i, f in enumerate(_FEAT)) + ", " + ", ".join(
    f"covar_samp({_FEAT[i]}, {_FEAT[j]}){' + 1.0e-4' if i == j else ''} as a{i}{j}" for i, j in _PAIRS) + ", count(*)/(select count(*) from shape_table) as prior from shape_table group by 1")
# Cholesky factor of covariance + eps, column by column
_CH = """select *, sqrt({a33} - l30*l30 - l31*l31 - l32*l32) as l33 from (select *, (a32 - l30*l20 - l31*l21)/l22 as l32 from (select *, sqrt({a22} - l20*l20 - l21*l21) as l22, (a31 - l30*l10)/l11 as l31 from (
 select *, (a21 - l20*l10)/l11 as l21 from (select *, sqrt({a11} - l10*l10) as l11 from (select *, a10/l00 as l10, a20/l00 as l20, a30/l00 as l30 from (select *, sqrt({a00}) as l00 from {t}) q0) q1) q2) q3) q4) q5"""
_E2 = {f"a{i}{i}": f"(a{i}{i} + 1.0e-4)" for i in range(4)}
cte("gauss_chol", _CH.format(t="gauss", **_E2))


@query("a38_cluster_moments", f"""
select label, n, {R('prior')} as prior, {', '.join(R(f'm{i}') + f' as m{i}' for i in range(4))}, {', '.join(R(f'a{i}{j}') + f' as a{i}{j}' for i, j in _PAIRS)},
 {R('2.0e0*(ln(l00) + ln(l11) + ln(l22) + ln(l33))')} as logdet from gauss_chol""")
def _(ws):
    m = ws["cluster_model"]
    return m.select("label", "n", *rs("prior"), *[r(F.col("mean")[i]).alias(f"m{i}") for i in range(4)],
                    *[r(F.col("cov")[i * 4 + j]).alias(f"a{i}{j}") for i, j in _PAIRS], *rs("logdet"))


def _forward(chol: str, z: list[str], m: list[str]) -> str:
    return f"""select *, ({z[3]} - {m[3]} - l30*y0 - l31*y1 - l32*y2)/l33 as y3 from (select *, ({z[2]} - {m[2]} - l20*y0 - l21*y1)/l22 as y2 from (
 select *, ({z[1]} - {m[1]} - l10*y0)/l11 as y1 from (select *, ({z[0]} - {m[0]})/l00 as y0 from {chol}) f0) f1) f2"""


cte("shape_ll", "select cell_id, label, prior, -0.5e0*(4.0e0*ln(2.0e0*pi()) + 2.0e0*(ln(l00) + ln(l11) + ln(l22) + ln(l33)) + y0*y0 + y1*y1 + y2*y2 + y3*y3) as ll from ("
    + _forward("(select * from shape_table cross join gauss_chol)", list(_FEAT), [f"m{i}" for i in range(4)]) + ") g")


@query("a39_gaussian_scores", f"""
select cell_id, arg_max(label, ll) as best_cluster, {R('max(ll)', 5)} as best_log_likelihood, {R('max(mx) + ln(sum(exp(ln(prior) + ll - mx)))', 5)} as mixture_log_likelihood
from (select *, max(ln(prior) + ll) over (partition by cell_id) as mx from shape_ll) q group by 1""")
def _(ws):
    m = sh.feature_matrix(ws["shape_table"], ["cell_id"])
    return sh.score_against_clusters(m, ws["cluster_model"]).select("cell_id", "best_cluster", *rs("best_log_likelihood", "mixture_log_likelihood", digits=5))


@query("a35_kmeans_clusters")
def _(ws):
    m = sh.feature_matrix(ws["shape_table"], ["cell_id"])
    return sh.kmeans_clusters(m, 6).groupBy("shape_cluster").agg(F.count("*").alias("n_cells"))


# labels moved to corners far apart, so that the right partition and number are known
_CORNERS = ", ".join(f"0.01e0*{n} + 100.0e0*(cast(floor(code/{2 ** i}) as int) % 2)" for i, n in enumerate(("feature_log_area", "feature_compactness", "feature_solidity", "feature_anisotropy")))


def separated(ws):
    codes = ordinal(ws["shape_table"].select("cell_type").distinct(), ["cell_type"], "code")
    return ws["shape_table"].join(codes, "cell_type").selectExpr("cell_id", f"array({_CORNERS}) as z")


@query("a35_separated_partition", "select cell_id, min(cell_id) over (partition by cell_type) as first_id from shape_table")
def _(ws):
    k = ws["shape_table"].select("cell_type").distinct().count()
    found = sh.kmeans_clusters(separated(ws), k).select("cell_id", "shape_cluster")
    first = found.groupBy("shape_cluster").agg(F.min("cell_id").alias("first_id"))
    return found.join(first, "shape_cluster").select("cell_id", "first_id")


@query("a36_separated_choice", "select cast(count(distinct cell_type) as int) as n_clusters from shape_table")
def _(ws):
    return sh.choose_k(separated(ws), range(2, 15)).filter("rank = 1").select("n_clusters")


# the silhouette by its definition, from all pairs, next to the one from moments
@query("a36_silhouette_of_types", f"""
with f as (select cell_id, cell_type, feature_log_area f0, feature_compactness f1, feature_solidity f2, feature_anisotropy f3 from shape_table),
n as (select cell_type, count(*) as n from f group by 1),
d as (select a.cell_id, a.cell_type, b.cell_type as other, sum((a.f0-b.f0)*(a.f0-b.f0) + (a.f1-b.f1)*(a.f1-b.f1) + (a.f2-b.f2)*(a.f2-b.f2) + (a.f3-b.f3)*(a.f3-b.f3)) as s from f a, f b group by 1, 2, 3),
s as (select d.cell_id, d.cell_type, max(case when other = d.cell_type then s/greatest(n.n - 1, 1) end) as a, min(case when other <> d.cell_type then s/n.n end) as b, max(case when other = d.cell_type then n.n end) as n from d join n on n.cell_type = d.other group by 1, 2)
select cell_type, count(*) as n_cells, {R('avg(case when n > 1 and b is not null and greatest(a, b) > 0 then (b - a)/greatest(a, b) else 0.0e0 end)')} as silhouette_score from s group by 1""")
def _(ws):
    z = F.array(*[f"feature_{n}" for n in sh.FEATURES])
    scores = clusters.silhouettes(ws["shape_table"].select(F.lit(0).alias("model"), F.col("cell_type").alias("label"), z.alias("z")), len(sh.FEATURES))
    return scores.select(F.col("label").alias("cell_type"), F.col("n_rows").alias("n_cells"), *rs("silhouette_score"))


@query("a36_choose_cluster_number")
def _(ws):
    return sh.choose_k(sh.feature_matrix(ws["shape_table"], ["cell_id"]), range(2, 9))


@query("a41_stratified_sample", """
with q as (select cell_type, greatest(round_even(120.0e0*count(*)/(select count(*) from shape_table), 0), 1) as quota from shape_table group by 1),
k as (select t.*, md5(concat('0:', cell_id)) as key from shape_table t), rk as (select k.*, quota, row_number() over (partition by cell_type order by key, cell_id) as rn from k join q using (cell_type))
select cell_id, cell_type from rk order by case when rn > quota then 1 else 0 end, key, cell_id limit 120""")
def _(ws):
    return sh.stratified_sample(ws["shape_table"], "cell_type", "cell_id", 120).select("cell_id", "cell_type")


# ---- shape change of candidates ----

cte("seed_cells", "select cell_id as k, cast(array_col as bigint) as x, cast(array_row as bigint) as y from st where is_assigned")
cte("seed_sums", "select k, count(*) as n, cast(sum(x) as bigint) as sx, cast(sum(y) as bigint) as sy, cast(sum(x*x) as bigint) as sxx, cast(sum(y*y) as bigint) as syy, cast(sum(x*y) as bigint) as sxy from seed_cells group by 1")
cte("seed_perimeter", "select c.k, count(*) as perimeter from seed_cells c, (values (-1,0),(1,0),(0,-1),(0,1)) o(dx, dy) where not exists (select 1 from seed_cells h where h.k = c.k and h.x = c.x + o.dx and h.y = c.y + o.dy) group by 1")
cte("front", "select cell_id, barcode, cast(array_col as bigint) as gx, cast(array_row as bigint) as gy from raw_terms where is_frontier and n_assigned > 0")
cte("shape_after", f"""
select *, {_ANISO.format(n='new_area', M='major', m='minor')} as new_anisotropy, 4.0e0*pi()*new_area/greatest(new_perimeter*new_perimeter*1.0e0, 1.0e-8) as new_compactness, ln(new_area + 1.0e0) as new_log_area from (
 select *, greatest((xx + yy + sqrt((xx-yy)*(xx-yy) + 4.0e0*xy*xy))/2.0e0, 0.0e0) as major, greatest((xx + yy - sqrt((xx-yy)*(xx-yy) + 4.0e0*xy*xy))/2.0e0, 0.0e0) as minor from (
  select cell_id, barcode, new_area, new_perimeter, qxx/new_area - (qx/new_area)*(qx/new_area) as xx, qyy/new_area - (qy/new_area)*(qy/new_area) as yy, qxy/new_area - (qx/new_area)*(qy/new_area) as xy from (
   select f.cell_id, f.barcode, s.n + 1 as new_area, p.perimeter + 4 - 2*(select count(*) from seed_cells h where h.k = f.cell_id and abs(h.x - f.gx) + abs(h.y - f.gy) = 1) as new_perimeter,
    s.sx + gx as qx, s.sy + gy as qy, s.sxx + gx*gx as qxx, s.syy + gy*gy as qyy, s.sxy + gx*gy as qxy from front f join seed_sums s on s.k = f.cell_id join seed_perimeter p on p.k = f.cell_id) a) b) c""")


@query("g11_shape_after_adding", f"select cell_id, barcode, new_area, new_perimeter, {RS('new_compactness', 'new_log_area', 'new_anisotropy')} from shape_after")
def _(ws):
    out = sh.features_after_adding(ws["seed_states"], seed_candidates(ws), ["cell_id"], "array_col", "array_row", with_hull=False)
    return out.select("cell_id", "barcode", "new_area", "new_perimeter", *rs("new_compactness", "new_log_area", "new_anisotropy"))


cte("front_cells", "select f.cell_id*1000000 + cast(f.gy*1000 + f.gx as bigint) as k, s.x, s.y from front f join seed_cells s on s.k = f.cell_id union all select cell_id*1000000 + cast(gy*1000 + gx as bigint), gx, gy from front")


@query("g11_hull_after_adding", "with " + _HULL.format(t="9", g="front_cells") + f"""
select f.cell_id, f.barcode, {R('case when s.n + 1 <= 2 then (s.n + 1)*1.0e0 else greatest(h.hull, s.n + 1) end')} as new_hull from front f join seed_sums s on s.k = f.cell_id join hu9 h on h.k = f.cell_id*1000000 + cast(f.gy*1000 + f.gx as bigint)""")
def _(ws):
    out = sh.features_after_adding(ws["seed_states"], seed_candidates(ws), ["cell_id"], "array_col", "array_row")
    return out.select("cell_id", "barcode", *rs("new_hull"))


# the same change as SQL: features of seeds and of seeds plus a bin, in model space, under the Gaussian mixture
cte("hull_after", "with " + _HULL.format(t="9", g="front_cells") + " select k, hull from hu9")
cte("hull_now", "with " + _HULL.format(t="8", g="seed_cells") + " select k, hull from hu8")
cte("shape_now", f"""
select k as cell_id, ln(n + 1.0e0) as log_area, 4.0e0*pi()*n/greatest(perimeter*perimeter*1.0e0, 1.0e-8) as compactness, n/(case when n <= 2 then n*1.0e0 else greatest(hull, n) end) as solidity,
 {_ANISO.format(n='n', M='major', m='minor')} as anisotropy from (
 select *, greatest((xx + yy + sqrt((xx-yy)*(xx-yy) + 4.0e0*xy*xy))/2.0e0, 0.0e0) as major, greatest((xx + yy - sqrt((xx-yy)*(xx-yy) + 4.0e0*xy*xy))/2.0e0, 0.0e0) as minor from (
  select k, n, perimeter, hull, sxx/n - (sx/n)*(sx/n) as xx, syy/n - (sy/n)*(sy/n) as yy, sxy/n - (sx/n)*(sy/n) as xy from seed_sums join seed_perimeter using (k) join hull_now using (k)) a) b""")
cte("model_scale", "select " + ", ".join(f"avg({n}) as sm{i}, case when stddev_pop({n}) > 1.0e-12 then stddev_pop({n}) else 1.0e0 end as ss{i}" for i, n in enumerate(_RAW)) + " from shape_features")
cte("model_z", "select cell_id % 3 as lab, " + ", ".join(f"({n} - sm{i})/ss{i} as z{i}" for i, n in enumerate(_RAW)) + " from shape_features, model_scale")
cte("raw_gauss", "select lab, " + ", ".join(f"avg(z{i}) as m{i}" for i in range(4)) + ", " + ", ".join(
    f"covar_samp(z{i}, z{j}){' + 1.0e-4' if i == j else ''} as a{i}{j}" for i, j in _PAIRS) + ", count(*)/(select count(*) from model_z) as prior from model_z group by 1")
cte("raw_chol", _CH.format(t="raw_gauss", **_E2))
cte("points", f"""
select cell_id, barcode, {', '.join(f'({n} - sm{i})/ss{i} as z{i}' for i, n in enumerate(_RAW))} from (
 select a.cell_id, a.barcode, new_log_area as log_area, new_compactness as compactness, new_area/(case when new_area <= 2 then new_area*1.0e0 else greatest(h.hull, new_area) end) as solidity, new_anisotropy as anisotropy
 from shape_after a join front f on f.cell_id = a.cell_id and f.barcode = a.barcode join hull_after h on h.k = f.cell_id*1000000 + cast(f.gy*1000 + f.gx as bigint)
 union all select cell_id, 'now', log_area, compactness, solidity, anisotropy from shape_now) q, model_scale""")
cte("point_rewards", "select cell_id, barcode, max(mx) + ln(sum(exp(v - mx))) as reward from (select *, max(v) over (partition by cell_id, barcode) as mx from (select cell_id, barcode, ln(prior) - 0.5e0*(4.0e0*ln(2.0e0*pi()) + 2.0e0*(ln(l00) + ln(l11) + ln(l22) + ln(l33)) + y0*y0 + y1*y1 + y2*y2 + y3*y3) as v from ("
    + _forward("(select * from points cross join raw_chol)", [f"z{i}" for i in range(4)], [f"m{i}" for i in range(4)]) + ") g) w) u group by 1, 2")


cte("shape_deltas", "select a.cell_id, a.barcode, a.reward - b.reward as shape_raw from point_rewards a join point_rewards b on b.cell_id = a.cell_id and b.barcode = 'now' where a.barcode <> 'now'")
cte("shape_terms", """
select *, least(greatest((shape_raw - avg(shape_raw) over (partition by cell_id))/(stddev_pop(shape_raw) over (partition by cell_id) + 1.0e-8), -5.0e0), 5.0e0) as shape_term from shape_deltas""")


@step("shape_terms")
def _shape_terms(ws):
    return terms_of(ws)


def terms_of(ws, state=None):
    d = sh.delta_shape_rewards(ws["seed_states"], seed_candidates(ws, state), ws["raw_model"], sh.scaler(ws["shape_features"]), ["cell_id"], "array_col", "array_row")
    return sh.frontier_shape_terms(d, ["cell_id"])


@query("g11_shape_delta_terms", f"select cell_id, barcode, {RS('shape_raw', 'shape_term', digits=3)} from shape_terms")
def _(ws):
    return ws["shape_terms"].select("cell_id", "barcode", *rs("shape_raw", "shape_term", digits=3))


cte("sco_shape", """
select s.*, coalesce(t.shape_raw, 0.0e0) as shape_raw, coalesce(t.shape_term, 0.0e0) as shape_term, s.add_score + 0.25e0*coalesce(t.shape_term, 0.0e0) as shaped_score
from sco s left join shape_terms t on t.cell_id = s.cell_id and t.barcode = s.barcode""")


@step("scored_shape")
def _scored_shape(ws):
    return with_shape(ws, ws["scored"])


def with_shape(ws, scored):
    """Scores with the shape term, of the cells of ``scored``."""
    # a cell's frontier fits one disc: its terms meet the candidate rows as a list, without ordering them
    listed = terms_of(ws, scored).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("barcode", F.struct("shape_raw", "shape_term")))).alias("_shape"))
    of = F.when(F.col("is_frontier"), F.try_element_at("_shape", F.col("barcode")))
    zero = lambda c: F.coalesce(of[c], F.lit(0.0))
    state = scored.withColumn("p_dis", F.col("dist_um") / steps.WEIGHTS.r_max_um).join(listed.hint("shuffle_hash"), "cell_id", "left")
    return sc.scores_from_statistics(state.withColumns({"shape_raw": zero("shape_raw"), "shape_term": zero("shape_term")}).drop("_shape"), steps.WEIGHTS, shape="shape_term")


@query("g9_add_score_with_shape", f"select cell_id, barcode, {R('shaped_score', 3)} as add_score from sco_shape")
def _(ws):
    return ws["scored_shape"].select("cell_id", "barcode", *rs("add_score", digits=3))


@query("g18_cell_objective_with_shape", f"""
select o.cell_id, {R('o.objective + coalesce(0.25e0*p.reward, 0.0e0)', 3)} as objective from objective o left join point_rewards p on p.cell_id = o.cell_id and p.barcode = 'now'""")
def _(ws):
    now = sh.current_shape_rewards(ws["seed_states"], ws["raw_model"], sh.scaler(ws["shape_features"]), ["cell_id"])
    cells = ws["cells"].join(now, "cell_id", "left").fillna(0.0, ["shape_reward"])
    return sc.cell_objective(cells, ["cell_id"], steps.WEIGHTS, shape="shape_reward").select("cell_id", *rs("objective", digits=3))


@query("g21_evidence_with_shape", f"""
with top as (select cell_id, avg(shaped_score) filter (a <= 5) as frontier_topk, avg(shape_term) filter (b <= 5) as shape_topk from (
 select cell_id, shaped_score, shape_term, row_number() over (partition by cell_id order by shaped_score desc) as a, row_number() over (partition by cell_id order by shape_term desc) as b from sco_shape where is_frontier) q group by 1),
q as (select s.cell_id, s.grow_ratio, s.compactness, case when s.n_frontier > 0 then 1.0e0/(1.0e0 + exp(-least(greatest(top.frontier_topk/0.2e0, -60.0e0), 60.0e0))) else 0.0e0 end as frontier_quality,
 tanh(coalesce(top.shape_topk, 0.0e0)) as shape_quality from summ s left join top using (cell_id)),
e as (select q.*, grow_ratio*(1.0e0 - frontier_quality) as overgrowth_risk, l.mean_step_reward, l.stopped from q join (
 select cell_id, avg(reward) as mean_step_reward, bool_or(action = 'stop' and done) as stopped from step_log group by 1) l using (cell_id)),
s as (select *, case when stopped then 1.0e0 - 2.0e0*frontier_quality + overgrowth_risk else frontier_quality - overgrowth_risk end as stop_evidence from e)
select cell_id, {RS('frontier_quality', 'overgrowth_risk', 'shape_quality', 'stop_evidence', digits=3)},
 {R('mean_step_reward + 0.7e0*frontier_quality + 0.5e0*stop_evidence - 0.8e0*overgrowth_risk + 0.25e0*compactness + 0.25e0*shape_quality', 3)} as episode_score from s""")
def _(ws):
    log = ws["step_log"].groupBy("cell_id").agg(F.avg("reward").alias("mean_step_reward"), F.bool_or((F.col("action") == "stop") & F.col("done")).alias("stopped"))
    e, w = sc.EvidenceWeights(), steps.WEIGHTS
    # only logged cells have evidence, so that scores are made of their rows alone
    of_log = lambda table: table.join(log.select("cell_id"), "cell_id", "left_semi")
    context = of_log(ws["context"])
    state = sc.with_raw_terms(sc.with_cell_states(context, of_log(ws["cells"]), ["cell_id"]))
    scored = with_shape(ws, sc.with_term_statistics(state, ["cell_id"], "is_frontier"))
    states = sc.state_summary(scored, sc.likelihood_features(context, ["cell_id"]), ["cell_id"], w, "is_frontier").join(
        sc.top_k_mean(scored, ["cell_id"], "is_frontier", "shape_term", w.stop_top_k, "shape_topk"), "cell_id")
    out = sc.episode_scores(sc.evidence(states, e, "shape_topk").join(log, "cell_id"), e)
    return out.select("cell_id", *rs("frontier_quality", "overgrowth_risk", "shape_quality", "stop_evidence", "episode_score", digits=3))


@query("g24_breakdown_with_shape", f"""
select cell_id, barcode, row_number() over (partition by cell_id order by matrix_col_index) - 1 as bin_index, {RS('x_um', 'y_um')}, is_assigned, is_frontier,
 {R('shaped_score', 3)} as add_score, {RS('shape_raw', 'shape_term', digits=3)}, {R('0.25e0*shape_term', 3)} as shape_weighted from sco_shape""")
def _(ws):
    from ..operators.growth import score_breakdown
    return score_breakdown(ws["scored_shape"], steps.WEIGHTS, "shape_term").select(
        "cell_id", "barcode", F.col("bin_index").cast("long").alias("bin_index"), *rs("x_um", "y_um"), "is_assigned", "is_frontier",
        *rs("add_score", "shape_raw", "shape_term", "shape_weighted", digits=3))
