"""Scores of one assignment state: every operator is a join or an aggregate over
(candidates, assigned bins, likelihoods).

``keys`` name the cell scope: ``cell_id``, or ``patch_id`` and ``cell_id`` when legality
depends on the patch. One scope holds the bins inside a search disc, so it is bounded by
the disc's area over the bin pitch; windows over ``keys`` rely on that bound. Anything
wider (patch, bin, type) is aggregated instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import stats as st
from ..functions.scalars import attach_scalars
from .grid import EIGHT_NEIGHBOURS, offset_rows, place


@dataclass(frozen=True)
class Weights:
    """Score weights. The defaults of the scored growth setup."""

    r_max_um: float = 20.0
    gain: float = 0.45
    distance: float = 1.0
    overlap: float = 1.0
    support: float = 0.05
    compatibility: float = 0.10
    shape: float = 0.25
    stop_lambda: float = 0.7
    stop_top_k: int = 5
    zscore_delta: float = 1.0e-8
    normalize: bool = True


def distance_to_other(candidates: DataFrame) -> DataFrame:
    """Per barcode the two nearest centres whose search disc holds the bin.

    An overlap penalty is only positive when the other centre is nearer than the own one,
    hence inside the search disc: the pairs of the radius join have every such centre.
    """
    w = Window.partitionBy("barcode").orderBy("dist_um", "cell_id")
    top = candidates.select("barcode", "cell_id", "dist_um").withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    entry = F.struct(F.col("cell_id").alias("c"), F.col("dist_um").alias("d"))
    return top.groupBy("barcode").agg(F.max(F.when(F.col("_rn") == 1, entry)).alias("_first"),
                                      F.max(F.when(F.col("_rn") == 2, entry)).alias("_second"))


def seed_flags(candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    """A candidate bin is a seed of its cell iff the cell is its only, hence dominant, claimant."""
    owner = metadata.filter("has_nuclear_annotation and not ambiguous_nuclear_assignment").select(
        "barcode", F.col("dominant_cell_id").alias("_owner"))
    return candidates.join(owner, "barcode", "left").withColumn("is_seed", F.coalesce(F.col("_owner") == F.col("cell_id"), F.lit(False))).drop("_owner")


def build_context(candidates: DataFrame, metadata: DataFrame, bin_ll: DataFrame, w: Weights, discs: DataFrame | None = None) -> DataFrame:
    """Static columns per (cell, candidate bin): seed flag, likelihoods and penalties.

    ``discs`` are all pairs of the radius join where ``candidates`` are only a band of them.
    """
    others = distance_to_other(candidates if discs is None else discs)
    flagged = seed_flags(candidates, metadata).join(others, "barcode").join(bin_ll, "barcode")
    d_other = F.when(F.col("_first.c") == F.col("cell_id"), F.col("_second.d")).otherwise(F.col("_first.d"))
    p_dis = F.col("dist_um") / w.r_max_um
    p_overlap = F.coalesce(F.greatest(F.lit(0.0), (F.col("dist_um") - d_other) / w.r_max_um), F.lit(0.0))
    return flagged.select(
        "cell_id", "barcode", "matrix_col_index", "array_row", "array_col", "x_um", "y_um", "center_x_um", "center_y_um", "dist_um",
        "is_seed", "bin_total", "ll", "expr_conf", p_dis.alias("p_dis"), p_overlap.alias("p_overlap"),
        (w.distance * p_dis + w.overlap * p_overlap).alias("base_penalty"))


def nearest_seed_owner(proposals: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Each contested seed goes to the claimant with the smallest (distance, cell id)."""
    pick = F.min(F.struct(F.col("dist_um"), F.col("cell_id").cast("string").alias("s"), "cell_id")).alias("_m")
    return proposals.groupBy(*scope, "barcode").agg(pick, F.count("*").alias("n_claims")).select(
        *scope, "barcode", F.col("_m.cell_id").alias("cell_id"), "n_claims")


def first_come_seed_owner(proposals: DataFrame, rank: str, scope: Sequence[str] = ()) -> DataFrame:
    """Each contested seed goes to the earliest cell in patch order; counts the others as conflicts."""
    return proposals.groupBy(*scope, "barcode").agg(
        F.min_by("cell_id", rank).alias("cell_id"), (F.countDistinct("cell_id") - 1).alias("n_conflicts"))


def contested_barcodes(candidates: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return candidates.groupBy(*scope, "barcode").agg(F.countDistinct("cell_id").alias("n_cells")).filter("n_cells > 1")


def with_support(context: DataFrame, assigned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``is_assigned`` and ``support`` = assigned 8-neighbours / 8.

    The assigned bins, the smaller side, are spread to their neighbours and counted.
    """
    pos = assigned.select(*keys, "array_row", "array_col")
    spread = pos.select(*keys, "array_row", "array_col", offset_rows(EIGHT_NEIGHBOURS).alias("_o")).groupBy(
        *keys, (F.col("array_row") + F.col("_o.dy")).alias("array_row"), (F.col("array_col") + F.col("_o.dx")).alias("array_col")
    ).agg((F.count("*") / 8.0).alias("_support"))
    cell = [*keys, "array_row", "array_col"]
    marked = context.join(spread, cell, "left").join(pos.withColumn("_in", F.lit(True)), cell, "left")
    return marked.select(*context.columns, F.coalesce("_support", F.lit(0.0)).alias("support"), F.coalesce("_in", F.lit(False)).alias("is_assigned"))


def cell_sums(state: DataFrame, keys: Sequence[str], n_types: int) -> DataFrame:
    """One aggregate per cell over its assigned bins; empty states give zeros."""
    a = F.col("is_assigned")
    on = lambda e: F.coalesce(F.sum(F.when(a, e)), F.lit(0.0))
    vec = lambda weight: F.array(*[on(F.col("ll")[i] * weight) for i in range(n_types)])
    return state.groupBy(*keys).agg(
        F.count_if(a).alias("n_assigned"), F.count("*").alias("n_bins"), F.count_if("is_seed").alias("n_seed"),
        vec(F.lit(1.0)).alias("ll_sum"), vec(F.col("expr_conf")).alias("conf_ll_sum"), on(F.col("expr_conf")).alias("conf_sum"),
        on(F.col("base_penalty")).alias("base_sum"), on(F.col("support")).alias("support_sum"),
        F.avg(F.when(a, F.col("x_um"))).alias("_mx"), F.avg(F.when(a, F.col("y_um"))).alias("_my"),
        F.max("center_x_um").alias("_nx"), F.max("center_y_um").alias("_ny"),
        F.count_if(~a & (F.col("support") > 0)).alias("n_touching"))


def with_frontier(state: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the cell sums; frontier = unassigned and touching, or all bins of an empty cell."""
    prepared = sums.select(
        *keys, "n_assigned", "n_bins", "n_seed", "ll_sum", "conf_ll_sum", "conf_sum", "base_sum", "support_sum",
        F.coalesce("_mx", "_nx").alias("centroid_x"), F.coalesce("_my", "_ny").alias("centroid_y"),
        st.softmax(F.col("ll_sum")).alias("posterior"))
    frontier = ~F.col("is_assigned") & ((F.col("support") > 0) | (F.col("n_assigned") == 0))
    return state.join(prepared, list(keys)).withColumn("is_frontier", frontier)


def _touching(held: Column, here: Column) -> Column:
    """Share of the eight neighbours of a place that are in a cell's short list."""
    met = [F.array_contains(held, here + F.lit(b * (1 << 32) + a)).cast("int") for a, b in EIGHT_NEIGHBOURS]
    return sum(met[1:], met[0]) / 8.0


def cell_states(context: DataFrame, assigned: DataFrame, keys: Sequence[str], n_types: int) -> DataFrame:
    """One row per cell: its bin counts, the places it holds and the sums over them; cells without any have zeros.

    As ``cell_sums`` of ``with_support``, from the assigned rows alone: no candidate row is
    exchanged with more than its cell. What a cell holds fits one disc and travels as a list.
    """
    counts = context.groupBy(*keys).agg(F.count("*").alias("n_bins"), F.count_if("is_seed").alias("n_seed"), F.max("center_x_um").alias("_nx"), F.max("center_y_um").alias("_ny"))
    vec = lambda weight: F.array(*[F.sum(F.col("ll")[i] * weight) for i in range(n_types)])
    held = assigned.groupBy(*keys).agg(
        F.count("*").alias("n_assigned"), vec(F.lit(1.0)).alias("ll_sum"), vec(F.col("expr_conf")).alias("conf_ll_sum"), F.sum("expr_conf").alias("conf_sum"),
        F.sum("base_penalty").alias("base_sum"), F.avg("x_um").alias("_mx"), F.avg("y_um").alias("_my"),
        F.sort_array(F.collect_list(place(F.col("array_row"), F.col("array_col")))).alias("held"))
    zeros = F.array(*[F.lit(0.0) for _ in range(n_types)])
    filled = lambda c, v: F.coalesce(F.col(c), v).alias(c)
    rows = counts.join(held, list(keys), "left").select(
        *keys, filled("n_assigned", F.lit(0).cast("long")), "n_bins", "n_seed", filled("ll_sum", zeros), filled("conf_ll_sum", zeros), filled("conf_sum", F.lit(0.0)),
        filled("base_sum", F.lit(0.0)), F.coalesce("_mx", "_nx").alias("centroid_x"), F.coalesce("_my", "_ny").alias("centroid_y"), filled("held", F.array().cast("array<long>")))
    return rows.withColumns({"support_sum": F.aggregate("held", F.lit(0.0), lambda s, at: s + _touching(F.col("held"), at)), "posterior": st.softmax(F.col("ll_sum"))})


def with_cell_states(context: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of ``with_frontier`` of ``with_support``, by one join with the cells' rows."""
    here = place(F.col("array_row"), F.col("array_col"))
    mine = F.array_contains("held", here)
    marked = context.join(cells, list(keys)).withColumns({"support": _touching(F.col("held"), here), "is_assigned": mine})
    frontier = ~F.col("is_assigned") & ((F.col("support") > 0) | (F.col("n_assigned") == 0))
    return marked.select(*context.columns, "support", "is_assigned", "n_assigned", "n_bins", "n_seed", "ll_sum", "conf_ll_sum", "conf_sum", "base_sum", "support_sum",
                         "centroid_x", "centroid_y", "posterior").withColumn("is_frontier", frontier)


def mark_legal(state: DataFrame, owners: DataFrame, scope: Sequence[str] = (), box: Column | None = None) -> DataFrame:
    """Legal = frontier bins nobody owns, inside the patch box if one is given."""
    owned = owners.select(*scope, "barcode").distinct().withColumn("_owned", F.lit(True))
    ok = F.col("is_frontier") & F.col("_owned").isNull()
    if box is not None:
        ok = ok & box
    return state.join(owned, [*scope, "barcode"], "left").withColumn("is_legal", ok).drop("_owned")


def posterior_gain() -> Column:
    """conf * (max posterior after adding the bin - max posterior now)."""
    after = st.softmax_max(st.add_vectors(F.col("ll_sum"), F.col("ll")))
    return F.col("expr_conf") * (after - F.array_max("posterior"))


def compatibility() -> Column:
    return F.col("expr_conf") * st.dot(F.col("ll"), F.col("posterior"))


def with_raw_terms(state: DataFrame) -> DataFrame:
    """The two expression terms per (cell, bin). They do not depend on the patch, so they are computed once."""
    return state.withColumns({"gain_raw": posterior_gain(), "compat_raw": compatibility()})


_STATISTICS = ("_gm", "_gs", "_cm", "_cs")


def with_term_statistics(state: DataFrame, keys: Sequence[str], mask: str) -> DataFrame:
    """Mean and deviation of the raw terms over the cell's ``mask`` rows, on all rows of the cell."""
    over = Window.partitionBy(*keys)
    stat = lambda fn, c: fn(F.when(F.col(mask), F.col(c))).over(over)
    return state.withColumns({
        "_gm": stat(F.avg, "gain_raw"), "_gs": stat(F.stddev_pop, "gain_raw"),
        "_cm": stat(F.avg, "compat_raw"), "_cs": stat(F.stddev_pop, "compat_raw")})


def scores_from_statistics(state: DataFrame, w: Weights, shape: str | None = None) -> DataFrame:
    """The z-scored terms and the ADD score, row by row from ``with_term_statistics``."""
    z = lambda c, m_, s_: F.coalesce(st.zscore_shifted(F.col(c), F.col(m_), F.col(s_), w.zscore_delta), F.lit(0.0))
    termed = state.withColumns({"gain_term": z("gain_raw", "_gm", "_gs"), "compat_term": z("compat_raw", "_cm", "_cs")}).drop(*_STATISTICS)
    return _with_score(termed, w, shape)


def _with_score(termed: DataFrame, w: Weights, shape: str | None) -> DataFrame:
    score = (w.gain * F.col("gain_term") + w.compatibility * F.col("compat_term") - F.col("base_penalty") + w.support * F.col("support"))
    if shape is not None:
        score = score + w.shape * F.col(shape)
    return termed.withColumn("add_score", score)


def add_scores(state: DataFrame, keys: Sequence[str], w: Weights, mask: str, shape: str | None = None) -> DataFrame:
    """Frontier z-scores of the raw terms and the ADD score of every candidate bin.

    The z statistics come from ``mask`` rows only and apply to all rows of the cell.
    """
    if w.normalize:
        return scores_from_statistics(with_term_statistics(state, keys, mask), w, shape)
    return _with_score(state.withColumns({"gain_term": F.col("gain_raw"), "compat_term": F.col("compat_raw")}), w, shape)


def top_k_mean(scored: DataFrame, keys: Sequence[str], mask: str, value: str, k: int, out: str) -> DataFrame:
    """Mean of the k largest masked values per group; 0 for groups without any."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value))
    top = scored.filter(F.col(mask)).select(*keys, value).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    means = top.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return scored.select(*keys).distinct().join(means, list(keys), "left").select(*keys, F.coalesce("_m", F.lit(0.0)).alias(out))


def stop_scores(scored: DataFrame, keys: Sequence[str], mask: str, w: Weights) -> DataFrame:
    best = top_k_mean(scored, keys, mask, "add_score", w.stop_top_k, "stop_delta")
    return best.withColumn("stop_score", F.lit(-w.stop_lambda) * F.col("stop_delta"))


def likelihood_features(context: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, max, top-two margin and normalised entropy of the type likelihoods, z-scored per cell."""
    ll = F.col("ll")
    k = F.size(ll)
    ordered = F.sort_array(ll, asc=False)
    p = st.softmax(ll)
    entropy = -st.vector_sum(F.transform(p, lambda v: v * F.log(F.greatest(v, F.lit(1.0e-12))))) / F.log(k.cast("double"))
    feats = context.select(*keys, "barcode", (st.vector_sum(ll) / k).alias("ll_mean"), F.array_max(ll).alias("ll_max"),
                           F.when(k > 1, ordered[0] - ordered[1]).otherwise(ordered[0]).alias("ll_margin"),
                           F.when(k > 1, entropy).otherwise(F.lit(0.0)).alias("ll_entropy"))
    over = Window.partitionBy(*keys)
    z = lambda c: st.zscore_small_group(F.col(c), F.avg(c).over(over), F.stddev_pop(c).over(over), F.count("*").over(over)).alias(f"{c}_z")
    return feats.select("*", z("ll_mean"), z("ll_max"), z("ll_margin"))


def scaled_log(value: Column, cap: float) -> Column:
    return F.log1p(F.least(F.greatest(value, F.lit(0.0)), F.lit(cap))) / F.log1p(F.lit(cap))


def state_summary(scored: DataFrame, features: DataFrame, keys: Sequence[str], w: Weights, mask: str) -> DataFrame:
    """One row per cell: growth, compactness, drift, likelihood means and frontier score statistics."""
    m, a = F.col(mask), F.col("is_assigned")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # only assigned bins' features are asked for; what a cell holds fits one disc and meets its features as a list
    listed = scored.filter(a).groupBy(*keys).agg(F.collect_list("barcode").alias("_held"))
    held = features.select(*keys, "barcode", "ll_mean_z", "ll_max_z").join(listed, list(keys)).filter(F.array_contains("_held", F.col("barcode"))).groupBy(*keys).agg(
        F.avg("ll_mean_z").alias("_lm"), F.avg("ll_max_z").alias("_lx"))
    agg = scored.groupBy(*keys).agg(
        F.max("n_bins").alias("n_bins"), F.max("n_assigned").alias("n_assigned"), F.max("n_seed").alias("n_seed"),
        zero(F.max("support_sum") / F.nullif(F.max("n_assigned"), F.lit(0))).alias("compactness"),
        F.max("centroid_x").alias("_cx"), F.max("centroid_y").alias("_cy"), F.max("center_x_um").alias("_nx"), F.max("center_y_um").alias("_ny"),
        zero(F.avg(F.when(m, F.col("add_score")))).alias("frontier_mean"), zero(F.stddev_pop(F.when(m, F.col("add_score")))).alias("frontier_std"),
        zero(F.max(F.when(m, F.col("add_score")))).alias("frontier_max"),
        zero(F.avg(F.when(m, (F.col("add_score") > 0).cast("double")))).alias("positive_fraction"), F.count_if(m).alias("n_frontier"))
    topk = top_k_mean(scored, keys, mask, "add_score", w.stop_top_k, "frontier_topk")
    dx, dy = F.col("_cx") - F.col("_nx"), F.col("_cy") - F.col("_ny")
    both = agg.join(topk, list(keys)).join(held, list(keys), "left").withColumns({"assigned_ll_mean": zero(F.col("_lm")), "assigned_ll_max": zero(F.col("_lx"))})
    return both.select(
        *keys, (F.col("n_assigned") / F.col("n_bins")).alias("assigned_frac"), ((F.col("n_bins") - F.col("n_assigned")) / F.col("n_bins")).alias("remaining_frac"),
        scaled_log(F.col("n_assigned") / F.greatest("n_seed", F.lit(1)), 8.0).alias("grow_ratio"), scaled_log(F.col("n_seed").cast("double"), 32.0).alias("seed_size"),
        "compactness", st.clip(F.sqrt(dx * dx + dy * dy) / w.r_max_um, 0.0, 1.0).alias("centroid_drift"),
        "assigned_ll_mean", "assigned_ll_max", "frontier_mean", "frontier_std", "frontier_max", "frontier_topk", "positive_fraction", "n_frontier", "n_bins", "n_seed")


def patch_summary(cell_summary: DataFrame, core: DataFrame) -> DataFrame:
    """Mean of the core cells' summaries per patch, with scaled totals."""
    names = ("assigned_frac", "remaining_frac", "grow_ratio", "positive_fraction", "centroid_drift", "compactness", "assigned_ll_mean",
             "assigned_ll_max", "frontier_topk", "frontier_max", "frontier_mean")
    joined = core.select("patch_id", "cell_id").join(cell_summary, [c for c in ("patch_id", "cell_id") if c in cell_summary.columns])
    return joined.groupBy("patch_id").agg(
        *[F.avg(n).alias(n) for n in names], (F.log1p(F.sum("n_bins").cast("double")) / 8.0).alias("n_bins_scaled"),
        scaled_log(F.sum("n_seed").cast("double"), 32.0).alias("seed_size"))


def candidate_geometry(scored: DataFrame, w: Weights, mask: str) -> DataFrame:
    """Distance, direction and compactness change of each frontier bin relative to the current cell; 0 elsewhere."""
    m = F.col(mask)
    dx, dy = F.col("x_um") - F.col("centroid_x"), F.col("y_um") - F.col("centroid_y")
    ux, uy = F.col("centroid_x") - F.col("center_x_um"), F.col("centroid_y") - F.col("center_y_um")
    norm, drift = F.sqrt(dx * dx + dy * dy), F.sqrt(ux * ux + uy * uy)
    n = F.col("n_assigned")
    gain = (F.col("support_sum") + 2.0 * F.col("support")) / (n + 1) - F.col("support_sum") / n
    off = lambda c: F.when(m, c).otherwise(F.lit(0.0))
    return scored.withColumns({
        "centroid_distance": off(st.clip(norm / w.r_max_um, 0.0, 1.0)),
        "compactness_gain": off(F.when(n > 0, gain).otherwise(F.lit(0.0))),
        "dx_scaled": off(st.clip(dx / w.r_max_um, -1.0, 1.0)), "dy_scaled": off(st.clip(dy / w.r_max_um, -1.0, 1.0)),
        "drift_alignment": off(F.when((drift > 1.0e-8) & (norm > 1.0e-8), st.clip((dx * ux + dy * uy) / (norm * drift), -1.0, 1.0)).otherwise(F.lit(0.0)))})


def seed_shape(state: DataFrame, keys: Sequence[str], w: Weights) -> DataFrame:
    """Seed compactness, 90th percentile radius and elongation. ``support`` must be that of the seeds."""
    seeds = state.filter("is_seed")
    agg = seeds.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("support").alias("seed_compactness"), F.percentile("dist_um", 0.9).alias("_p90"),
        F.var_pop("x_um").alias("_xx"), F.var_pop("y_um").alias("_yy"), F.covar_pop("x_um", "y_um").alias("_xy"))
    tr, gap = F.col("_xx") + F.col("_yy"), F.sqrt((F.col("_xx") - F.col("_yy")) * (F.col("_xx") - F.col("_yy")) + 4.0 * F.col("_xy") * F.col("_xy"))
    major, minor = F.greatest((tr + gap) / 2.0, F.lit(0.0)), F.greatest((tr - gap) / 2.0, F.lit(0.0))
    aspect = F.when((F.col("n") < 3) | (major <= 1.0e-12), F.lit(0.0)).otherwise(
        st.clip(1.0 - F.sqrt((minor + 1.0e-12) / (major + 1.0e-12)), 0.0, 1.0))
    return agg.select(*keys, "seed_compactness", st.clip(F.col("_p90") / w.r_max_um, 0.0, 1.0).alias("seed_radius_p90"), aspect.alias("seed_aspect"))


def cell_objective(prepared: DataFrame, keys: Sequence[str], w: Weights, shape: str | None = None) -> DataFrame:
    """Objective of each cell's current bins from its sums; 0 for an empty cell."""
    total = (w.gain * F.array_max("posterior") * F.col("conf_sum") + w.compatibility * st.dot(F.col("conf_ll_sum"), F.col("posterior"))
             - F.col("base_sum") + w.support * F.col("support_sum"))
    if shape is not None:
        total = total + w.shape * F.col(shape)
    return prepared.select(*keys, F.when(F.col("n_assigned") > 0, total).otherwise(F.lit(0.0)).alias("objective"))


def patch_objective(objectives: DataFrame, members: DataFrame, normalisation: str, n_fill: DataFrame | None = None) -> DataFrame:
    """Sum of cell objectives over a denominator chosen by name."""
    per = members.select("patch_id", "cell_id").join(objectives, "cell_id").groupBy("patch_id").agg(
        F.sum("objective").alias("_t"), F.count("*").alias("_n"))
    if n_fill is not None:
        per = per.join(n_fill, "patch_id", "left")
    n, b = F.greatest("_n", F.lit(1)), F.greatest(F.coalesce("n_fill", F.lit(0)), F.lit(1)) if n_fill is not None else F.lit(1)
    den = {"sum_core_cells": F.lit(1.0), "sqrt_core_cells": F.sqrt(n), "mean_core_cells": n,
           "mean_expression_bins": b, "sqrt_expression_bins": F.sqrt(b)}[normalisation]
    return per.select("patch_id", (F.col("_t") / den).alias("patch_score"))


def objective_deltas(state: DataFrame, w: Weights) -> DataFrame:
    """Exact change of the cell objective for adding (unassigned) or removing (assigned) each bin."""
    conf = F.col("expr_conf")
    sign = F.when(F.col("is_assigned"), F.lit(-1.0)).otherwise(F.lit(1.0))
    conf_sum = F.greatest(F.col("conf_sum") + sign * conf, F.lit(0.0))
    scores = F.zip_with("ll_sum", "ll", lambda s, v: s + sign * v)
    sums = F.zip_with("conf_ll_sum", "ll", lambda s, v: s + sign * (v * conf))
    after = st.bound(st.softmax(scores), lambda p: w.gain * F.array_max(p) * conf_sum + w.compatibility * st.dot(sums, p))
    now = w.gain * F.array_max("posterior") * F.col("conf_sum") + w.compatibility * st.dot(F.col("conf_ll_sum"), F.col("posterior"))
    spread = sign * w.support * 2.0 * F.col("support") - sign * F.col("base_penalty")
    return state.withColumn("delta", after - now + spread)


def replace_gains(adds: DataFrame, removals: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Gain of moving an owned bin to another candidate cell: its add plus the owner's remove delta."""
    owner = removals.select(*scope, "barcode", F.col("cell_id").alias("old_cell_id"), F.col("delta").alias("_remove"))
    return adds.join(owner, [*scope, "barcode"]).filter(F.col("cell_id") != F.col("old_cell_id")).select(
        *scope, "barcode", "cell_id", "old_cell_id", (F.col("delta") + F.col("_remove")).alias("replace_gain"))


def within(radius_um: float, distance: str = "dist_um") -> Column:
    """Bins whose centre distance is within the radius, with the tolerance of the competition."""
    return F.coalesce(F.col(distance) * F.col(distance) <= radius_um * radius_um + 1.0e-8, F.lit(False))


def competitors(patch_candidates: DataFrame, radius_um: float, of: DataFrame | None = None) -> DataFrame:
    """Other cells of the patch that hold the same bin and whose centre is within the radius of it.

    ``of`` restricts the rows that look for competitors, such as the legal ones. A patch
    holds at most its cell cap, so one (patch, bin) key joins at most cap rows.
    """
    other = patch_candidates.select("patch_id", "barcode", F.col("cell_id").alias("other_id"), F.col("dist_um").alias("_d"))
    mine = (patch_candidates if of is None else of).select("patch_id", "barcode", "cell_id")
    return mine.join(other, ["patch_id", "barcode"]).filter(
        (F.col("cell_id") != F.col("other_id")) & within(radius_um, "_d")).select("patch_id", "barcode", "cell_id", "other_id")


def competition_margins(scored: DataFrame, radius_um: float, w: Weights, margin_weight: float, clip: float, shape: str | None = None) -> DataFrame:
    """Margin of every legal bin over its best competitor, and the adjusted score.

    Entries are the legal bins plus their competitors, cells with the bin within the radius.
    Nothing is paired: a bin's best other entry is the best near one or, for that one, the
    second best. A (patch, bin) holds at most the patch's cell cap; z-scores run over all
    entries of the patch. Rows dealt by patch are not exchanged again.
    """
    terms = ["gain_raw"] + ([shape] if shape else [])
    base = scored.select("patch_id", "cell_id", "barcode", *terms, "base_penalty", "is_legal", "add_score", within(radius_um).alias("_near"))
    same_patch, same_bin = Window.partitionBy("patch_id"), Window.partitionBy("patch_id", "barcode")
    legal = F.col("is_legal").cast("int")
    entries = base.withColumn("_others", F.sum(legal).over(same_bin) - legal).filter("is_legal or (_near and _others > 0)")
    # over a window, not joined: an aggregate would read the entries twice
    entries = entries.withColumns({f"_{n}_{c}": f(c).over(same_patch) for c in terms for n, f in (("m", F.avg), ("s", F.stddev_pop))})
    z = lambda c: st.zscore_guarded(F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}"), w.zscore_delta)
    score = w.gain * z("gain_raw") - F.col("base_penalty")
    if shape:
        score = score + w.shape * z(shape)
    rated = entries.select("patch_id", "cell_id", "barcode", "is_legal", "add_score", "_near", score.alias("entry_score"))
    best_first = same_bin.orderBy(F.desc("_near"), F.desc("entry_score"), "cell_id")
    whole = best_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near_score = F.when(F.col("_near"), F.col("entry_score"))
    ranked = rated.select("*", F.row_number().over(best_first).alias("_rn"), F.first(near_score).over(whole).alias("_best"),
                          F.nth_value(near_score, 2).over(whole).alias("_second"))
    other = F.when(F.col("_near") & (F.col("_rn") == 1), F.col("_second")).otherwise(F.col("_best"))
    margin = F.coalesce(st.clip(F.col("entry_score") - other, -clip, clip), F.lit(0.0))
    return ranked.filter("is_legal").select("patch_id", "cell_id", "barcode", "add_score", margin.alias("margin")).select(
        "*", (F.col("add_score") + margin_weight * F.col("margin")).alias("adjusted_score"), st.clip(F.col("margin") / 5.0, -1.0, 1.0).alias("margin_feature"))


@dataclass(frozen=True)
class EvidenceWeights:
    """Terminal evidence weights."""

    reward: float = 1.0
    growth: float = 0.7
    stop: float = 0.5
    overgrowth: float = 0.8
    compact: float = 0.25
    tau: float = 0.0
    temperature: float = 0.2
    shape: float = 0.25


def evidence(summary: DataFrame, e: EvidenceWeights, shape_topk: str | None = None) -> DataFrame:
    x = st.clip((F.col("frontier_topk") - e.tau) / max(e.temperature, 1.0e-8), -60.0, 60.0)
    quality = F.when(F.col("n_frontier") > 0, st.sigmoid(x)).otherwise(F.lit(0.0))
    out = summary.withColumn("frontier_quality", quality)
    shape = F.tanh(F.col(shape_topk)) if shape_topk else F.lit(0.0)
    return out.withColumns({"overgrowth_risk": F.col("grow_ratio") * (1.0 - F.col("frontier_quality")), "shape_quality": shape})


def episode_scores(states: DataFrame, e: EvidenceWeights) -> DataFrame:
    """Terminal score from evidence plus ``mean_step_reward`` and ``stopped``."""
    q, risk = st.clip(F.col("frontier_quality"), 0.0, 1.0), F.greatest("overgrowth_risk", F.lit(0.0))
    stop = F.when(F.col("stopped"), 1.0 - 2.0 * q + risk).otherwise(q - risk)
    total = (e.reward * F.col("mean_step_reward") + e.growth * F.col("frontier_quality") + e.stop * stop
             - e.overgrowth * F.col("overgrowth_risk") + e.compact * F.col("compactness") + e.shape * F.col("shape_quality"))
    return states.withColumns({"stop_evidence": stop, "episode_score": total})
