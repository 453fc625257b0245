"""Scoring of a state, competition and growth."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.operators import expression as ex, growth as gr, logs as lg, scoring as sc

CONTEXT = ("patch_id string, cell_id long, cell_rank long, barcode string, matrix_col_index long, array_row int, array_col int, x_um double, y_um double, "
           "center_x_um double, center_y_um double, dist_um double, is_seed boolean, bin_total long, ll array<double>, expr_conf double, base_penalty double")


def patch(spark, n_cells=4, radius=3.2, seed=0, share_seed=False):
    """Cells on a line with overlapping discs of bins and random likelihoods."""
    rng = np.random.default_rng(seed)
    ll = {(r, c): rng.normal(-3, 0.4, 3) for r in range(-8, 9) for c in range(-8, 8 + 5 * n_cells)}
    rows = []
    for k in range(n_cells):
        cx, cy = 5.0 * k, 0.0
        for (r, c), v in sorted(ll.items()):
            d = math.hypot(c - cx, r - cy)
            if d <= radius:
                s = d <= 1.0 or (share_seed and (r, c) == (0, 3) and k < 2)
                rows.append(("p", 10 + k, k, f"s_002um_{r + 20:05d}_{c + 20:05d}-1", (r + 20) * 1000 + c, r, c, float(c), float(r), cx, cy, d, s, 7, [float(x) for x in v], 0.6, 0.02 * d))
    return rows, spark.createDataFrame(rows, CONTEXT)


def loop_growth(rows, w, max_steps=1000):
    """Plain per-step recomputation of everything, for comparison."""
    cells = {}
    for r in rows:
        cells.setdefault(r[1], []).append(r)
    owner, member = {}, {}
    for cid in cells:
        member[cid] = set()
        for r in cells[cid]:
            if r[12] and r[3] not in owner:
                owner[r[3]] = cid
                member[cid].add(r[3])
    steps = []
    for step in range(max_steps):
        best = None
        for cid, bins in cells.items():
            pos = {b[3]: (b[5], b[6]) for b in bins}
            held = {pos[b] for b in member[cid]}
            support = [sum((b[5] + i, b[6] + j) in held for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j) / 8 for b in bins]
            legal = [b[3] not in member[cid] and (s > 0 or not held) and b[3] not in owner for b, s in zip(bins, support)]
            if not any(legal):
                continue
            ll, conf = np.array([b[14] for b in bins]), np.array([b[15] for b in bins])
            s0 = ll[[b[3] in member[cid] for b in bins]].sum(axis=0)
            soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
            p = soft(s0)
            gain = conf * (np.array([soft(s0 + x).max() for x in ll]) - p.max())
            old = conf * (ll @ p)
            z = lambda v: (v - v[legal].mean()) / (v[legal].std() + w.zscore_delta)
            score = w.gain * z(gain) + w.compatibility * z(old) - np.array([b[16] for b in bins]) + w.support * np.array(support)
            score = np.where(legal, score, -np.inf)
            i = int(score.argmax())
            if best is None or score[i] > best[0] + 1e-12:
                best = (score[i], cid, bins[i][3])
        if best is None or best[0] <= 0:
            break
        owner[best[2]] = best[1]
        member[best[1]].add(best[2])
        steps.append((step, best[1], best[2]))
    return steps, owner


def test_growth_equals_plain_loop_and_replays(spark):
    rows, df = patch(spark, share_seed=True)
    grown = gr.grow_patches(df).cache()
    steps, owner = loop_growth(rows, sc.Weights())
    got = [(r.step_index, r.cell_id, r.barcode) for r in grown.filter("kind = 'step'").orderBy("step_index").collect()]
    assert got == steps and len(steps) > 5
    owners = {r.barcode: r.cell_id for r in gr.final_owners(grown).collect()}
    assert owners == owner
    summary = grown.filter("kind = 'summary'").first()
    assert summary.n_conflicts == 1 and summary.stop_reason in ("no_positive_add_score", "no_legal_frontier")
    log = grown.filter("kind = 'step'").select(F.lit(1).cast("long").alias("episode_id"), "barcode", "cell_id", (F.col("step_index") + 1).alias("step_index"), F.lit(True).alias("applied"))
    initial = grown.filter("kind = 'seed'").select(F.lit(1).cast("long").alias("episode_id"), "barcode", "cell_id")
    assert {r.barcode: r.cell_id for r in lg.owners_at_step(initial, log, 10 ** 6).collect()} == owner


def test_contested_bin_goes_to_higher_score_and_seeds_are_kept(spark):
    base = lambda cid, rank, bc, col, seed: ("p", cid, rank, bc, col, 0, col, float(col), 0.0, 0.0, 0.0, 1.0, seed, 1, [0.0, 0.0], 1.0, 0.0)
    df = spark.createDataFrame([base(1, 0, "sa", 0, True), base(1, 0, "shared", 1, False), base(2, 1, "sb", 2, True), base(2, 1, "shared", 1, False)], CONTEXT)

    def fixed(cell, legal, step):
        return np.full(len(legal), 0.9 if cell.cell_id == 2 else 0.2)

    out = gr.grow_patches(df, score=fixed)
    assert {r.barcode: r.cell_id for r in gr.final_owners(out).collect()} == {"sa": 1, "sb": 2, "shared": 2}
    assert out.filter("kind = 'summary'").first().n_contested == 1
    owned = spark.createDataFrame([base(1, 0, "sa", 0, True), base(2, 1, "sa", 0, False), base(2, 1, "sb", 1, True)], CONTEXT)
    out = gr.grow_patches(owned, score=fixed)
    assert {r.barcode: r.cell_id for r in gr.final_owners(out).collect()} == {"sa": 1, "sb": 2}
    assert out.filter("kind = 'summary'").first().n_blocked > 0


def test_nearest_and_first_come_seed_rules(spark):
    p = spark.createDataFrame([("b", 5, 1.0, 2), ("b", 7, 0.5, 9), ("c", 5, 1.0, 2)], "barcode string, cell_id long, dist_um double, rank long")
    assert {r.barcode: r.cell_id for r in sc.nearest_seed_owner(p).collect()} == {"b": 7, "c": 5}
    assert {r.barcode: (r.cell_id, r.n_conflicts) for r in sc.first_come_seed_owner(p, "rank").collect()} == {"b": (5, 1), "c": (5, 0)}


def test_likelihood_is_zero_for_empty_bins(spark):
    genes = spark.createDataFrame([("g0", 0), ("g1", 1)], "gene string, matrix_feature_index long")
    counts = spark.createDataFrame([("A", "g0", 9), ("A", "g1", 1), ("B", "g1", 5)], "cell_type string, gene string, count long")
    theta = ex.log_theta(counts, genes, ["A", "B"], 0.5)
    expr = spark.createDataFrame([("b0", "g0", 2), ("b0", "g1", 1), ("b1", "g1", 3), ("b2", "other", 5)], "barcode string, gene string, cnt long")
    bins = spark.createDataFrame([("b0",), ("b1",), ("b2",)], "barcode string")
    out = {r.barcode: r for r in ex.complete_bins(bins, ex.bin_likelihoods(expr, theta, 2), 2, 5.0).collect()}
    assert [out[f"b{i}"].bin_total for i in range(3)] == [3, 3, 0] and out["b2"].ll == [0.0, 0.0] and out["b2"].expr_conf == 0.0
    assert out["b0"].ll[0] == pytest.approx((2 * math.log(9.5 / 11) + math.log(1.5 / 11)) / 3)
    assert out["b1"].ll[1] == pytest.approx(math.log(5.5 / 6)) and out["b1"].expr_conf == pytest.approx(3 / 8)


def test_likelihood_blocks_divide_a_gene_of_every_bin(spark):
    genes = spark.createDataFrame([(f"g{i}",) for i in range(20)], "gene string")
    counts = spark.createDataFrame([(t, f"g{i}", 1 + (i * k) % 7) for k, t in enumerate("ABC", 2) for i in range(20) if i % k], "cell_type string, gene string, count long")
    theta = ex.log_theta(counts, genes, ["A", "B", "C"], 0.5)
    expr = spark.range(4000).select(F.concat(F.lit("b"), "id").alias("barcode"), F.explode(F.array(F.lit("g0"), F.concat(F.lit("g"), (F.col("id") % 19 + 1).cast("string")))).alias("gene"), (F.col("id") % 5 + 1).alias("cnt"))
    rows = lambda df: sorted((r.barcode, r.bin_total, *[round(v, 9) for v in r.ll]) for r in df.collect())
    assert rows(ex.bin_likelihoods(expr, theta, 3, broadcast_bytes=0, block_rows=500)) == rows(ex.bin_likelihoods(expr, theta, 3))
    keys = [r["count"] for r in ex.blocked_genes(expr, theta, 500).filter("gene = 'g0'").groupBy("_block").count().collect()]
    assert len(keys) == 8 and max(keys) <= 2 * sorted(keys)[4]
    assert ex.bin_likelihoods(expr.limit(0), theta, 3, broadcast_bytes=0).count() == 0


def state_of(spark, rows_df):
    marked = sc.with_support(rows_df, rows_df.filter("is_seed"), ["cell_id"])
    return sc.with_raw_terms(sc.with_frontier(marked, sc.cell_sums(marked, ["cell_id"], 3), ["cell_id"]))


def test_add_delta_equals_recomputed_objective(spark):
    rows, df = patch(spark, n_cells=1)
    w = sc.Weights()
    state = state_of(spark, df)
    deltas = sc.objective_deltas(state, w)
    before = sc.cell_objective(state.dropDuplicates(["cell_id"]), ["cell_id"], w).first().objective
    spot = deltas.filter("is_frontier").orderBy("barcode").first()
    grown = df.withColumn("is_seed", F.col("is_seed") | (F.col("barcode") == spot.barcode))
    after = sc.cell_objective(state_of(spark, grown).dropDuplicates(["cell_id"]), ["cell_id"], w).first().objective
    assert after - before == pytest.approx(spot.delta, abs=1e-9)
    back = sc.objective_deltas(state_of(spark, grown), w).filter(F.col("barcode") == spot.barcode).first()
    assert back.delta == pytest.approx(-spot.delta, abs=1e-9)


def test_unrolled_terms_equal_array_terms(spark):
    _, df = patch(spark, n_cells=2)
    s = state_of(spark, df).withColumns({"g": sc.posterior_gain(), "c": sc.compatibility()})
    worst = s.agg(F.max(F.abs(F.col("g") - F.col("gain_raw"))).alias("a"), F.max(F.abs(F.col("c") - F.col("compat_raw"))).alias("b")).first()
    assert worst.a < 1e-12 and worst.b < 1e-12


def test_competition_margin(spark):
    df = spark.createDataFrame([("p", 1, "b", 0.0, 1.0, True, -1.0, 2.0), ("p", 2, "b", 0.0, 0.0, True, 0.0, 2.0)], "patch_id string, cell_id long, barcode string, gain_raw double, base_penalty double, is_legal boolean, add_score double, dist_um double")
    w = sc.Weights()
    near = {r.cell_id: r for r in sc.competition_margins(df, 20.0, w, 0.25, 5.0).collect()}
    assert near[1].adjusted_score == pytest.approx(-1.25) and near[2].adjusted_score == pytest.approx(0.25)
    assert near[1].margin_feature == pytest.approx(-0.2) and near[2].margin_feature == pytest.approx(0.2)
    far = {r.cell_id: r.adjusted_score for r in sc.competition_margins(df, 1.0, w, 0.25, 5.0).collect()}
    assert far == {1: -1.0, 2: 0.0}


def test_reachable_bins_stop_at_gaps(spark):
    rows = [(1, f"b{c}", 0, c, c == 0) for c in (0, 1, 2, 4, 5)] + [(2, "x", 0, 0, False)]
    df = spark.createDataFrame(rows, "cell_id long, barcode string, array_row int, array_col int, is_seed boolean")
    assert {r.barcode for r in gr.reachable_bins(df, ["cell_id"]).collect()} == {"b0", "b1", "b2"}


def test_joint_round_conflicts_and_rollback(spark):
    props = spark.createDataFrame([("p", 10, "b", 0.5, 0, 0), ("p", 11, "b", 0.9, 0, 1), ("p", 10, "c", -1.0, 1, 0), ("p", 11, "c", 0.4, 1, 1)], "patch_id string, cell_id long, barcode string, delta double, round int, cell_rank long")
    n = spark.createDataFrame([("p", 2)], "patch_id string, n_cells long")
    kept, rounds = gr.joint_rounds(props, n)
    assert {(r.round, r.cell_id) for r in kept.collect()} == {(0, 10), (1, 11)}
    assert {r.round: r.accepted for r in rounds.collect()} == {0: True, 1: True}


def test_transcriptomic_score_prefers_near_and_similar(spark):
    ctx = spark.createDataFrame([(1, "seed", 0.0, 0.0, 0.0, True), (1, "near", 2.0, 0.0, 2.0, False), (1, "far", 12.0, 0.0, 12.0, False)], "cell_id long, barcode string, x_um double, y_um double, dist_um double, is_seed boolean")
    expr = spark.createDataFrame([("seed", "g0", 10), ("seed", "g1", 1), ("near", "g0", 9), ("near", "g1", 1), ("far", "g2", 9)], "barcode string, gene string, cnt long")
    members = spark.createDataFrame([("p", 1)], "patch_id string, cell_id long")
    s = {r.barcode: r.score for r in ex.transcriptomic_scores(ctx, expr, members, 1.0e4, 0.1, 2.0).collect()}
    assert s["near"] > s["far"] and s["seed"] > s["far"]


def test_type_without_selected_genes_is_flat(spark):
    from cellweave.operators import expression as ex
    genes = spark.createDataFrame([("g1",), ("g2",)], "gene string")
    counts = spark.createDataFrame([("t1", "g1", 3)], "cell_type string, gene string, count long")
    got = {r.gene: r.log_theta for r in ex.log_theta(counts, genes, ["t1", "t2"], 1.0).collect()}
    assert all(abs(v[1] - math.log(0.5)) < 1e-12 for v in got.values()) and abs(got["g1"][0] - math.log(4 / 5)) < 1e-12


def test_overlap_sees_centres_outside_the_band(spark):
    from cellweave.operators import spatial_join as sj
    discs = spark.createDataFrame([("b", 1, 10.0, 10.0), ("b", 2, 4.0, 10.0)], "barcode string, cell_id long, dist_um double, radius_um double")
    discs = discs.withColumns({c: F.lit(0.0) for c in ("matrix_col_index", "array_row", "array_col", "x_um", "y_um", "center_x_um", "center_y_um")})
    meta = spark.createDataFrame([("b", False, False, None)], "barcode string, has_nuclear_annotation boolean, ambiguous_nuclear_assignment boolean, dominant_cell_id long")
    ll = spark.createDataFrame([("b", 3, [0.0], 0.5)], "barcode string, bin_total long, ll array<double>, expr_conf double")
    row, = sc.build_context(sj.in_band(discs, 2.0), meta, ll, sc.Weights(), discs).collect()
    assert row.cell_id == 1 and abs(row.p_overlap - 0.3) < 1e-9


def test_margin_equals_the_pairwise_form(spark):
    import random
    rnd = random.Random(5)
    rows = [(p, c, b, rnd.random(), rnd.random(), rnd.random() < 0.6, rnd.random(), rnd.choice([3.0, 9.0, 15.0, 18.0]))
            for p in ("p1", "p2") for b in "abcdef" for c in range(1, 7) if rnd.random() < 0.7]
    df = spark.createDataFrame(rows, "patch_id string, cell_id long, barcode string, gain_raw double, base_penalty double, is_legal boolean, add_score double, dist_um double")
    w = sc.Weights()
    got = {(r.patch_id, r.cell_id, r.barcode): r.margin for r in sc.competition_margins(df, 15.0, w, 0.25, 5.0).collect()}
    want = {}
    for p in ("p1", "p2"):
        mine = [r for r in rows if r[0] == p]
        used = [r for r in mine if r[5] or r[7] <= 15.0 and any(o[5] and o[2] == r[2] and o[1] != r[1] for o in mine)]
        mean = sum(r[3] for r in used) / len(used)
        std = (sum((r[3] - mean) ** 2 for r in used) / len(used)) ** 0.5
        score = {(r[1], r[2]): w.gain * (r[3] - mean) / (std + w.zscore_delta) - r[4] for r in used}
        for r in used:
            if r[5]:
                others = [score[o[1], o[2]] for o in used if o[2] == r[2] and o[1] != r[1] and o[7] <= 15.0]
                want[p, r[1], r[2]] = max(-5.0, min(5.0, score[r[1], r[2]] - max(others))) if others else 0.0
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_shape_term_moves_margins(spark):
    rows = [("p", 1, "b", 0.0, 0.0, True, 1.0, 1.0, 2.0), ("p", 2, "b", 0.0, 0.0, True, 1.0, 1.0, 0.0)]
    scored = spark.createDataFrame(rows, "patch_id string, cell_id long, barcode string, gain_raw double, base_penalty double, is_legal boolean, add_score double, dist_um double, shape double")
    w = sc.Weights()
    plain = {r.cell_id: r.margin for r in sc.competition_margins(scored, 15.0, w, 0.25, 5.0).collect()}
    shaped = {r.cell_id: r.margin for r in sc.competition_margins(scored, 15.0, w, 0.25, 5.0, shape="shape").collect()}
    assert plain == {1: 0.0, 2: 0.0}
    assert shaped[1] == pytest.approx(2 * w.shape) and shaped[2] == pytest.approx(-2 * w.shape)


def test_leading_components_match_all_rows(spark):
    """Distances in two components against an eigenbasis of the stacked rows, bins repeated per cell."""
    rng = np.random.default_rng(5)
    counts = {f"b{i}": {f"g{j}": int(v) for j, v in enumerate(rng.poisson(2.0, 5)) if v} for i in range(12)}
    counts["b11"] = {}
    held = {1: [f"b{i}" for i in range(8)], 2: [f"b{i}" for i in range(5, 12)]}
    seeds = {1: ["b0", "b1"], 2: []}
    context = spark.createDataFrame([(c, b, b in seeds[c], float(int(b[1:])), 0.0, 1.0 + int(b[1:])) for c, bs in held.items() for b in bs],
                                    "cell_id long, barcode string, is_seed boolean, x_um double, y_um double, dist_um double")
    expression = spark.createDataFrame([(b, g, v) for b, e in counts.items() for g, v in e.items()], "barcode string, gene string, cnt long")
    members = spark.createDataFrame([("p", 1), ("p", 2)], "patch_id string, cell_id long")

    raw = {b: np.array([e.get(f"g{j}", 0) for j in range(5)], float) for b, e in counts.items()}
    pairs = [(c, b) for c, bs in held.items() for b in bs]
    stacked = np.array([raw[b] for _, b in pairs])
    kept = sorted(sorted(range(5), key=lambda j: (-stacked[:, j].var(), j))[:3])
    rows = np.vstack([stacked, *[np.mean([raw[b] for b in (seeds[c] or held[c])], axis=0) for c in held]])[:, kept]
    total = rows.sum(axis=1, keepdims=True)
    logs = np.log1p(rows * np.where(total > 0, 100.0 / np.where(total > 0, total, 1), 0))
    centred = logs - logs.mean(axis=0)
    z = centred @ np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :2]
    profile = {c: z[len(pairs) + i] for i, c in enumerate(held)}
    t = np.log(np.maximum([((z[i] - profile[c]) ** 2).sum() for i, (c, _) in enumerate(pairs)], 1e-8))
    near = [min((abs(int(b[1:]) - int(s[1:])) for s in seeds[c]), default=1 + int(b[1:])) / 2.0 for c, b in pairs]
    want = {k: -((v - t.min()) / (t.max() - t.min()) + 0.1 * d) for k, v, d in zip(pairs, t, near)}
    got = {(r.cell_id, r.barcode): r.score for r in ex.component_scores(context, expression, members, 3, 2, 100.0, 0.1, 2.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
