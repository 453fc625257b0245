"""Shape features, clusters, matching and patch comparison."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import evaluate as ev, patches as pt, shape as sh


def test_square_and_bar(spark):
    cells = spark.createDataFrame([("a", x, y) for x in (0, 1) for y in (0, 1)] + [("b", x, 5) for x in (3, 4, 5)], "cell_id string, x int, y int")
    out = {r.cell_id: r for r in sh.shape_features(sh.shape_states(cells, ["cell_id"], "x", "y"), ["cell_id"]).collect()}
    assert (out["a"].area, out["b"].area, out["a"].perimeter, out["b"].perimeter) == (4, 3, 8, 8)
    assert out["a"].perimeter_um == 16 and out["a"].log_area == pytest.approx(math.log(5)) and out["a"].compactness == pytest.approx(math.pi / 4)
    assert out["a"].solidity == 1 and out["a"].anisotropy == 1 and out["b"].anisotropy > 1


def test_hull_of_random_shapes(spark):
    rng = np.random.default_rng(4)
    shapes = {k: {(int(x), int(y)) for x, y in rng.integers(0, 7, (rng.integers(3, 18), 2))} for k in range(25)}
    cells = spark.createDataFrame([(k, x, y) for k, s in shapes.items() for x, y in s], "cell_id long, x int, y int")
    got = {r.cell_id: r.convex_hull_area for r in sh.shape_features(sh.shape_states(cells, ["cell_id"], "x", "y"), ["cell_id"]).collect()}

    def gift_wrap(pts):
        pts, start = sorted(pts), min(pts)
        ring, p = [], start
        while True:
            ring.append(p)
            q = pts[0] if pts[0] != p else pts[1]
            for s in pts:
                cross = (q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0])
                if s != p and (cross < 0 or (cross == 0 and (s[0] - p[0]) ** 2 + (s[1] - p[1]) ** 2 > (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2)):
                    q = s
            p = q
            if p == start:
                return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2

    for k, s in shapes.items():
        want = float(len(s)) if len(s) <= 2 else gift_wrap({(x + i, y + j) for x, y in s for i in (0, 1) for j in (0, 1)})
        assert got[k] == want


def test_incremental_shape_equals_full(spark):
    base = [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (2, 1), (1, 2), (2, 2)]
    extra = [(3, 1), (0, 2), (3, 3)]
    cand = spark.createDataFrame([(1, f"b{x}_{y}", x, y, (x, y) in base) for x, y in base + extra], "cell_id long, barcode string, gx int, gy int, _occupied boolean")
    state = sh.shape_states(cand.filter("_occupied"), ["cell_id"], "gx", "gy")
    after = {r.barcode: r for r in sh.features_after_adding(state, cand, ["cell_id"], "gx", "gy").collect()}
    for x, y in extra:
        full = spark.createDataFrame([(1, a, b) for a, b in base + [(x, y)]], "cell_id long, gx int, gy int")
        want = sh.shape_features(sh.shape_states(full, ["cell_id"], "gx", "gy"), ["cell_id"]).first()
        got = after[f"b{x}_{y}"]
        assert got.new_area == want.area and got.new_perimeter == want.perimeter
        for n in ("log_area", "compactness", "solidity", "anisotropy"):
            assert got[f"new_{n}"] == pytest.approx(want[n], rel=1e-9)


def test_merge_small_clusters(spark):
    rows = [(i, "a", [0.0 + i * 0.01, 0, 0, 0]) for i in range(4)] + [(i, "b", [5.0, 5.0, 0, 0]) for i in range(4, 8)] + [(8, "c", [4.5, 5.0, 0, 0])]
    m = spark.createDataFrame([(i, l, [float(v) for v in z]) for i, l, z in rows], "id long, lab string, z array<double>")
    sizes = sorted(r["count"] for r in sh.merge_small_clusters(m, "lab", 3).groupBy("merged_label").count().collect())
    assert sizes == [4, 5]
    assert sh.merge_small_clusters(m, "lab", 50).select("merged_label").distinct().count() == 3


def test_gaussian_model_matches_numpy(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(40, 4))
    m = spark.createDataFrame([(i, "u" if i % 2 else "v", [float(x) for x in z[i]]) for i in range(40)], "id long, lab string, z array<double>")
    model = {r.label: r for r in sh.fit_gaussians(sh.cluster_moments(m, "lab")).collect()}
    for k, rows in (("u", z[1::2]), ("v", z[0::2])):
        cov = np.cov(rows, rowvar=False) + 1e-4 * np.eye(4)
        assert np.allclose(np.array(model[k].cov).reshape(4, 4), cov) and model[k].prior == 0.5
        assert np.allclose(np.array(model[k].inv).reshape(4, 4), np.linalg.inv(cov + 1e-4 * np.eye(4)))
    df = spark.createDataFrame([(k, int(v.n), v.mean, v.cov, v.inv, v.logdet, v.prior) for k, v in model.items()], "label string, n long, mean array<double>, cov array<double>, inv array<double>, logdet double, prior double")
    got = {r.id: r for r in sh.score_against_clusters(m, df).collect()}
    for i in range(5):
        lls = {k: -0.5 * (4 * math.log(2 * math.pi) + v.logdet + (z[i] - v.mean) @ np.array(v.inv).reshape(4, 4) @ (z[i] - v.mean)) for k, v in model.items()}
        assert got[i].best_cluster == max(lls, key=lls.get) and got[i].best_log_likelihood == pytest.approx(max(lls.values()))
        assert got[i].mixture_log_likelihood == pytest.approx(math.log(sum(0.5 * math.exp(v) for v in lls.values())))


def test_matching_ties_take_the_largest_id(spark):
    src = spark.createDataFrame([("1", f"b{i}") for i in range(4)] + [("2", "z")], "cell_id string, barcode string")
    tgt = spark.createDataFrame([("9", "b0"), ("9", "b1"), ("10", "b2"), ("10", "b3"), ("7", "z")], "target_id string, barcode string")
    out = {r.cell_id: r for r in ev.match_by_nuclear_overlap(src, tgt).collect()}
    assert out["1"].matched_id == "9" and out["1"].overlap_bins == 2 and out["1"].overlap_frac == 0.5
    assert out["2"].matched_id is None and out["2"].overlap_bins == 0 and out["2"].match_method == "unmatched"


def test_overlap_metric_edge_cases(spark):
    pairs = spark.createDataFrame([("a", "p", "g"), ("b", None, "g"), ("c", "p", None), ("d", "q", "h")], "cell_id string, pred_id string, gt_id string")
    pred = spark.createDataFrame([("p", "b1"), ("p", "b2"), ("q", "b9")], "pred_id string, barcode string")
    gt = spark.createDataFrame([("g", "b2"), ("g", "b3")], "gt_id string, barcode string")
    out = {r.cell_id: r for r in ev.overlap_metrics(pairs, pred, gt).collect()}
    assert out["a"].pred_iou == pytest.approx(1 / 3) and out["a"].pred_f1 == 0.5
    assert out["b"].pred_iou == 0.0 and out["b"].pred_precision == 0.0 and out["c"].pred_iou is None
    assert out["d"].pred_iou == 0.0 and out["d"].pred_recall == 0.0


def test_patch_comparison(spark):
    """Five predicted and five true bins: foreground 4/6, owner accuracy 3/4, micro 3/7."""
    p = spark.createDataFrame([("p", c, b, 1.0, 1.0) for c, b in (("A", "b0"), ("A", "b1"), ("B", "b2"), ("B", "b3"), ("A", "b4"))], "patch_id string, cell_id string, barcode string, x_um double, y_um double")
    g = spark.createDataFrame([("p", b, c, 1, 1.0, 1.0) for c, b in (("ga", "b0"), ("ga", "b1"), ("gb", "b2"), ("ga", "b3"), ("gb", "b5"))], "patch_id string, barcode string, gt_id string, is_nuclear int, x_um double, y_um double")
    owner = spark.createDataFrame([("A", "ga"), ("B", "gb")], "pred_id string, gt_id string")
    boxes = spark.createDataFrame([("p", 0.0, 2.0, 0.0, 2.0)], "patch_id string, core_x_min double, core_x_max double, core_y_min double, core_y_max double")
    trace = p.filter("false")
    bins = ev.patch_bins(p, g, trace, owner, boxes)
    cells = ev.patch_cells(spark.createDataFrame([("p", "A"), ("p", "B")], "patch_id string, cell_id string"), p, g, owner)
    m = ev.patch_metrics(bins, cells).first()
    assert m.foreground_iou == pytest.approx(4 / 6) and m.owner_accuracy == pytest.approx(3 / 4) and m.owner_micro_iou == pytest.approx(3 / 7)
    assert (m.correct_owner_bins, m.wrong_owner_bins, m.pred_only_bins, m.gt_only_bins) == (3, 1, 1, 1)
    ious = {r.cell_id: r.patch_iou for r in cells.collect()}
    assert ious == {"A": pytest.approx(2 / 4), "B": pytest.approx(1 / 3)}


def test_tiles_cover_every_cell_in_some_core(spark):
    rng = np.random.default_rng(8)
    nuc = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 300, (120, 2)))], "cell_id long, center_x_um double, center_y_um double")
    patches, members = pt.build_patches(nuc, 64.0, 48.0, 30.0, max_cells=5)
    rows = members.collect()
    assert {r.cell_id for r in rows if r.role == "core"} == set(range(120))
    per = {}
    for r in rows:
        per.setdefault(r.patch_id, []).append(r)
    assert max(len(v) for v in per.values()) <= 5
    numbers = sorted(r.patch_number for r in patches.collect())
    assert numbers == list(range(len(numbers)))


def test_singular_and_tiny_clusters_have_finite_models(spark):
    rows = [("flat", [1.0, 2.0, 3.0, 4.0])] * 9 + [("tiny", [0.0, 1.0, 0.0, 2.0]), ("tiny", [1.0, 1.0, 0.5, 2.0])] + [("one", [5.0, 5.0, 5.0, 5.0])]
    m = spark.createDataFrame(rows, "lab string, z array<double>")
    model = {r.label: r for r in sh.fit_gaussians(sh.cluster_moments(m, "lab")).collect()}
    for r in model.values():
        cov = np.array(r.cov).reshape(4, 4) + 1e-4 * np.eye(4)
        assert np.allclose(np.array(r.inv).reshape(4, 4) @ cov, np.eye(4), atol=1e-6)
        assert np.isclose(r.logdet, np.linalg.slogdet(cov)[1])
    assert set(model) == {"flat", "tiny", "one"}


def test_summary_keeps_metrics_without_values(spark):
    df = spark.createDataFrame([(float("inf"), None), (1.0, None), (3.0, float("nan"))], "a double, b double")
    got = {r.metric: (r.mean, r.n_valid, r.median) for r in ev.metric_summary(df, ["a", "b"]).collect()}
    assert got == {"a": (2.0, 2, 2.0), "b": (None, 0, None)}
