"""Shape changes from lists per cell: no candidate is joined by its position or barcode."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellweave import workspace as wsm
from cellweave.operators import grid, shape as sh

SF = "/root/testdata/sf0.001"


def drawn():
    rng = np.random.default_rng(11)
    shapes = {k: sorted({(int(x) - 3, int(y) - 2) for x, y in rng.integers(0, 6, (1 + k % 12, 2))}) for k in range(24)}
    shapes[24], shapes[25] = [(0, 0), (1, 1), (2, 2)], [(4, 0), (4, 3)]
    return shapes, {k: sorted({(int(x) - 4, int(y) - 4) for x, y in rng.integers(0, 9, (9, 2))} - set(v)) for k, v in shapes.items()}


@pytest.fixture(scope="module")
def objects(spark):
    shapes, extra = drawn()
    rows = [(k, f"b{x}_{y}", x, y, kind) for src, kind in ((shapes, True), (extra, False)) for k, v in src.items() for x, y in v]
    cand = spark.createDataFrame(rows, "cell_id long, barcode string, gx int, gy int, _occupied boolean")
    return shapes, extra, cand, sh.shape_states(cand.filter("_occupied"), ["cell_id"], "gx", "gy")


def test_added_squares_equal_whole_shapes(spark, objects):
    shapes, extra, cand, states = objects
    whole = spark.createDataFrame([(f"{k}/b{x}_{y}", a, b) for k, v in extra.items() for x, y in v for a, b in [*shapes[k], (x, y)]], "key string, gx int, gy int")
    want = {r.key: r for r in sh.shape_features(sh.shape_states(whole, ["key"], "gx", "gy"), ["key"]).collect()}
    after = sh.features_after_adding(states, cand, ["cell_id"], "gx", "gy")
    got = {f"{r.cell_id}/{r.barcode}": r for r in after.collect()}
    assert got.keys() == want.keys() and len(got) > 150
    for k, r in got.items():
        assert (r.new_area, r.new_perimeter, r.new_hull) == (want[k].area, want[k].perimeter, want[k].convex_hull_area)
        assert r.new_solidity == want[k].solidity and r.new_anisotropy == pytest.approx(want[k].anisotropy) and r.new_compactness == pytest.approx(want[k].compactness)
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(barcode|gx)#\d+L? = (barcode|gx)#\d+", plan)


def test_rows_of_one_barcode_meet_each_other(spark):
    cand = spark.createDataFrame([(1, "s", 0, 0, True), (1, "s", 0, 0, True), (1, "t", 1, 0, False), (1, "t", 1, 0, False), (1, "u", 5, 0, False)], "cell_id long, barcode string, gx int, gy int, _occupied boolean")
    states = sh.shape_states(cand.filter("_occupied"), ["cell_id"], "gx", "gy")
    rows = lambda hull: sorted((r.barcode, r.new_area, r.new_perimeter) for r in sh.features_after_adding(states, cand, ["cell_id"], "gx", "gy", with_hull=hull).collect())
    assert rows(True) == [("t", 2, 0)] * 4 + [("u", 2, 8)] and rows(False) == [("t", 2, 0)] * 2 + [("u", 2, 8)]


def test_states_of_places_equal_states_of_squares(objects):
    _, _, cand, states = objects
    held = cand.filter("_occupied").groupBy("cell_id").agg(F.sort_array(F.collect_list(grid.place(F.col("gy"), F.col("gx")))).alias("held"))
    got = sh.states_of_places(held.unionByName(held.select((F.col("cell_id") + 100).alias("cell_id"), F.slice("held", 1, 0).alias("held"))), ["cell_id"], "held")
    assert sorted(got.columns) == sorted(states.columns)
    assert sorted(map(tuple, got.select(*states.columns).collect())) == sorted(map(tuple, states.collect()))


def run_cold(spark, name):
    written = []
    original = wsm.write_stage
    wsm.write_stage = lambda df, label: written.append(label) or original(df, label)
    wsm.forget_workspaces()
    try:
        df = entry.queries()[name](spark, SF)
        assert df.count() > 0
        return written, df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        wsm.write_stage = original
        wsm.forget_workspaces()


def test_evidence_scores_logged_cells_only(spark):
    written, _ = run_cold(spark, "g21_evidence_with_shape")
    assert "scored" not in written and "step_log" in written


def test_shaped_scores_read_the_written_frontier(spark):
    """Terms come from the written scores; their candidates are joined by cell alone."""
    written, plan = run_cold(spark, "g9_add_score_with_shape")
    assert "scored" in written and "seed_states" not in written and not re.search(r"barcode#\d+ = barcode#\d+", plan)
    assert "Generate explode" in plan and "hulls_with_square" not in plan
