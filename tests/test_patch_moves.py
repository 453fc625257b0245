"""Bytes that patch rows may move: dealt by patch once, never written."""

import re

import __spark_entry__ as entry
from cellweave import workspace as wsm

SF = "/root/testdata/sf0.001"


def test_margins_move_patch_rows_once(spark):
    written = []
    original = wsm.write_stage
    wsm.write_stage = lambda df, label, **how: written.append(label) or original(df, label, **how)
    wsm.forget_workspaces()
    try:
        df = entry.queries()["g17_competition_margin"](spark, SF)
        assert df.count() > 0
    finally:
        wsm.write_stage = original
        wsm.forget_workspaces()
    assert "patch_scored" not in written and "scored" in written
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    moved = df._jdf.queryExecution().executedPlan().toString()
    # cells to patches may take two exchanges (members, scores); after that rows are dealt by patch
    assert moved.count("Exchange hashpartitioning(patch_id") <= 2


def test_summary_and_rewards_leave_wide_keys(spark):
    """Features meet what a cell holds by cell; each transition meets one table, by its action."""
    wsm.forget_workspaces()
    queries = entry.queries()
    plan = queries["g12_state_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"barcode#\d+ = barcode#\d+", plan)
    plan = queries["f2_transition_rewards"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "= add" in plan and "= stop" in plan
    wsm.forget_workspaces()


def test_scores_are_derived_from_cell_statistics(spark):
    """The stage holds raw terms and one set of statistics per cell; the scores are no written columns."""
    written = {}
    original = wsm.write_stage
    wsm.write_stage = lambda df, label: written.setdefault(label, df.columns) and original(df, label)
    wsm.forget_workspaces()
    try:
        entry.queries()["w6_top_k_mean"](spark, SF).count()
    finally:
        wsm.write_stage = original
        wsm.forget_workspaces()
    assert {"gain_raw", "_gm"} <= set(written["scored"]) and not {"gain_term", "compat_term", "add_score", "p_dis"} & set(written["scored"])


def test_counts_of_a_bin_lie_together(spark):
    from cellweave import fixtures
    plan = fixtures.expression(spark.read.parquet(f"{SF}/lineitem.parquet"))
    got = sorted(map(tuple, plan.collect()))
    want = sorted(map(tuple, fixtures.fixture(spark, "expression", {"lineitem": spark.read.parquet(f"{SF}/lineitem.parquet")}).collect()))
    assert got == want and plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(barcode") >= 1
