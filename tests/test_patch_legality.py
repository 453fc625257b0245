"""Legal bins of patches from lists per cell, against their definition; joint rounds without further exchanges."""

import re

import numpy as np
import pytest

import __spark_entry__ as entry
from cellweave.catalog import steps
from cellweave.operators import growth as gr
from cellweave.workspace import Workspace, forget_workspaces

SF = "/root/testdata/sf0.001"


@pytest.fixture
def made(spark):
    """Cells that hold bins of each other's frontier, in patches that leave some of the holders out."""
    rng = np.random.default_rng(8)
    scored = [(c, f"b{i}", i, float(i), 0.0, held, not held and bool(rng.random() < 0.7), 0.5, 0.1, float(rng.normal()), float(rng.normal()))
              for c in range(8) for i in range(20) for held in [bool(rng.random() < 0.15)] for _ in range(2 if (c, i) == (3, 4) else 1)]
    members = [(f"p{p}", c, "core") for p in range(6) for c in range(8) if rng.random() < 0.5]
    patches = [(f"p{p}", float(p), float(p) + 12.0, -1.0, 1.0) for p in range(6)]
    ws = Workspace(spark, SF)
    ws._tables |= {
        "scored": spark.createDataFrame(scored, "cell_id long, barcode string, matrix_col_index long, x_um double, y_um double, is_assigned boolean, is_frontier boolean, support double, base_penalty double, gain_raw double, compat_raw double"),
        "patch_members": spark.createDataFrame(members, "patch_id string, cell_id long, role string"),
        "patches": spark.createDataFrame(patches, "patch_id string, outer_x_min double, outer_x_max double, outer_y_min double, outer_y_max double")}
    owned = {(p, r[1]) for p, c, _ in members for r in scored if r[0] == c and r[5]}
    box = {p: (a, b) for p, a, b, *_ in patches}
    want = sorted((p, c, r[1], r[6], r[6] and (p, r[1]) not in owned and box[p][0] <= r[3] <= box[p][1]) for p, c, _ in members for r in scored if r[0] == c)
    return ws, want, members


def test_legality_equals_its_definition(made):
    ws, want, members = made
    got = steps.placed_rows(ws, ws["scored"].select("cell_id", "barcode", "x_um", "y_um", "is_frontier"))
    assert sorted(tuple(r) for r in got.select("patch_id", "cell_id", "barcode", "is_frontier", "is_legal").collect()) == want
    legal = [w for w in want if w[4]]
    assert len(legal) > 40 and any(w[3] and not w[4] for w in want)
    rows = ws["patch_legal"].collect()
    assert sorted((r.patch_id, r.cell_id, r.barcode) for r in rows) == [w[:3] for w in legal]
    sizes = {p: sum(m[0] == p for m in members) for p, _, _ in members}
    ranks = {(p, c): sorted(m[1] for m in members if m[0] == p).index(c) for p, c, _ in members}
    assert all(r.n_cells == sizes[r.patch_id] and r.cell_rank == ranks[r.patch_id, r.cell_id] for r in rows)


def test_joint_rounds_take_carried_sizes(spark):
    props = spark.createDataFrame([("p", 10, "b", 0.5, 0, 0, 2), ("p", 11, "b", 0.9, 0, 1, 2), ("p", 10, "c", -1.0, 1, 0, 2), ("p", 11, "c", 0.4, 1, 1, 2)],
                                  "patch_id string, cell_id long, barcode string, delta double, round int, cell_rank long, n_cells long")
    kept, rounds = gr.joint_rounds(props, eps=0.0)
    assert {(r.round, r.cell_id) for r in kept.collect()} == {(0, 10), (1, 11)} and all(r.accepted for r in rounds.collect())


def test_patch_rows_are_dealt_once_or_not_at_all(spark):
    forget_workspaces()
    try:
        shown = {q: entry.queries()[q](spark, SF)._jdf.queryExecution() for q in ("g4_patch_legal", "g23_joint_rounds")}
        plan = shown["g4_patch_legal"].sparkPlan().toString()
        assert "REPARTITION_BY_COL" not in plan and not re.search(r"windowspecdefinition\(patch_id#\d+, barcode", plan)
        plan = shown["g23_joint_rounds"].sparkPlan().toString()
        assert plan.count("REPARTITION_BY_COL") == 1
        # above the exchange of patch rows there is no join, hence no other one
        assert "Join" not in plan[:plan.index("REPARTITION_BY_COL")]
    finally:
        forget_workspaces()
