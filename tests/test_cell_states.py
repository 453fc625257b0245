"""States from the cells' held bins against those spread over the candidate rows."""

import numpy as np

import __spark_entry__ as entry
from cellweave import workspace as wsm
from cellweave.operators import scoring as sc

SF = "/root/testdata/sf0.001"


def test_states_agree_with_spread_supports(spark):
    rng = np.random.default_rng(3)
    rows = [(c, f"b{r}_{k}", r, k, float(k), float(r), 3.0, 3.0, bool(c != 4 and rng.random() < 0.3), float(rng.random()), float(rng.random()), [float(v) for v in rng.normal(size=3)])
            for c in range(1, 5) for r in range(-2, 5) for k in range(-1, 6) if rng.random() < 0.9]
    context = spark.createDataFrame(rows, "cell_id long, barcode string, array_row int, array_col int, x_um double, y_um double, center_x_um double, center_y_um double, "
                                          "is_seed boolean, expr_conf double, base_penalty double, ll array<double>")
    marked = sc.with_support(context, context.filter("is_seed"), ["cell_id"])
    want = sc.with_frontier(marked, sc.cell_sums(marked, ["cell_id"], 3), ["cell_id"])
    cells = sc.cell_states(context, context.filter("is_seed"), ["cell_id"], 3)
    got = sc.with_cell_states(context, cells, ["cell_id"])
    assert sorted(got.columns) == sorted(want.columns) and cells.count() == 4

    def flat(df):
        return {(r.cell_id, r.barcode): [x for c in sorted(df.columns) if c != "barcode" for x in (r[c] if isinstance(r[c], list) else [r[c]])] for r in df.collect()}

    a, b = flat(got), flat(want)
    assert a.keys() == b.keys() and len(a) > 100 and all(np.allclose(a[k], b[k], atol=1e-12) for k in a)


def test_candidate_rows_move_once(spark):
    """From the context to the scores there is one exchange of candidate rows, and the state is not written."""
    written = []
    original = wsm.write_stage
    wsm.write_stage = lambda df, label: written.append((label, df)) or original(df, label)
    try:
        entry.queries()["g9_add_score"](spark, SF).count()
        wsm.forget_workspaces()
        entry.queries()["g9_add_score"](spark, SF).count()
    finally:
        wsm.write_stage = original
    assert "state" not in dict(written)
    plan = dict(written)["scored"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 2
