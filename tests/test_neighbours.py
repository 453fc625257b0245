"""Eight neighbours: every pair is a row, and no side of the join goes through the driver."""

import __spark_entry__ as entry
from cellweave.operators import grid

SF = "/root/testdata/sf0.001"


def test_every_pair_is_returned(spark):
    c = [tuple(r) for r in entry.queries()["j5_candidate_radius_join"](spark, SF).select("cell_id", "barcode").collect()]
    place = lambda barcode: tuple(int(v) for v in barcode[:-2].split("_")[2:])
    at = {(cell, place(barcode)): barcode for cell, barcode in c}
    want = sorted((cell, barcode, at[cell, (r + a, k + b)]) for (cell, (r, k)), barcode in at.items()
                  for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (cell, (r + a, k + b)) in at)
    assert sorted(tuple(r) for r in entry.queries()["j9_eight_neighbours"](spark, SF).collect()) == want and want


def test_neighbours_are_not_broadcast(spark):
    cells = spark.range(100).selectExpr("id div 10 as x", "id % 10 as y")
    pairs = grid.neighbour_pairs(cells, [], "x", "y")
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 684
