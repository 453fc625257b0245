"""Component scores: one pass over a patch, and patches dealt to all tasks however few bytes they have."""

import pytest

from cellweave.operators import expression as ex


def test_patches_are_scored_once_by_many_tasks(spark):
    context = spark.range(400).selectExpr("id div 4 as cell_id", "concat('b', id) as barcode", "id % 4 = 0 as is_seed", "cast(id % 4 as double) as x_um", "0.0D as y_um", "1.0D as dist_um")
    expression = spark.range(1200).selectExpr("concat('b', id div 3) as barcode", "concat('g', id % 3) as gene", "1 + (id * 7) % 5 as cnt")
    members = spark.range(100).selectExpr("concat('p', id div 2) as patch_id", "id as cell_id")
    scored = ex.component_scores(context, expression, members, 3, 2, 100.0, 0.1, 2.0)
    assert scored._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == 1
    assert scored.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scored.count() == 400


def test_bins_without_counts(spark):
    context = spark.createDataFrame([(1, "a", True, 0.0, 0.0, 0.0), (1, "b", False, 2.0, 0.0, 2.0)], "cell_id long, barcode string, is_seed boolean, x_um double, y_um double, dist_um double")
    members = spark.createDataFrame([("p", 1)], "patch_id string, cell_id long")
    none = spark.createDataFrame([], "barcode string, gene string, cnt long")
    zero = spark.createDataFrame([("a", "g", 0)], none.schema)
    for expression in (none, zero):
        got = {r.barcode: r.score for r in ex.component_scores(context, expression, members, 3, 2, 100.0, 0.1, 2.0).collect()}
        assert got == {"a": 0.0, "b": pytest.approx(-0.1)}
