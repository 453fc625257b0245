"""The three end-to-end jobs on the smallest tables."""

from pyspark.sql import functions as F

from cellweave.operators.growth import final_owners
from cellweave.plans import competition, evaluation, preprocess
from cellweave.workspace import workspace
import cellweave.catalog  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_end_to_end(spark):
    ws = workspace(spark, SF)
    t = preprocess.run(ws["pixels"], ws["tissue_positions"], ws["expression"], ws["sc_expression"], ws["sc_metadata"], microns_per_pixel=0.5, min_cells_per_type=10)
    assert t.nuclei.count() == 18 and t.candidates.count() == 1476 and len(t.cell_types) > 1
    grown = competition.run(t)
    assert final_owners(grown).groupBy("patch_id", "barcode").count().filter("count > 1").count() == 0
    out = competition.assignments(grown, t)
    assert out.groupBy("cell_id").agg(F.countDistinct("patch_id").alias("n")).filter("n > 1").count() == 0
    links = ws["gt_cell_bins"].select("cell_id").distinct().withColumn("sc_barcode", F.concat(F.lit("C"), "cell_id"))
    rec = evaluation.run(t, out, ws["gt_cell_bins"], links, ws["expression"], ws["sc_expression"], min_common_genes=5)
    rows = rec.collect()
    assert len(rows) == 18 and any(r.pred_iou and r.pred_iou > 0.2 for r in rows) and any(r.gene_rmse is not None for r in rows)
    metrics, fractions = evaluation.summary(rec)
    assert {r.metric for r in metrics.collect()} == {"pred_iou", "pred_dice", "pred_precision", "pred_recall", "pred_f1"}
    assert fractions.first().n_episodes == 18
