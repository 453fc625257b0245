"""Evaluation of an assignment table against truth, in one wide record per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import coerce_bool, normalize_cell_id
from ..operators import evaluate as ev, expression as ex
from ..session import write_stage
from .preprocess import Tables


def _normalised(table: DataFrame, name: str) -> DataFrame:
    nuclear = coerce_bool(F.col("is_nuclear"))
    return table.select(normalize_cell_id(F.col("cell_id")).alias(name), "barcode", nuclear.alias("is_nuclear")).filter(F.col(name).isNotNull())


def run(tables: Tables, assignments: DataFrame, truth: DataFrame, truth_cells: DataFrame | None = None, expression: DataFrame | None = None,
        sc_expression: DataFrame | None = None, min_bins: int = 2, min_frac: float = 0.3, min_common_genes: int = 10) -> DataFrame:
    """Matching by nuclear overlap, set overlap and, if profiles are given, gene agreement.

    ``assignments`` and ``truth`` have (cell_id, barcode, is_nuclear); ``truth_cells`` maps
    a truth cell to its ``sc_barcode``.
    """
    pred, gt = _normalised(assignments, "pred_id"), _normalised(truth, "gt_id")
    source = ev.source_nuclear_bins(tables.bin_metadata)
    target = lambda t, c: t.filter("is_nuclear").select(F.col(c).alias("target_id"), "barcode")
    p = ev.match_by_nuclear_overlap(source, target(pred, "pred_id"), min_bins, min_frac)
    g = ev.match_by_nuclear_overlap(source, target(gt, "gt_id"), min_bins, min_frac)
    pairs = p.select("cell_id", F.col("matched_id").alias("pred_id"), "overlap_bins", F.col("match_method").alias("pred_match_method")).join(
        g.select("cell_id", F.col("matched_id").alias("gt_id"), "match_method"), "cell_id")
    records = write_stage(ev.overlap_metrics(write_stage(pairs, "pairs"), pred, gt), "records")
    if truth_cells is None or expression is None or sc_expression is None:
        return records
    genes = ex.common_genes(tables.genes, sc_expression)
    n = genes.count()
    if n < min_common_genes:
        return records
    linked = records.filter("pred_id is not null and gt_id is not null").select("cell_id", "pred_id", "gt_id").join(
        truth_cells.select(normalize_cell_id(F.col("cell_id")).alias("gt_id"), "sc_barcode"), "gt_id")
    members = linked.join(pred.select("pred_id", "barcode"), "pred_id").select("cell_id", "barcode")
    agreement = ex.spearman_inputs(ex.rollup(members, expression), sc_expression, linked.select("cell_id", "sc_barcode"), genes, n)
    return records.join(agreement, "cell_id", "left")


def summary(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metric rows, one row of match fractions)."""
    return ev.metric_summary(records, ev.OVERLAP_METRICS), ev.match_fractions(records)
