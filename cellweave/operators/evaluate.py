"""Evaluation of any bin-to-cell assignment against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import overlap_category, safe_ratio
from ..functions.ordered import exact_quantiles
from ..functions.scalars import attach_scalars
from .shape import mix_key
from .spatial_join import rows_in_boxes

OVERLAP_METRICS = ("pred_iou", "pred_dice", "pred_precision", "pred_recall", "pred_f1")


def source_nuclear_bins(metadata: DataFrame) -> DataFrame:
    """Nuclear bins per evaluated cell; bins claimed by several cells are included."""
    return metadata.filter("has_nuclear_annotation and dominant_cell_id is not null").select(
        F.col("dominant_cell_id").cast("string").alias("cell_id"), "barcode").distinct()


def match_by_nuclear_overlap(source: DataFrame, target: DataFrame, min_bins: int = 2, min_frac: float = 0.3) -> DataFrame:
    """Best target cell per source cell by shared nuclear bins; the largest id wins a tie.

    ``source`` (cell_id, barcode), ``target`` (target_id, barcode). Below either threshold a
    cell stays unmatched with 0 bins and a null fraction.
    """
    sizes = source.groupBy("cell_id").agg(F.count("*").alias("_n"))
    shared = source.join(target.select("target_id", "barcode").distinct(), "barcode").groupBy("cell_id", "target_id").agg(F.count("*").alias("c"))
    best = shared.groupBy("cell_id").agg(F.max(F.struct("c", "target_id")).alias("_b"))
    joined = sizes.join(best, "cell_id", "left")
    frac = F.col("_b.c") / F.col("_n")
    ok = (F.col("_b.c") >= min_bins) & (frac >= min_frac)
    return joined.select(
        "cell_id", F.when(ok, F.col("_b.target_id")).alias("matched_id"), F.coalesce(F.when(ok, F.col("_b.c")), F.lit(0)).alias("overlap_bins"),
        F.when(ok, frac).alias("overlap_frac"), F.when(ok, "nuclear_overlap").otherwise("unmatched").alias("match_method"))


def overlap_columns(inter: Column, n_pred: Column, n_gt: Column) -> dict[str, Column]:
    """IoU and Dice are null for two empty sets; precision, recall and F1 are 0 on an empty side."""
    union = n_pred + n_gt - inter
    p = F.when(n_pred > 0, inter / n_pred).otherwise(F.lit(0.0))
    r = F.when(n_gt > 0, inter / n_gt).otherwise(F.lit(0.0))
    return {"gt_assigned_intersection": inter, "gt_assigned_union": union, "pred_iou": safe_ratio(inter, union),
            "pred_dice": safe_ratio(2 * inter, n_pred + n_gt), "pred_precision": p, "pred_recall": r,
            "pred_f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))}


def overlap_metrics(pairs: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Set-overlap metrics for (cell_id, pred_id, gt_id) pairs, from three counts per pair.

    ``predicted`` (pred_id, barcode), ``truth`` (gt_id, barcode); both are reduced to the
    cells that take part before they meet. Unmatched truth gives null metrics.
    """
    pred = predicted.select("pred_id", "barcode").distinct().join(pairs.select("pred_id"), "pred_id", "left_semi")
    gt = truth.select("gt_id", "barcode").distinct().join(pairs.select("gt_id"), "gt_id", "left_semi")
    n_pred = pred.groupBy("pred_id").agg(F.count("*").alias("pred_n_bins"))
    n_gt = gt.groupBy("gt_id").agg(F.count("*").alias("gt_n_bins"))
    both = pairs.select("cell_id", "pred_id", "gt_id").join(pred, "pred_id").join(gt, ["gt_id", "barcode"]).groupBy("cell_id").agg(
        F.count("*").alias("_inter"))
    out = pairs.join(n_pred, "pred_id", "left").join(n_gt, "gt_id", "left").join(both, "cell_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cols = overlap_columns(zero("_inter"), zero("pred_n_bins"), zero("gt_n_bins"))
    has_gt = F.col("gt_id").isNotNull()
    metric = {k: (F.when(has_gt, c).otherwise(F.lit(0)) if k.startswith("gt_assigned") else F.when(has_gt, c)) for k, c in cols.items()}
    return out.select(*pairs.columns, zero("pred_n_bins").alias("pred_n_bins"), zero("gt_n_bins").alias("gt_n_bins"),
                      *[c.alias(k) for k, c in metric.items()])


def metric_summary(records: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, median and count of finite values per metric, in long form; none gives nulls and 0."""
    long = records.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "value")
    valid = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    base = long.groupBy("metric").agg(F.avg(F.when(valid, F.col("value"))).alias("mean"), F.count_if(valid).alias("n_valid"))
    return base.join(exact_quantiles(long.filter(valid), ["metric"], "value", {"median": 0.5}), "metric", "left")


def match_fractions(records: DataFrame) -> DataFrame:
    pred, gt = F.col("pred_id").isNotNull(), F.col("gt_id").isNotNull()
    return records.agg(
        F.count("*").alias("n_episodes"), F.count_if(pred).alias("n_matched_pred"), F.count_if(gt).alias("n_matched_gt"),
        F.avg(pred.cast("double")).alias("matched_pred_fraction"), F.avg(gt.cast("double")).alias("matched_gt_fraction"),
        (F.count_if(pred & gt) / F.nullif(F.count_if(gt), F.lit(0))).alias("pred_fraction_among_gt_matched"),
        F.avg(F.when(pred, F.col("pred_iou"))).alias("matched_only_mean_iou"))


def method_counts(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(F.coalesce(F.col(column), F.lit("unmatched")).alias("method")).agg(F.count("*").alias("n"))


def owner_to_truth(records: DataFrame, order: str) -> DataFrame:
    """Truth cell per predicted owner: the record with most nuclear overlap, the first on ties."""
    rows = records.filter("pred_id is not null and gt_id is not null")
    pick = F.min_by("gt_id", F.struct((-F.coalesce("overlap_bins", F.lit(0))).alias("n"), F.col(order).alias("o")))
    return rows.groupBy("pred_id").agg(pick.alias("gt_id"))


def truth_by_patch(truth: DataFrame, patches: DataFrame, wanted: DataFrame, patch_size: float) -> DataFrame:
    """Truth bins inside each patch box, one row per (patch, bin): the heaviest, then the smaller cell id."""
    rows = truth.join(wanted.select("gt_id"), "gt_id", "left_semi")
    boxes = patches.select("patch_id", F.col("outer_x_min").alias("x_min"), F.col("outer_x_max").alias("x_max"),
                           F.col("outer_y_min").alias("y_min"), F.col("outer_y_max").alias("y_max"))
    inside = rows_in_boxes(rows.select("gt_id", "barcode", "array_row", "array_col", "x_um", "y_um", "is_nuclear", "weight"), boxes, patch_size, ["patch_id"])
    best = inside.groupBy("patch_id", "barcode").agg(F.min_by(
        F.struct("gt_id", "array_row", "array_col", "x_um", "y_um", "is_nuclear", "weight"),
        F.struct((-F.col("weight")).alias("w"), "gt_id")).alias("_b"))
    return best.select("patch_id", "barcode", "_b.*")


def patch_bins(predicted: DataFrame, truth: DataFrame, trace: DataFrame, owner_map: DataFrame, patches: DataFrame) -> DataFrame:
    """Every bin of a patch seen by prediction, truth or trace, with owners and category.

    Owners of a bin are at most the cells of its patch, so the owner array stays small.
    """
    pred = predicted.groupBy("patch_id", "barcode").agg(
        F.sort_array(F.collect_set("cell_id")).alias("owners"), F.min(F.struct("x_um", "y_um")).alias("_pg"))
    gt = truth.select("patch_id", "barcode", "gt_id", "is_nuclear", F.struct("x_um", "y_um").alias("_gg"))
    tr = trace.groupBy("patch_id", "barcode").agg(F.min(F.struct("x_um", "y_um")).alias("_tg"))
    full = pred.join(gt, ["patch_id", "barcode"], "full_outer").join(tr, ["patch_id", "barcode"], "full_outer")
    full = full.withColumns({"predicted_owner": F.col("owners")[0], "_g": F.coalesce("_pg", "_gg", "_tg")})
    mapped = full.join(owner_map.select(F.col("pred_id").alias("predicted_owner"), F.col("gt_id").alias("matched_gt")), "predicted_owner", "left")
    core = patches.select("patch_id", "core_x_min", "core_x_max", "core_y_min", "core_y_max")
    x, y = F.col("_g.x_um"), F.col("_g.y_um")
    return mapped.join(core, "patch_id").select(
        "patch_id", "barcode", x.alias("x_um"), y.alias("y_um"), "predicted_owner", F.col("matched_gt").alias("predicted_matched_gt"),
        F.col("gt_id").alias("gt_owner"), F.coalesce(F.col("is_nuclear") > 0, F.lit(False)).alias("gt_is_nuclear"),
        F.coalesce(F.size("owners") > 1, F.lit(False)).alias("owner_conflict"),
        overlap_category(F.col("predicted_owner"), F.col("matched_gt"), F.col("gt_id")).alias("overlap_category"),
        (F.col("owners").isNull() & F.col("gt_id").isNull()).alias("trace_only"),
        (x.between(F.col("core_x_min"), F.col("core_x_max")) & y.between(F.col("core_y_min"), F.col("core_y_max"))).alias("inside_core"))


def patch_cells(core: DataFrame, predicted: DataFrame, truth: DataFrame, cell_truth: DataFrame) -> DataFrame:
    """Overlap of every core cell with its truth cell inside the patch. Null ratios for empty sides."""
    pairs = core.select("patch_id", "cell_id").join(cell_truth.select(F.col("pred_id").alias("cell_id"), F.col("gt_id").alias("matched_gt")), "cell_id", "left")
    pred = predicted.select("patch_id", "cell_id", "barcode").distinct()
    n_pred = pred.groupBy("patch_id", "cell_id").agg(F.count("*").alias("np"))
    n_gt = truth.groupBy("patch_id", F.col("gt_id").alias("matched_gt")).agg(F.count("*").alias("ng"))
    both = pairs.join(pred, ["patch_id", "cell_id"]).join(
        truth.select("patch_id", "barcode", F.col("gt_id").alias("matched_gt")), ["patch_id", "barcode", "matched_gt"]).groupBy("patch_id", "cell_id").agg(F.count("*").alias("ni"))
    out = pairs.join(n_pred, ["patch_id", "cell_id"], "left").join(n_gt, ["patch_id", "matched_gt"], "left").join(both, ["patch_id", "cell_id"], "left")
    p, g, i = (F.coalesce(F.col(c), F.lit(0)) for c in ("np", "ng", "ni"))
    return out.select("patch_id", "cell_id", "matched_gt", p.alias("predicted_bins"), g.alias("gt_bins"), i.alias("intersection"), (p + g - i).alias("union_bins"),
                      safe_ratio(i, p + g - i).alias("patch_iou"), safe_ratio(2 * i, p + g).alias("patch_dice"),
                      safe_ratio(i, p).alias("patch_precision"), safe_ratio(i, g).alias("patch_recall"))


def patch_metrics(bins: DataFrame, cells: DataFrame) -> DataFrame:
    """Foreground and owner agreement, category and display counts, one row per patch."""
    has_p, has_g = F.col("predicted_owner").isNotNull(), F.col("gt_owner").isNotNull()
    cat = lambda name: F.count_if(F.col("overlap_category") == name)
    agg = bins.groupBy("patch_id").agg(
        F.count_if(has_p).alias("predicted_bins"), F.count_if(has_g).alias("gt_bins"), F.count_if(has_p & has_g).alias("foreground_intersection_bins"),
        cat("correct_owner").alias("correct_owner_bins"), cat("wrong_owner").alias("wrong_owner_bins"), cat("unmatched_owner").alias("unmatched_owner_bins"),
        cat("pred_only").alias("pred_only_bins"), cat("gt_only").alias("gt_only_bins"), F.count("*").alias("display_bins"),
        F.count_if("trace_only").alias("trace_only_bins"), F.count_if("owner_conflict").alias("owner_conflicts"))
    macro = cells.groupBy("patch_id").agg(F.avg("patch_iou").alias("macro_cell_iou"), F.count("*").alias("core_cells"))
    p, g, i, c = (F.col(n) for n in ("predicted_bins", "gt_bins", "foreground_intersection_bins", "correct_owner_bins"))
    return agg.join(macro, "patch_id", "left").select(
        "*", (p + g - i).alias("foreground_union_bins"), safe_ratio(i, p + g - i).alias("foreground_iou"), safe_ratio(i, p).alias("foreground_precision"),
        safe_ratio(i, g).alias("foreground_recall"), safe_ratio(c, i).alias("owner_accuracy"), safe_ratio(c, p + g - c).alias("owner_micro_iou"))


def unit_histogram(records: DataFrame, metrics: Sequence[str], n_bins: int = 25) -> DataFrame:
    """Counts per equal bin of [0, 1]; 1 falls into the last bin."""
    long = records.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "value").filter("value is not null")
    b = F.least(F.floor(F.col("value") * n_bins), F.lit(n_bins - 1)).cast("int")
    return long.groupBy("metric", b.alias("bin")).agg(F.count("*").alias("n"))


def range_histogram(records: DataFrame, column: str, n_bins: int = 32) -> DataFrame:
    """Counts per equal bin between the smallest and the largest value."""
    span = records.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    lo = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5)
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    b = F.least(F.floor((F.col(column) - lo) / width * n_bins), F.lit(n_bins - 1)).cast("int")
    return attach_scalars(records.filter(F.col(column).isNotNull()), span).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def size_relation(records: DataFrame) -> DataFrame:
    """Overgrowth flag and clipped size ratio of matched cells."""
    return records.filter("gt_id is not null").select(
        "cell_id", (F.col("pred_n_bins") > F.col("gt_n_bins")).alias("overgrown"),
        F.least(F.col("pred_n_bins") / F.greatest("gt_n_bins", F.lit(1)), F.lit(2.5)).alias("size_ratio"))


def bin_classes(pairs: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """true / false positive / false negative class of every bin of each matched pair."""
    p = pairs.filter("pred_id is not null and gt_id is not null").select("cell_id", "pred_id", "gt_id")
    pred = p.join(predicted.select("pred_id", "barcode").distinct(), "pred_id").select("cell_id", "barcode", F.lit(1).alias("_p"))
    gt = p.join(truth.select("gt_id", "barcode").distinct(), "gt_id").select("cell_id", "barcode", F.lit(1).alias("_g"))
    return pred.join(gt, ["cell_id", "barcode"], "full_outer").select(
        "cell_id", "barcode", F.when(F.col("_p").isNull(), "fn").when(F.col("_g").isNull(), "fp").otherwise("tp").alias("bin_class"))


def pick_records(records: DataFrame, n: int, how: str, seed: int = 0) -> DataFrame:
    """n records for display: first / top_reward / best_iou / worst_iou / random; nulls are worst."""
    order = {"first": [F.asc("cell_id")], "top_reward": [F.desc_nulls_last("total_reward"), F.asc("cell_id")],
             "best_iou": [F.desc_nulls_last("pred_iou"), F.asc("cell_id")], "worst_iou": [F.asc_nulls_last("pred_iou"), F.asc("cell_id")],
             "random": [F.asc(mix_key(F.col("cell_id"), seed)), F.asc("cell_id")]}[how]
    return records.orderBy(*order).limit(n)
