"""Expression in long (barcode, gene, count) form: reference profiles, likelihoods, roll-ups.

Absent genes are zeros. Where a statistic counts them, the zero part is added from totals
instead of writing the dense grid, unless the dense grid is the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordered import ordinal, running
from ..functions.scalars import attach_scalars
from .components import Sparse, weighted_scores

MAX_TYPES = 2000
#: A gene table up to this size is sent to all tasks; entries of one gene that meet in one join key beyond it.
GENE_TABLE_BYTES = 32 << 20
GENE_BLOCK_ROWS = 1_000_000


def gene_allowlist(names: DataFrame, column: str, first_seen: str | None = None) -> DataFrame:
    """Trimmed unique names without blanks, 'nan' and '#' lines; optionally with first position."""
    g = F.trim(F.col(column))
    valid = names.select(g.alias("gene"), *([F.col(first_seen).alias("_o")] if first_seen else [])).filter(
        (F.col("gene") != "") & (F.lower("gene") != "nan") & ~F.col("gene").startswith("#"))
    if first_seen is None:
        return valid.select("gene").distinct()
    return valid.groupBy("gene").agg(F.min("_o").alias("first_position"))


def select_features(features: DataFrame, feature_type: str | None) -> DataFrame:
    """Features of one type with their original position kept as ``matrix_feature_index``."""
    return features if feature_type is None else features.filter(F.col("feature_type") == feature_type)


def align_genes(reference_genes: DataFrame, matrix_features: DataFrame) -> DataFrame:
    """First matrix row of every reference gene; null where the matrix lacks it."""
    first = matrix_features.groupBy("gene").agg(F.min("matrix_feature_index").alias("matrix_feature_index"))
    return reference_genes.join(first, "gene", "left")


def common_genes(spatial: DataFrame, reference: DataFrame) -> DataFrame:
    """Unique genes of both dictionaries with their spatial order."""
    first = spatial.groupBy("gene").agg(F.min("matrix_feature_index").alias("spatial_index"))
    return first.join(reference.select("gene").distinct(), "gene", "left_semi")


def typed_cells(metadata: DataFrame, cells: DataFrame, min_cells_per_type: int, order: str = "cell_type") -> DataFrame:
    """Matrix cells with a type that enough cells have; repeated metadata keeps its first row by ``order``."""
    meta = metadata.groupBy("sc_barcode").agg(F.min_by("cell_type", F.col(order)).alias("cell_type"))
    typed = cells.select("sc_barcode").distinct().join(meta, "sc_barcode").filter("cell_type is not null")
    sizes = typed.groupBy("cell_type").agg(F.count("*").alias("n_cells")).filter(F.col("n_cells") >= min_cells_per_type)
    return typed.join(sizes, "cell_type")


def reference_counts(sc_expression: DataFrame, typed: DataFrame, genes: DataFrame) -> DataFrame:
    """Non-zero summed counts per (cell type, gene)."""
    kept = sc_expression.join(genes.select("gene"), "gene", "left_semi")
    return kept.join(typed.select("sc_barcode", "cell_type"), "sc_barcode").groupBy("cell_type", "gene").agg(
        F.sum("cnt").alias("count"))


def type_list(typed: DataFrame) -> list[str]:
    """Cell types, largest first; a plan-time list of checked length."""
    rows = typed.select("cell_type", "n_cells").distinct().orderBy(F.desc("n_cells"), "cell_type").limit(MAX_TYPES + 1).collect()
    if len(rows) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} cell types")
    return [r.cell_type for r in rows]


def dense_counts(counts: DataFrame, genes: DataFrame, types: Sequence[str]) -> DataFrame:
    """Complete (cell type, gene) table with zeros; types are a plan-time list."""
    grid = genes.select("gene", F.explode(F.array(*[F.lit(t) for t in types])).alias("cell_type"))
    return grid.join(counts, ["cell_type", "gene"], "left").select("cell_type", "gene", F.coalesce("count", F.lit(0)).alias("count"))


def log_theta(counts: DataFrame, genes: DataFrame, types: Sequence[str], epsilon: float) -> DataFrame:
    """One row per gene with the array of log theta over ``types``.

    theta = (C + eps) / sum over genes of (C + eps), which is flat for a type without counts
    in these genes. Types meet genes once, by their number, and a gene's types are sorted
    into its array, so that the work is the size of the result.
    """
    named = counts.sparkSession.createDataFrame([(i, t) for i, t in enumerate(types)], "type_index int, cell_type string")
    total = named.join(counts.groupBy("cell_type").agg(F.sum("count").alias("total")), "cell_type", "left")
    n_genes = genes.agg(F.count("*").alias("_g"))
    denominators = attach_scalars(total, n_genes).select("type_index", "cell_type", (F.coalesce("total", F.lit(0)) + epsilon * F.col("_g")).alias("den"))
    every_type = denominators.agg(F.collect_list(F.struct("type_index", "cell_type", "den")).alias("_types"))
    grid = attach_scalars(genes.select("gene"), every_type).select("gene", F.explode("_types").alias("t")).select("gene", "t.*")
    joined = grid.join(counts.select("gene", "cell_type", "count"), ["gene", "cell_type"], "left")
    entry = F.struct("type_index", F.log((F.coalesce("count", F.lit(0)) + F.lit(epsilon)) / F.col("den")).alias("v"))
    return joined.groupBy("gene").agg(F.sort_array(F.collect_list(entry)).alias("e")).select("gene", F.col("e.v").alias("log_theta"))


def theta_long(theta: DataFrame, types: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(t) for t in types])
    return theta.select("gene", F.explode(F.arrays_zip(names.alias("cell_type"), F.col("log_theta").alias("log_theta"))).alias("z")).select(
        "gene", F.col("z.cell_type").alias("cell_type"), F.col("z.log_theta").alias("log_theta"))


def blocked_genes(expression: DataFrame, theta: DataFrame, block_rows: int) -> DataFrame:
    """``expression`` with ``log_theta``, joined in blocks of gene x bins.

    The bins are dealt to as many blocks as the most frequent gene has runs of ``block_rows``
    entries, and every gene stands in each block once, so that no join key holds much more
    than a run, whatever share of the bins a gene is found in.
    """
    most = expression.groupBy("gene").agg(F.count("*").alias("n")).agg(F.greatest(F.lit(1), F.ceil(F.max("n") / block_rows)).cast("long").alias("_blocks"))
    dealt = attach_scalars(expression.select("barcode", "gene", "cnt"), most).withColumn("_block", F.pmod(F.xxhash64("barcode"), F.col("_blocks"))).drop("_blocks")
    spread = attach_scalars(theta.select("gene", "log_theta"), most).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")
    return dealt.join(spread.hint("merge"), ["gene", "_block"])


def bin_likelihoods(expression: DataFrame, theta: DataFrame, n_types: int, broadcast_bytes: int = GENE_TABLE_BYTES, block_rows: int = GENE_BLOCK_ROWS) -> DataFrame:
    """Per bin: selected-gene total and mean log-likelihood per type (array in type order).

    One row per non-zero count enters the aggregate; K running sums replace a K-fold
    explode. The gene table, whose size is counted, goes to all tasks while it is small;
    beyond that both sides meet in blocks of gene x bins.
    """
    small = theta.limit(broadcast_bytes // (8 * n_types + 64) + 1).count() <= broadcast_bytes // (8 * n_types + 64)
    joined = expression.join(F.broadcast(theta), "gene") if small else blocked_genes(expression, theta, block_rows)
    sums = [F.sum(F.col("cnt") * F.col("log_theta")[i]).alias(f"_s{i}") for i in range(n_types)]
    agg = joined.groupBy("barcode").agg(F.sum("cnt").alias("bin_total"), *sums)
    n = F.col("bin_total")
    return agg.select("barcode", "bin_total",
                      F.when(n > 0, F.array(*[F.col(f"_s{i}") / n for i in range(n_types)]))
                      .otherwise(F.array(*[F.lit(0.0)] * n_types)).alias("ll"))


def confidence(total: Column, pseudocount: float) -> Column:
    denominator = total + F.lit(pseudocount)
    return F.when(denominator > 0, total / denominator).otherwise(F.lit(0.0))


def complete_bins(bins: DataFrame, likelihoods: DataFrame, n_types: int, pseudocount: float) -> DataFrame:
    """Every bin: empty ones have total 0 and likelihood 0 for each type."""
    zeros = F.array(*[F.lit(0.0)] * n_types)
    out = bins.join(likelihoods, "barcode", "left")
    total = F.coalesce("bin_total", F.lit(0))
    return out.select(*bins.columns, total.alias("bin_total"), F.coalesce("ll", zeros).alias("ll"),
                      confidence(total, pseudocount).alias("expr_conf"))


def rollup(assignments: DataFrame, expression: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Summed counts per (cell, gene) over a cell's distinct bins."""
    pairs = assignments.select("cell_id", "barcode").distinct()
    expr = expression if genes is None else expression.join(genes.select("gene"), "gene", "left_semi")
    return pairs.join(expr, "barcode").groupBy("cell_id", "gene").agg(F.sum("cnt").alias("cnt"))


def mean_rollup(members: DataFrame, expression: DataFrame, seed: str) -> DataFrame:
    """Mean count per (cell, gene) over seed bins, or over all bins of cells without seeds.

    Bins without the gene count as zero: the divisor is the number of bins.
    """
    sizes = members.groupBy("cell_id").agg(F.count_if(F.col(seed)).alias("_ns"), F.count("*").alias("_n"))
    used = members.join(sizes, "cell_id").filter(F.col(seed) | (F.col("_ns") == 0))
    divisor = F.when(F.col("_ns") > 0, F.col("_ns")).otherwise(F.col("_n"))
    return used.join(expression, "barcode").groupBy("cell_id", "gene").agg(
        (F.sum("cnt") / F.max(divisor)).alias("mean_count"))


def nuclear_expression_filter(metadata: DataFrame, bin_totals: DataFrame, nuclei: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Cells whose confident nuclear bins hold more than ``threshold`` counts, and six counters."""
    confident = metadata.filter("has_nuclear_annotation and not ambiguous_nuclear_assignment and dominant_cell_id is not null").select(
        F.col("dominant_cell_id").alias("cell_id"), "barcode").distinct()
    sums = confident.join(bin_totals.select("barcode", "bin_total"), "barcode", "left").groupBy("cell_id").agg(
        F.sum(F.coalesce("bin_total", F.lit(0))).alias("nuclear_sum"))
    valid = sums.filter(F.col("nuclear_sum") > threshold)
    kept = nuclei.join(valid.select("cell_id"), "cell_id", "left_semi")
    counters = nuclei.agg(F.count("*").alias("n_input_nuclei"))
    counters = attach_scalars(counters, kept.agg(F.count("*").alias("n_kept_nuclei")))
    counters = attach_scalars(counters, sums.agg(
        F.count("*").alias("n_cells_with_confident_bins"), F.count_if(F.col("nuclear_sum") > threshold).alias("n_cells_with_expression")))
    counters = counters.withColumn("n_filtered_nuclei", F.col("n_input_nuclei") - F.col("n_kept_nuclei"))
    return kept, counters.withColumn("threshold", F.lit(float(threshold)))


def qc_filter(expression: DataFrame, min_bins_per_gene: int, min_counts_per_bin: int) -> DataFrame:
    """Keep genes seen in enough bins and bins with enough counts (both on the raw table)."""
    genes = expression.filter("cnt > 0").groupBy("gene").agg(F.count("*").alias("n")).filter(F.col("n") >= min_bins_per_gene)
    bins = expression.groupBy("barcode").agg(F.sum("cnt").alias("t")).filter(F.col("t") >= min_counts_per_bin)
    return expression.join(genes, "gene", "left_semi").join(bins, "barcode", "left_semi")


def top_variance_genes(expression: DataFrame, n_rows: DataFrame, n_top: int) -> DataFrame:
    """Genes of largest population variance over ``n_rows`` bins; absent bins are zeros."""
    sums = expression.groupBy("gene").agg(F.sum(F.col("cnt").cast("double")).alias("_s"),
                                          F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias("_q"))
    var = attach_scalars(sums, n_rows.toDF("_n")).select(
        "gene", F.greatest(F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), F.lit(2.0)), F.lit(0.0)).alias("variance"))
    return var.orderBy(F.desc("variance"), "gene").limit(n_top)


def normalize_log1p(expression: DataFrame, target_sum: float, key: str = "barcode") -> DataFrame:
    """log1p(count * target / total of the bin); bins are small, so totals come from an aggregate join."""
    totals = expression.groupBy(key).agg(F.sum("cnt").alias("_t"))
    return expression.join(totals, key).select(
        key, "gene", F.log1p(F.when(F.col("_t") > 0, F.col("cnt") * (F.lit(target_sum) / F.col("_t"))).otherwise(F.lit(0.0))).alias("value"))


def top_genes_per_bin(expression: DataFrame, k: int) -> DataFrame:
    """The k largest genes of every bin (gene name on ties) with the bin's sum, max and gene count."""
    w = Window.partitionBy("barcode").orderBy(F.desc("cnt"), "gene")
    top = expression.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    stats = expression.groupBy("barcode").agg(F.sum("cnt").alias("bin_sum"), F.max("cnt").alias("bin_max"),
                                              F.count_if(F.col("cnt") > 0).alias("n_genes"))
    return top.join(stats, "barcode")


def ordered_barcodes(table: DataFrame, order: str) -> DataFrame:
    """Position of each barcode in file order."""
    return ordinal(table.select("barcode", order), [order], "matrix_col_index").select("barcode", "matrix_col_index")


def gene_dictionary(expression: DataFrame, typed_as: Column) -> DataFrame:
    """Gene names in order with their position and feature type."""
    genes = expression.select("gene").distinct()
    return ordinal(genes, ["gene"], "matrix_feature_index").select("gene", typed_as.alias("feature_type"), "matrix_feature_index")


def spearman_inputs(pred: DataFrame, truth: DataFrame, pairs: DataFrame, genes: DataFrame, n_genes: int) -> DataFrame:
    """Per matched cell: Spearman r, RMSE, totals and detected genes over the common genes.

    Both profiles live on one gene list where absent genes are zeros. Zeros share one
    average rank, so ranks of the non-zero part are shifted by the number of zeros and
    the zero-zero block enters the correlation as a closed form. Only non-zero
    (cell, gene) rows are ever stored.
    """
    p = pairs.join(pred, "cell_id").select("cell_id", "gene", F.col("cnt").cast("double").alias("p"))
    t = pairs.join(truth, "sc_barcode").select("cell_id", "gene", F.col("cnt").cast("double").alias("t"))
    p = p.join(genes.select("gene"), "gene", "left_semi").filter("p > 0")
    t = t.join(genes.select("gene"), "gene", "left_semi").filter("t > 0")
    both = p.join(t, ["cell_id", "gene"], "full_outer").select(
        "cell_id", "gene", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("t", F.lit(0.0)).alias("t"))
    n = F.lit(float(n_genes))

    def average_rank(value: str) -> Column:
        # groups are one cell's genes: at most the gene list
        asc = Window.partitionBy("cell_id").orderBy(value)
        ties = F.count("*").over(Window.partitionBy("cell_id", value))
        rows = F.count("*").over(Window.partitionBy("cell_id"))
        nonzero = F.rank().over(asc) + (ties - 1) / 2.0 + (n - rows)
        zeros = F.count_if(F.col(value) == 0).over(Window.partitionBy("cell_id")) + (n - rows)
        return F.when(F.col(value) == 0, (zeros + 1.0) / 2.0).otherwise(nonzero)

    ranked = both.select("*", average_rank("p").alias("rp"), average_rank("t").alias("rt"))
    mid = (n + 1.0) / 2.0
    agg = ranked.groupBy("cell_id").agg(
        F.count("*").alias("_rows"), F.count_if(F.col("p") > 0).alias("pred_genes_detected"),
        F.count_if(F.col("t") > 0).alias("gt_genes_detected"),
        F.sum("p").alias("pred_total"), F.sum("t").alias("gt_total"),
        F.sum((F.col("p") - F.col("t")) * (F.col("p") - F.col("t"))).alias("_sq"),
        F.sum((F.col("rp") - mid) * (F.col("rt") - mid)).alias("_xy"),
        F.sum((F.col("rp") - mid) * (F.col("rp") - mid)).alias("_xx"),
        F.sum((F.col("rt") - mid) * (F.col("rt") - mid)).alias("_yy"))
    absent = n - F.col("_rows")
    zp = (n - F.col("pred_genes_detected") + 1.0) / 2.0 - mid
    zt = (n - F.col("gt_genes_detected") + 1.0) / 2.0 - mid
    xy = F.col("_xy") + absent * zp * zt
    xx = F.col("_xx") + absent * zp * zp
    yy = F.col("_yy") + absent * zt * zt
    usable = (n >= 2) & (F.col("pred_total") > 0) & (F.col("gt_total") > 0) & (xx > 0) & (yy > 0)
    return agg.select(
        "cell_id", F.when(usable, xy / F.sqrt(xx * yy)).alias("gene_spearman_r"),
        F.sqrt(F.col("_sq") / n).alias("gene_rmse"), F.col("pred_total").alias("pred_gene_total_counts"),
        F.col("gt_total").alias("gt_gene_total_counts"), "pred_genes_detected", "gt_genes_detected",
        F.lit(n_genes).alias("gene_common_count"))


def seed_distance(context: DataFrame, pitch_um: float) -> DataFrame:
    """Distance of every candidate bin to its cell's closest seed, in bins; a cell's seeds fit one disc."""
    seeds = context.filter("is_seed").groupBy("cell_id").agg(F.collect_list(F.struct("x_um", "y_um")).alias("_seeds"))
    near = F.array_min(F.transform("_seeds", lambda s: F.sqrt((F.col("x_um") - s["x_um"]) * (F.col("x_um") - s["x_um"]) + (F.col("y_um") - s["y_um"]) * (F.col("y_um") - s["y_um"]))))
    return context.select("cell_id", "barcode", "is_seed", "x_um", "y_um", "dist_um").join(seeds, "cell_id", "left").select(
        "cell_id", "barcode", "is_seed", (F.coalesce(near, F.col("dist_um")) / pitch_um).alias("_space"))


def patch_scaled(placed: DataFrame, weight: float, eps: float) -> DataFrame:
    """Score from the log distance ``_t``, min-max scaled per patch, and the spatial distance ``_space``."""
    span = placed.groupBy("patch_id").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    scaled = (F.col("_t") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(eps))
    return placed.join(span, "patch_id").select("patch_id", "cell_id", "barcode", (-(scaled + weight * F.col("_space"))).alias("score"))


def transcriptomic_scores(context: DataFrame, expression: DataFrame, members: DataFrame, target_sum: float, weight: float, pitch_um: float,
                          eps: float = 1.0e-8) -> DataFrame:
    """Distance score of every candidate bin to its cell's seed profile, min-max scaled per patch.

    With all components kept, the component distance equals the distance of the normalised
    profiles: |a|^2 + |b|^2 - 2ab, each from sparse rows. The spatial part is the distance
    to the closest seed; a cell's seeds fit one disc and travel as a small array.
    """
    bins = normalize_log1p(expression, target_sum)
    profile = mean_rollup(context.select("cell_id", "barcode", "is_seed"), expression, "is_seed").withColumnRenamed("mean_count", "cnt")
    cells = normalize_log1p(profile, target_sum, key="cell_id")
    sq = lambda df, key, out: df.groupBy(key).agg(F.sum(F.col("value") * F.col("value")).alias(out))
    cross = context.select("cell_id", "barcode").join(bins, "barcode").join(
        cells.select("cell_id", "gene", F.col("value").alias("_v")), ["cell_id", "gene"]).groupBy("cell_id", "barcode").agg(F.sum(F.col("value") * F.col("_v")).alias("_ab"))
    base = seed_distance(context, pitch_um)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    dist = base.join(sq(bins, "barcode", "_a"), "barcode", "left").join(sq(cells, "cell_id", "_b"), "cell_id", "left").join(cross, ["cell_id", "barcode"], "left").select(
        "cell_id", "barcode", "_space", F.log(F.greatest(zero("_a") + zero("_b") - 2.0 * zero("_ab"), F.lit(eps))).alias("_t"))
    return patch_scaled(members.select("patch_id", "cell_id").join(dist, "cell_id"), weight, eps)


def patch_genes(codes: np.ndarray, counts: np.ndarray, weight: np.ndarray, n_rows: int, n_genes: int, n_top_genes: int) -> np.ndarray:
    """Marks of the genes of largest variance over a patch's candidate rows; codes follow gene names, rows without a gene count as zero."""
    s = np.bincount(codes, weight * counts, n_genes)
    q = np.bincount(codes, weight * counts * counts, n_genes)
    held = np.bincount(codes, minlength=n_genes) > 0
    variance = np.where(held, np.maximum(q / n_rows - (s / n_rows) * (s / n_rows), 0.0), -1.0)
    chosen = np.zeros(n_genes, dtype=bool)
    chosen[np.lexsort((np.arange(n_genes), -variance))[:n_top_genes]] = True
    return chosen & held


def log_normalised(codes: np.ndarray, values: np.ndarray, rows: np.ndarray, n_rows: int, target_sum: float) -> Sparse:
    """log1p of the values of every row scaled to ``target_sum``; entries are ordered by row."""
    totals = np.bincount(rows, values, n_rows)[rows]
    return Sparse(codes, np.log1p(values * np.where(totals > 0, target_sum / np.where(totals > 0, totals, 1.0), 0.0)), np.cumsum(np.bincount(rows, minlength=n_rows)))


def component_distances(bins: pd.DataFrame, n_top_genes: int, n_pcs: int, target_sum: float) -> pd.DataFrame:
    """Squared distances of one patch's bins to the profiles of the cells that hold them, in its leading components.

    A row is a bin with its counts and the cells that hold it. A cell's profile is the mean of
    its seeds, or of all its bins if it has none. Components are those of all bins (once for
    every cell that holds it) and profiles.
    """
    bins = bins.sort_values("barcode", ignore_index=True)
    n_bins = len(bins)
    flat = lambda c, t: np.concatenate([np.asarray(v, dtype=t) for v in bins[c]])
    held, per_bin = bins["cells"].map(len).to_numpy(), bins["genes"].map(len).to_numpy()
    cell, names = pd.factorize(flat("cells", object), sort=True)
    of_bin = np.repeat(np.arange(n_bins), held)
    codes, genes = pd.factorize(flat("genes", object), sort=True)
    counts, row = flat("counts", float), np.repeat(np.arange(n_bins), per_bin)
    chosen = patch_genes(codes, counts, held[row].astype(float), len(of_bin), len(genes), n_top_genes)
    kept = chosen[codes] if len(codes) else np.zeros(0, dtype=bool)
    codes, counts, row = (np.cumsum(chosen) - 1)[codes[kept]], counts[kept], row[kept]
    n_genes, starts = max(1, int(chosen.sum())), np.searchsorted(row, np.arange(n_bins + 1))
    seeds = flat("seeds", bool)
    has_seed = np.bincount(cell, seeds, len(names)) > 0
    used = seeds | ~has_seed[cell]
    size = np.bincount(cell[used], minlength=len(names))
    parts = [(codes, counts, row)]
    for c in range(len(names)):
        total = np.zeros(n_genes)
        for b in of_bin[used & (cell == c)]:
            total[codes[starts[b]:starts[b + 1]]] += counts[starts[b]:starts[b + 1]]
        at = np.flatnonzero(total)
        parts.append((at, total[at] / size[c], np.full(len(at), n_bins + c)))
    units = log_normalised(*(np.concatenate(x) for x in zip(*parts)), n_bins + len(names), target_sum)
    scores = weighted_scores(units, np.concatenate([held, np.ones(len(names))]).astype(float), n_genes, n_pcs)
    apart = scores[of_bin] - scores[n_bins + cell]
    return pd.DataFrame({"cell_id": names[cell], "barcode": bins["barcode"].to_numpy()[of_bin], "space": flat("space", float), "d2": (apart * apart).sum(axis=1)})


def component_scores(context: DataFrame, expression: DataFrame, members: DataFrame, n_top_genes: int, n_pcs: int, target_sum: float, weight: float,
                     pitch_um: float, eps: float = 1.0e-8) -> DataFrame:
    """As ``transcriptomic_scores``, over a patch's most variable genes and leading components.

    Spark packs each bin of a patch with its counts and cells and deals the patches out; a task
    gets one patch, whose rows are its distinct bins, and works on its counts only. The number of
    shares is the session's, not one by bytes: packed bins are small next to the work on them.
    """
    n_shares = int(context.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    item = F.struct("cell_id", "is_seed", "_space")
    placed = members.select("patch_id", "cell_id").join(seed_distance(context, pitch_um), "cell_id").groupBy("patch_id", "barcode").agg(F.sort_array(F.collect_list(item)).alias("e"))
    counts = expression.filter("gene is not null").groupBy("barcode").agg(F.collect_list(F.struct("gene", F.col("cnt").cast("double").alias("cnt"))).alias("x"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    bins = placed.join(counts, "barcode", "left").select(
        "patch_id", "barcode", F.col("e.cell_id").alias("cells"), F.col("e.is_seed").alias("seeds"), F.col("e._space").alias("space"),
        none(F.col("x.gene"), "array<string>").alias("genes"), none(F.col("x.cnt"), "array<double>").alias("counts"))

    def score(patch: pd.DataFrame) -> pd.DataFrame:
        out = component_distances(patch, n_top_genes, n_pcs, target_sum)
        logged = np.log(np.maximum(out["d2"], eps))
        scaled = (logged - logged.min()) / max(logged.max() - logged.min(), eps)
        return pd.DataFrame({"patch_id": patch["patch_id"].iloc[0], "cell_id": out["cell_id"], "barcode": out["barcode"], "score": -(scaled + weight * out["space"])})

    key = context.schema["cell_id"].dataType.simpleString()
    return bins.repartition(n_shares, "patch_id").groupBy("patch_id").applyInPandas(score, f"patch_id string, cell_id {key}, barcode string, score double")
