"""Compartment claims of cells on bins and their roll-up to one row per bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import coerce_bool, normalize_cell_id
from ..functions.ordered import ordinal

COUNTS = ("nuclear_pixel_count", "cytoplasm_pixel_count", "boundary_pixel_count", "interior_pixel_count")


def pixel_counts(assigned: DataFrame) -> DataFrame:
    """Pixel counts per (bin, cell, cell type); null types stay a group. Interior is not in the total."""
    flags = ("is_nuclear", "is_cytoplasm", "is_boundary", "is_interior")
    counts = assigned.groupBy("bin_ordinal", "cell_id", "cell_type").agg(
        *[F.sum(f).alias(c) for f, c in zip(flags, COUNTS)])
    total = F.col(COUNTS[0]) + F.col(COUNTS[1]) + F.col(COUNTS[2])
    return counts.withColumn("total_compartment_pixels", total).filter("total_compartment_pixels > 0")


def with_bin_metadata(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """Attach barcode and position after the pixels are already reduced to counts."""
    meta = bins.select("bin_ordinal", "barcode", "array_row", "array_col", "in_tissue", "x_um", "y_um",
                       "pxl_row_in_fullres", "pxl_col_in_fullres")
    return counts.join(meta, "bin_ordinal").withColumn("bin_id", F.col("barcode"))


def split_compartments(claims: DataFrame) -> DataFrame:
    """Up to one nuclear, one cytoplasm and one boundary-only row per claim, in one pass."""
    nuc, cyt, bnd = F.col(COUNTS[0]), F.col(COUNTS[1]), F.col(COUNTS[2])
    total = F.col("total_compartment_pixels")

    def part(when: Column, weight: Column, n: int, c: int, b: int, i: int) -> Column:
        return F.when(when, F.struct(weight.alias("weight"), F.lit(n).alias("is_nuclear"), F.lit(c).alias("is_cytoplasm"),
                                     F.lit(b).alias("is_boundary"), F.lit(i).alias("is_interior")))

    parts = F.array(
        part(nuc > 0, nuc / total, 1, 0, 0, 1),
        part(cyt > 0, cyt / total, 0, 1, 0, 1),
        part((bnd > 0) & (nuc == 0) & (cyt == 0), F.lit(1.0), 0, 0, 1, 0))
    return claims.withColumn("_p", F.explode(F.filter(parts, lambda p: p.isNotNull()))).select(*claims.columns, "_p.*")


def filter_claims(claims: DataFrame, nuclear_only: bool = False, in_tissue_only: bool = False) -> DataFrame:
    out = claims.filter("is_nuclear = 1") if nuclear_only else claims
    return out.filter("in_tissue = 1") if in_tissue_only else out


def claims_by_barcode(nuclear_claims: DataFrame) -> DataFrame:
    """One row per claimed barcode: totals, number of claimants, dominant claimant.

    Dominance: most nuclear pixels, then largest weight, then smallest cell id. The winner
    is a max over a struct, so it pre-aggregates like the sums do.
    """
    rank = F.struct("nuclear_pixel_count", "weight", (-F.col("cell_id")).alias("neg"))
    best = F.max_by(F.struct("cell_id", "cell_type", "weight"), rank)
    agg = nuclear_claims.groupBy("barcode").agg(
        F.sum("nuclear_pixel_count").alias("total_nuclear_pixel_count"),
        F.max("nuclear_pixel_count").alias("max_nuclear_pixel_count"),
        F.countDistinct("cell_id").alias("n_cell_claims"),
        F.max("weight").alias("max_weight"), best.alias("_b"))
    return agg.select("barcode", "total_nuclear_pixel_count", "max_nuclear_pixel_count", "n_cell_claims", "max_weight",
                      F.col("_b.cell_id").alias("dominant_cell_id"), F.col("_b.cell_type").alias("dominant_cell_type"),
                      F.col("_b.weight").alias("dominant_weight"), F.lit(True).alias("has_nuclear_annotation"),
                      (F.col("n_cell_claims") > 1).alias("ambiguous_nuclear_assignment"))


def bin_metadata(barcodes: DataFrame, positions: DataFrame, by_barcode: DataFrame) -> DataFrame:
    """All matrix barcodes with position and nuclear annotation; defaults where none."""
    joined = barcodes.join(positions, "barcode", "left").join(by_barcode, "barcode", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(
        "matrix_col_index", F.col("barcode").alias("bin_id"), "barcode", "array_row", "array_col", "in_tissue",
        "x_um", "y_um", "pxl_row_in_fullres", "pxl_col_in_fullres",
        F.coalesce("has_nuclear_annotation", F.lit(False)).alias("has_nuclear_annotation"),
        "dominant_cell_id", "dominant_cell_type",
        F.coalesce("dominant_weight", F.lit(0.0)).alias("dominant_weight"),
        zero("total_nuclear_pixel_count"), zero("max_nuclear_pixel_count"), zero("n_cell_claims"),
        F.coalesce("ambiguous_nuclear_assignment", F.lit(False)).alias("ambiguous_nuclear_assignment"),
        F.coalesce("max_weight", F.lit(0.0)).alias("max_weight"))


def barcodes_without_position(barcodes: DataFrame, positions: DataFrame) -> DataFrame:
    return barcodes.join(positions, "barcode", "left_anti")


def check_positions(barcodes: DataFrame, positions: DataFrame) -> None:
    """Raise when a barcode has no position."""
    bad = barcodes_without_position(barcodes.select("barcode"), positions).limit(1).collect()
    if bad:
        raise ValueError(f"no position for barcode {bad[0].barcode!r}")


def check_overlap(labels: DataFrame, bins: DataFrame, name: str) -> None:
    """Raise when no labelled barcode is among the bins."""
    if labels.select("barcode").join(bins.select("barcode"), "barcode", "left_semi").isEmpty():
        raise ValueError(f"{name} has no barcode in common with the bins")


def with_column_index(claims: DataFrame, metadata: DataFrame) -> DataFrame:
    return claims.join(metadata.select("barcode", "matrix_col_index"), "barcode")


def matrix_with_positions(expression: DataFrame, positions: DataFrame) -> DataFrame:
    """Bins present in both the matrix and the positions; empty overlap is the caller's error."""
    return positions.join(expression.select("barcode").distinct(), "barcode", "left_semi")


def nuclear_label_per_bin(external: DataFrame, keep: str = "last", order: str = "ordinal") -> DataFrame:
    """One label per barcode from nuclear rows of an external table (keep first or last row)."""
    rows = external.filter(coerce_bool(F.col("is_nuclear"))).withColumn("cell_id", normalize_cell_id(F.col("cell_id")))
    rows = rows.filter("cell_id is not null and barcode is not null")
    pick = F.max_by if keep == "last" else F.min_by
    return rows.groupBy("barcode").agg(pick("cell_id", F.col(order)).alias("cell_id"))


def dense_label_codes(labels: DataFrame, column: str = "cell_id") -> DataFrame:
    """Integer code per label: the label itself if all are positive integers, else its rank.

    Ranks number digit-only labels first, then the rest, both as text.
    """
    distinct = labels.select(column).distinct()
    bad = distinct.filter(~F.col(column).rlike(r"^\d+$") | (F.col(column).cast("long") <= 0)).limit(1).count()
    if not bad:
        return distinct.select(column, F.col(column).cast("long").alias("label_id"))
    keyed = distinct.withColumn("_nd", ~F.col(column).rlike(r"^\d+$"))
    return ordinal(keyed, ["_nd", column], "label_id", start=1).select(column, "label_id")


def inject_labels(bins: DataFrame, labels: DataFrame, codes: DataFrame) -> DataFrame:
    """Every bin with its nuclear label code, 0 where it has none; labels that meet no bin are an error."""
    check_overlap(labels, bins, "external labels")
    coded = labels.join(codes, "cell_id").select("barcode", "label_id")
    return bins.join(coded, "barcode", "left").withColumn("label_id", F.coalesce("label_id", F.lit(0)))


def force_nuclear(assigned: DataFrame, seed: str, cell: str, out: str) -> DataFrame:
    """Seed labels override the assigned cell."""
    return assigned.withColumn(out, F.coalesce(F.col(seed), F.col(cell)))


def combine_labels(bins: DataFrame, primary: str, secondary: str) -> DataFrame:
    """Primary label, gaps filled by the secondary one, with the source of each."""
    p, s = F.nullif(F.col(primary), F.lit(0)), F.nullif(F.col(secondary), F.lit(0))
    return bins.select("*", F.coalesce(p, s, F.lit(0)).alias("labels_joint"),
                       F.when(p.isNotNull(), "primary").when(s.isNotNull(), "secondary").otherwise("none").alias("labels_joint_source"))


def filter_and_relabel(cells: DataFrame, confidence: str, threshold: float) -> DataFrame:
    """Keep confident cells and number them 1..n in id order."""
    kept = cells.filter(F.col(confidence) >= threshold)
    return ordinal(kept, ["cell_id"], "new_id", start=1)


def confidence_stats(cells: DataFrame, confidence: str, median: DataFrame) -> DataFrame:
    from ..functions.scalars import attach_scalars
    base = cells.agg(F.count("*").alias("n_cells"), F.avg(confidence).alias("mean"), F.min(confidence).alias("min"),
                     F.max(confidence).alias("max"), F.count_if(F.col(confidence) >= 0.8).alias("n_ge_08"),
                     F.count_if(F.col(confidence) >= 0.9).alias("n_ge_09"))
    return attach_scalars(base, median)


def assignment_summary(assignments: DataFrame) -> DataFrame:
    """Per-cell totals, centroid and most common source (smallest source on ties)."""
    by_source = assignments.groupBy("cell_id", "source").agg(F.count("*").alias("n"))
    mode = by_source.groupBy("cell_id").agg(F.min_by("source", F.struct((-F.col("n")).alias("neg"), "source")).alias("main_source"))
    agg = assignments.groupBy("cell_id").agg(
        F.count("*").alias("total_bins"), F.sum(F.col("is_nuclear").cast("long")).alias("nuclear_bins"),
        F.avg("array_row").alias("centroid_row"), F.avg("array_col").alias("centroid_col"))
    return agg.join(mode, "cell_id").select(
        "*", (F.col("total_bins") - F.col("nuclear_bins")).alias("cytoplasm_bins"),
        (F.col("nuclear_bins") / F.col("total_bins")).alias("nuclear_ratio"),
        (F.col("nuclear_bins") / F.col("total_bins") * 100.0).alias("nuclear_percentage"))


def spot_composition(shares: DataFrame, tolerance: float = 1.0e-4) -> DataFrame:
    """Renormalised cell shares per spot; ``sum_ok`` is false where the shares do not add to 1."""
    totals = shares.groupBy("barcode").agg(F.sum("share").alias("_sum"))
    return shares.join(totals, "barcode").select(
        "barcode", "cell_id", (F.col("share") / F.col("_sum")).alias("share"),
        (F.abs(F.col("_sum") - 1.0) <= tolerance).alias("sum_ok"))


def dominant_by_share(composition: DataFrame) -> DataFrame:
    """Cell with the largest share per spot; the larger id wins a tie."""
    return composition.groupBy("barcode").agg(F.max(F.struct("share", "cell_id")).alias("_m")).select(
        "barcode", F.col("_m.cell_id").alias("cell_id"), F.col("_m.share").alias("dominant_probability"))


def signal_levels(claims: DataFrame, bins: DataFrame, quantile: DataFrame | None = None) -> DataFrame:
    """Summed nuclear signal per bin on a log scale, clipped at its 99th percentile, as 0-255."""
    from ..functions.ordered import exact_quantiles
    from ..functions.scalars import attach_scalars
    per_bin = claims.groupBy("barcode").agg(F.sum("nuclear_pixel_count").alias("nuclear_signal"))
    logged = bins.select("barcode").join(per_bin, "barcode", "left").select(
        "barcode", F.coalesce("nuclear_signal", F.lit(0)).alias("nuclear_signal"),
        F.log1p(F.coalesce(F.col("nuclear_signal"), F.lit(0)).cast("double")).alias("_log"))
    q = quantile if quantile is not None else exact_quantiles(logged.filter("_log > 0"), [], "_log", {"_vmax": 0.99})
    scaled = F.least(F.greatest(F.col("_log") / F.greatest(F.coalesce("_vmax", F.lit(1.0)), F.lit(1.0e-8)), F.lit(0.0)), F.lit(1.0))
    return attach_scalars(logged, q).select("barcode", "nuclear_signal", F.rint(scaled * 255.0).cast("int").alias("level"))
