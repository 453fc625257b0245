"""Pixels, grid, counts and reference cells to bin metadata, nuclei, candidates and scored state."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators import claims, expression as ex, grid, nuclei as nu, patches as pt, scoring as sc, spatial_join as sj
from ..schema import DEFAULT_MICRONS_PER_PIXEL, TISSUE_POSITIONS, check_quality, quality_report, require_columns
from ..session import write_stage


@dataclass
class Tables:
    """Stage tables of one slide."""

    bin_metadata: DataFrame
    nuclei: DataFrame
    candidates: DataFrame
    context: DataFrame
    patches: DataFrame
    patch_members: DataFrame
    genes: DataFrame
    cell_types: list[str] = field(default_factory=list)


def bin_tables(pixels: DataFrame, positions: DataFrame, microns_per_pixel: float) -> tuple[DataFrame, DataFrame]:
    """(bin metadata, nuclei). ``positions`` needs a ``bin_ordinal`` giving file order."""
    require_columns(positions, [f.name for f in TISSUE_POSITIONS] + ["bin_ordinal"], "tissue positions")
    # one row per barcode, which the joins below rely on, and usable coordinates
    check_quality(quality_report(positions, ["barcode"], ["array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres"]), "tissue positions")
    cropped = write_stage(grid.crop_bins(grid.bin_footprints(positions)), "crop_bins")
    rect = write_stage(grid.crop_rectangle(cropped), "crop_rectangle")
    buckets = grid.bins_by_bucket(grid.crop_relative(cropped, rect))
    typed = pixels if "cell_type" in pixels.columns else pixels.withColumn("cell_type", F.lit(None).cast("string"))
    um = grid.to_microns(positions, microns_per_pixel)
    counts = write_stage(claims.with_bin_metadata(claims.pixel_counts(grid.assign_pixels(typed, buckets, rect)), um), "pixel_counts")
    nuclear = claims.filter_claims(claims.split_compartments(counts), nuclear_only=True)
    meta = claims.bin_metadata(ex.ordered_barcodes(positions, "bin_ordinal"), um.drop("bin_ordinal"), claims.claims_by_barcode(nuclear))
    table = nu.nuclei_table(nu.nucleus_moments(pixels), rect, microns_per_pixel)
    meta, table = write_stage(meta, "bin_metadata"), write_stage(table, "nuclei")
    check_quality(quality_report(table, ["cell_id"], ["center_x_um", "center_y_um", "radius_um"], ["radius_um"]), "nuclei")
    return meta, table


def run(pixels: DataFrame, positions: DataFrame, expression: DataFrame, sc_expression: DataFrame, sc_metadata: DataFrame,
        genes: DataFrame | None = None, microns_per_pixel: float = DEFAULT_MICRONS_PER_PIXEL, radius_um: float = 20.0, band_um: float | None = None,
        min_cells_per_type: int = 50, epsilon: float = 1.0e-8, pseudocount: float = 5.0, weights: sc.Weights = sc.Weights(),
        patch_um: float = 64.0, stride_um: float = 32.0, core_um: float = 48.0, max_patch_cells: int = 64) -> Tables:
    claims.check_positions(expression, positions)
    meta, nuc = bin_tables(pixels, positions, microns_per_pixel)
    bins = meta.select("barcode", "matrix_col_index", "array_row", "array_col", "x_um", "y_um")
    discs = write_stage(sj.candidate_bins(nuc, bins, radius_um), "candidates")
    cand = discs if band_um is None else sj.in_band(discs, band_um)
    if genes is None:
        genes = ex.gene_dictionary(expression, F.lit("Gene Expression"))
    genes = write_stage(genes, "genes")
    typed = write_stage(ex.typed_cells(sc_metadata, sc_expression, min_cells_per_type), "typed_cells")
    types = ex.type_list(typed)
    if not types:
        raise ValueError(f"no cell type has {min_cells_per_type} cells")
    counts = write_stage(ex.reference_counts(sc_expression, typed, genes), "reference_counts")
    theta = write_stage(ex.log_theta(counts, genes, types, epsilon), "theta")
    ll = ex.complete_bins(positions.select("barcode"), ex.bin_likelihoods(expression, theta, len(types)), len(types), pseudocount)
    context = write_stage(sc.build_context(cand, meta, write_stage(ll, "bin_ll"), weights, discs), "context")
    patches, members = pt.build_patches(nuc, patch_um, stride_um, core_um, max_cells=max_patch_cells)
    return Tables(meta, nuc, cand, context, write_stage(patches, "patches"), write_stage(members, "patch_members"), genes, types)
