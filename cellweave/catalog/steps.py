"""How the named tables of a dataset are derived, from sources to stage tables."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from .. import fixtures
from ..functions.scalars import attach_scalars
from ..operators import claims, expression as ex, grid, nuclei, spatial_join as sj
from ..workspace import Workspace, step

# Parameters shared by queries and oracles.
MPP = 0.5
MIN_CELLS_PER_TYPE = 20
EPSILON = 1.0e-8
R_MAX_UM = 20.0
CONFIDENCE_PSEUDOCOUNT = 5.0
GENE_EXPRESSION = "Gene Expression"


# derived inputs that several steps read are written once, as the source files they stand for
for _name, _inputs in (("tissue_positions", ("part",)), ("sc_expression", ("orders", "lineitem")), ("sc_metadata", ("customer",)),
                       ("gt_cell_bins", ("pixels",)), ("pred_assignments", ("pixels",))):
    step(_name, stored=_name == "sc_expression")(lambda ws, n=_name, i=_inputs: fixtures.fixture(ws.spark, n, {k: ws[k] for k in i}))


@step("expression", stored=True)
def _expression(ws: Workspace):
    return fixtures.expression(ws["lineitem"])


@step("pixels", stored=True)
def _pixels(ws: Workspace):
    return fixtures.fixture(ws.spark, "pixels", {"lineitem": ws["lineitem"]})


@step("step_log", stored=True)
def _step_log(ws: Workspace):
    return fixtures.step_log(ws.spark, ws["events"])


@step("footprints")
def _footprints(ws: Workspace):
    return grid.bin_footprints(ws["tissue_positions"])


@step("crop_bins", stored=True)
def _crop_bins(ws: Workspace):
    return grid.crop_bins(ws["footprints"])


@step("crop_rectangle", stored=True)
def _crop_rectangle(ws: Workspace):
    return grid.crop_rectangle(ws["crop_bins"])


@step("crop_relative")
def _crop_relative(ws: Workspace):
    return grid.crop_relative(ws["crop_bins"], ws["crop_rectangle"])


@step("positions_um")
def _positions_um(ws: Workspace):
    return grid.to_microns(ws["tissue_positions"], MPP)


@step("assigned_pixels")
def _assigned(ws: Workspace):
    return grid.assign_pixels(ws["pixels"], grid.bins_by_bucket(ws["crop_relative"]), ws["crop_rectangle"]).withColumn("cell_type", F.lit(None).cast("string"))


@step("pixel_counts", stored=True)
def _pixel_counts(ws: Workspace):
    return claims.with_bin_metadata(claims.pixel_counts(ws["assigned_pixels"]), ws["positions_um"])


@step("compartments")
def _compartments(ws: Workspace):
    return claims.split_compartments(ws["pixel_counts"])


@step("nuclear_claims")
def _nuclear_claims(ws: Workspace):
    return claims.filter_claims(ws["compartments"], nuclear_only=True)


@step("barcodes")
def _barcodes(ws: Workspace):
    return ex.ordered_barcodes(ws["tissue_positions"], "bin_ordinal")


@step("bin_metadata", stored=True)
def _bin_metadata(ws: Workspace):
    return claims.bin_metadata(ws["barcodes"], ws["positions_um"].drop("bin_ordinal"),
                               claims.claims_by_barcode(ws["nuclear_claims"]))


@step("nuclei", stored=True)
def _nuclei(ws: Workspace):
    return nuclei.nuclei_table(nuclei.nucleus_moments(ws["pixels"]), ws["crop_rectangle"], MPP)


@step("candidates", stored=True)
def _candidates(ws: Workspace):
    bins = ws["bin_metadata"].select("barcode", "matrix_col_index", "array_row", "array_col", "x_um", "y_um")
    return sj.candidate_bins(ws["nuclei"], bins, R_MAX_UM)


@step("genes", stored=True)
def _genes(ws: Workspace):
    typed = F.when(F.col("gene") < "G45", GENE_EXPRESSION).otherwise("Antibody Capture")
    return ex.gene_dictionary(ws["expression"], typed)


@step("selected_genes")
def _selected(ws: Workspace):
    return ex.select_features(ws["genes"], GENE_EXPRESSION)


@step("typed_cells", stored=True)
def _typed(ws: Workspace):
    return ex.typed_cells(ws["sc_metadata"], ws["sc_expression"], MIN_CELLS_PER_TYPE)


@step("reference_counts", stored=True)
def _reference_counts(ws: Workspace):
    return ex.reference_counts(ws["sc_expression"], ws["typed_cells"], ws["selected_genes"])


def types_of(ws: Workspace) -> list[str]:
    if not hasattr(ws, "types"):
        ws.types = ex.type_list(ws["typed_cells"])
    return ws.types


@step("theta", stored=True)
def _theta(ws: Workspace):
    return ex.log_theta(ws["reference_counts"], ws["selected_genes"], types_of(ws), EPSILON)


@step("bin_ll", stored=True)
def _bin_ll(ws: Workspace):
    k = len(types_of(ws))
    ll = ex.bin_likelihoods(ws["expression"], ws["theta"], k)
    return ex.complete_bins(ws["tissue_positions"].select("barcode"), ll, k, CONFIDENCE_PSEUDOCOUNT)


from ..operators import patches as pt, scoring as sc  # noqa: E402

WEIGHTS = sc.Weights()
COMPETITION_UM = 15.0
PATCH = dict(size=64.0, stride=32.0, core=48.0, min_core=1, min_cells=1, max_cells=64)


@step("context", stored=True)
def _context(ws: Workspace):
    return sc.build_context(ws["candidates"], ws["bin_metadata"], ws["bin_ll"], WEIGHTS)


@step("cells", stored=True)
def _cells(ws: Workspace):
    """Initial state: every cell holds its seeds."""
    return sc.cell_states(ws["context"], ws["context"].filter("is_seed"), ["cell_id"], len(types_of(ws)))


@step("state")
def _state(ws: Workspace):
    # one join away from the context and wider than it, hence not written
    return sc.with_raw_terms(sc.with_cell_states(ws["context"], ws["cells"], ["cell_id"]))


@step("scored", stored=True)
def _scored(ws: Workspace):
    """Raw terms with their statistics, which are one value per cell; terms and score follow row by row."""
    # likelihood arrays have served the raw terms and are not carried further
    slim = ws["state"].drop("ll", "ll_sum", "conf_ll_sum", "posterior", "conf_sum", "base_sum", "p_dis")
    return sc.with_term_statistics(slim, ["cell_id"], "is_frontier")


@step("scores")
def _scores(ws: Workspace):
    return sc.scores_from_statistics(ws["scored"].withColumn("p_dis", F.col("dist_um") / WEIGHTS.r_max_um), WEIGHTS)


@step("ll_features")
def _ll_features(ws: Workspace):
    return sc.likelihood_features(ws["context"], ["cell_id"])


def patches_of(ws: Workspace):
    if not hasattr(ws, "patch_pair"):
        ws.patch_pair = pt.build_patches(ws["nuclei"], **PATCH)
    return ws.patch_pair


@step("patches", stored=True)
def _patches(ws: Workspace):
    return patches_of(ws)[0]


@step("patch_members", stored=True)
def _patch_members(ws: Workspace):
    return patches_of(ws)[1]


_BOX = ("outer_x_min", "outer_x_max", "outer_y_min", "outer_y_max")


def inside_box() -> Column:
    return F.col("x_um").between(F.col(_BOX[0]), F.col(_BOX[1])) & F.col("y_um").between(F.col(_BOX[2]), F.col(_BOX[3]))


def boxed_members(ws: Workspace):
    return ws["patch_members"].select("patch_id", "cell_id", "role").join(ws["patches"].select("patch_id", *_BOX), "patch_id")


def placed_rows(ws: Workspace, rows):
    """``rows`` of the scored candidates in every patch of their cell, with their legality.

    Only frontier rows can be legal, and of these the ones that another cell holds are a short list per
    cell, from one join by bin. A patch's own cells decide which of them count, before rows meet their
    patches: legality needs no exchange of patch rows.
    """
    holders = ws["scored"].filter("is_assigned").groupBy("barcode").agg(F.collect_set("cell_id").alias("holders"))
    held = ws["scored"].filter("is_frontier").select("cell_id", "barcode").join(holders, "barcode").groupBy("cell_id").agg(F.collect_set(F.struct("barcode", "holders")).alias("_held"))
    patch = Window.partitionBy("patch_id")
    members = boxed_members(ws).withColumns({"_cells": F.collect_set("cell_id").over(patch), "n_cells": F.count("*").over(patch), "cell_rank": F.row_number().over(patch.orderBy("cell_id")) - 1})
    met = F.transform(F.filter("_held", lambda h: F.arrays_overlap(h["holders"], F.col("_cells"))), lambda h: h["barcode"])
    blocked = members.join(held, "cell_id", "left").select("patch_id", "cell_id", "role", "n_cells", "cell_rank", *_BOX, met.alias("_blocked"))
    # the members of a task are few: looked up without ordering the candidate rows
    free = ~F.coalesce(F.array_contains("_blocked", F.col("barcode")), F.lit(False))
    return rows.join(blocked.hint("shuffle_hash"), "cell_id").withColumn("is_legal", F.col("is_frontier") & inside_box() & free).drop(*_BOX, "_blocked")


def patch_rows(ws: Workspace, needed: Column):
    """Candidate rows of every patch with their legality, dealt by patch.

    ``needed`` keeps the rows that a query of legal bins asks for; it has to keep frontier and
    assigned rows. Rows outside of the patch's box go with the others, as no cell has a legal bin there.
    """
    # raw terms do not depend on the patch: they are read where they are written
    state = ws["scored"].select("cell_id", "barcode", "matrix_col_index", "x_um", "y_um", "dist_um", "is_seed", "is_assigned", "is_frontier",
                                "support", "base_penalty", "gain_raw", "compat_raw", "bin_total").filter(needed)
    placed = boxed_members(ws).join(state, "cell_id").filter(inside_box()).drop(*_BOX)
    # dealt by patch, the owners of a bin and the statistics of a cell need no other exchange; a bin has at most the patch's cells
    owned = F.bool_or("is_assigned").over(Window.partitionBy("patch_id", "barcode"))
    return placed.repartition("patch_id").withColumn("_owned", owned).withColumn("is_legal", F.col("is_frontier") & ~F.col("_owned")).drop("_owned")


def scored_rows(rows):
    return sc.add_scores(rows, ["patch_id", "cell_id"], WEIGHTS, "is_legal")


# patch rows are several times the candidate rows: not written, each query exchanges the columns and rows it reads
@step("patch_legal")
def _patch_legal(ws: Workspace):
    """Legal rows with their scores, dealt by patch."""
    frontier = ws["scored"].filter("is_frontier").select("cell_id", "barcode", "matrix_col_index", "x_um", "y_um", "is_frontier", "support", "base_penalty", "gain_raw", "compat_raw")
    return scored_rows(placed_rows(ws, frontier).filter("is_legal").drop("x_um", "y_um").repartition("patch_id"))


@step("patch_near")
def _patch_near(ws: Workspace):
    """Rows that decide on legal bins, and the rows within the radius of competitors; every legal row with its score is among them."""
    return scored_rows(patch_rows(ws, F.col("is_frontier") | F.col("is_assigned") | sc.within(COMPETITION_UM)))
