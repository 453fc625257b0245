"""Growth of all cells, patch by patch, and one assignment per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import growth as gr, scoring as sc
from ..session import write_stage
from .preprocess import Tables


def run(tables: Tables, weights: sc.Weights = sc.Weights(), max_steps: int = 1000, min_score: float = 0.0, score: gr.ScoreFunction | None = None) -> DataFrame:
    """Step and owner rows of every patch; core cells come first in patch order."""
    order = F.when(F.col("role") == "core", 0).otherwise(1 << 40) + F.col("cell_id")
    placed = tables.patch_members.select("patch_id", "cell_id", order.alias("cell_rank")).join(tables.context, "cell_id")
    return write_stage(gr.grow_patches(placed, weights, max_steps, min_score, score), "grown")


def assignments(grown: DataFrame, tables: Tables) -> DataFrame:
    """Bins of each cell from the patch where it is core and holds most bins (earlier patch on ties)."""
    rows = gr.assignment_rows(gr.final_owners(grown), tables.patch_members, tables.context, "patch_growth")
    sizes = rows.groupBy("cell_id", "patch_id").agg(F.count("*").alias("n"))
    best = sizes.groupBy("cell_id").agg(F.min_by("patch_id", F.struct((-F.col("n")).alias("m"), "patch_id")).alias("patch_id"))
    return rows.join(best, ["cell_id", "patch_id"], "left_semi")
