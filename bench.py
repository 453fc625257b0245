"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Queries run in workflow order in one session. A stage table is written by the first query
that needs it and read by later ones, as the jobs of the workflow hand over files; its cost
is counted once, in that first query. With BENCH_COLD=1 stage tables are forgotten before
every query, so that each time covers its whole lineage. Results are fully written to a
sink that drops them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cellweave.catalog.registry import runner  # noqa: E402
from cellweave.session import build_session  # noqa: E402
from cellweave.workspace import forget_workspaces  # noqa: E402
import cellweave.catalog  # noqa: E402,F401

HEADLINE = (
    "j1_pixel_to_bin", "a1_compartment_counts", "j3_bin_metadata", "a4_nuclei", "j5_candidate_radius_join", "j6_nearest_other_nucleus",
    "a6_reference_counts", "a8_bin_log_likelihood", "g3_neighbour_support", "g9_add_score", "g12_state_summary", "g17_competition_margin",
    "g19_objective_deltas", "g16_growth_summary", "g20_fill_target", "j13_nuclear_match_truth", "a22_overlap_metrics", "a23_gene_agreement",
    "a24_patch_metrics", "a16_hull_and_solidity", "j16_tile_membership", "w8_advantages", "w13_owner_at_step", "st1_streaming_nuclei",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    runner("s1_table_scan")(spark, sf_dir).write.format("noop").mode("overwrite").save()
    cold = os.environ.get("BENCH_COLD") == "1"
    times: dict[str, float] = {}
    for name in HEADLINE:
        if cold:
            forget_workspaces()
        start = time.perf_counter()
        runner(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
