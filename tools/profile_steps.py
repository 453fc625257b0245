"""Time every stored step of a dataset once, in dependency order: python tools/profile_steps.py 0.1"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import cellweave.catalog  # noqa: E402,F401
from cellweave import workspace as wsm  # noqa: E402
from cellweave.session import build_session  # noqa: E402


def main() -> None:
    spark = build_session(8, "profile")
    spark.sparkContext.setLogLevel("ERROR")
    ws = wsm.workspace(spark, f"/root/testdata/sf{sys.argv[1]}")
    original = wsm.write_stage

    def timed(df, label):
        start = time.perf_counter()
        out = original(df, label)
        print(f"write {label:20s} {time.perf_counter() - start:6.2f}s rows={out.count()}", flush=True)
        return out

    wsm.write_stage = timed
    for name, (_, stored) in list(wsm._STEPS.items()):
        if stored:
            start = time.perf_counter()
            ws[name]
            print(f"  step {name:20s} {time.perf_counter() - start:6.2f}s", flush=True)


if __name__ == "__main__":
    main()
