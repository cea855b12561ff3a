"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each query runs once to
warm up and then BENCH_RUNS times (default 1); the median counts. `python bench.py all` times every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moltraj.plans.queries import REGISTERED  # noqa: E402
from moltraj.session import local_session  # noqa: E402

HEADLINE = [
    "plan_summary", "residue_topology", "unfolded_filter", "backbone_torsions", "virtual_cb", "torsion_coherence", "f16_quantize",
    "trajectory_hash", "dataset_hash_tree", "split_assignment", "roundtrip_rmsd", "random_windows", "window_rows",
    "frame_cap_offsets", "frame_features", "lagged_pairs", "lagged_covariance", "tica_embedding", "kmeans_labels", "residue_sasa",
    "contact_graph", "positive_pairs", "state_discovery", "transition_matrix", "auroc_by_domain", "paired_bootstrap",
    "budgeted_selection", "active_runs",
]


def timed(spark, name: str, folder: str) -> float:
    begun = time.perf_counter()
    REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = list(REGISTERED) if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    seconds = {}
    for name in names:
        timed(spark, name, folder)
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
