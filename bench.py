"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores. Each query runs
once on a warm session, and its whole result is computed.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from patchloom.checks.registry import QUERIES  # noqa: E402
from patchloom.session import build_session  # noqa: E402

HEADLINE = [
    "d6_merged_chunks", "e1_diff_features", "e2_feature_vector", "e3_test_coverage",
    "e4_history_risk", "risk_band_counts", "r6_file_focus_areas", "r8_snippet_risk", "c6_prompts",
    "f7_file_routes", "i2_located_findings", "i5_grouped_findings", "i9_run_reports",
    "m2_commit_samples", "m3_capped_samples", "m10_evaluation", "f3_event_filter", "t2_admissions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": str(int(cpus) * 2), "spark.driver.memory": "12g",
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    warm = Path(sf_dir).parent / "sf0.001"
    if warm.exists():
        QUERIES["e1_diff_features"](spark, str(warm)).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


main()
