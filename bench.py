"""Headline queries at one scale; prints a single JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "usage_fractional_v",
    "facet_counts",
    "vj_pairs_fractional",
    "select_motif_iupac",
    "collapse_trimmed",
    "collapse_rearrangement",
    "lineage_assign",
    "lineage_sample_counts",
    "query_hamming",
    "shm_weighted_quantiles",
    "site_support",
    "quality_trim",
)


def main() -> None:
    from clonespark.plans.catalog import QUERIES
    from clonespark.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": cpus},
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    QUERIES["usage_top"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not timed
    times: dict[str, float] = {}
    for name in wanted:
        begin = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    spark.stop()
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
