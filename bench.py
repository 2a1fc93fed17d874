"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from evospark.plans.catalog import QUERIES  # noqa: E402
from evospark.session import build_session  # noqa: E402

HEADLINE = [
    "scored_top10", "score_against_wt", "score_against_medians", "experiment_kpis", "distribution_summary",
    "top10_with_totals", "enriched_top10", "performance_rankings", "domain_enrichment", "mutation_frequency",
    "cooccurrence_edges", "lineage_closure", "cumulative_trajectory", "nearest_index_edges", "delimited_scan",
    "record_quality", "cross_record_findings", "upsert_variants", "merge_latest", "variant_cds", "mutation_calls",
    "sequence_run", "idw_surface", "json_scan", "typed_cells", "json_number_variants", "pca_points", "sequence_network_nodes",
    "introduction_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "evospark-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM paths before the clock runs.
    QUERIES["scored_top10"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
