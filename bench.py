"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores. Each
query runs once to warm up and three times for its median, plan building included;
results are computed in full and discarded.
"""

import json
import os
import statistics
import sys
import tempfile
import time

from pagequarry.catalog import QUERIES
from pagequarry.session import builder

HEADLINE = [
    "a6_url_join", "a8_snapshot_cache", "a9_robots_gate", "a10_fetch_slots", "b1_tag_counts", "b5_leaf_text",
    "b6_subtree_text", "c1_table_extract", "c6_record_fields", "c8_flat_extract", "c13_dispatch_mode",
    "c15_css_descendant", "c16_flat_selector", "c17_row_scoped", "c18_single_record", "d1_positional_concat",
    "d4_next_link", "d5_walk", "d7_follow_urls", "d8_follow_join", "e7_shape", "f1_classify", "f2_infer",
    "f7_profile", "g2_csv_roundtrip", "h1_stream_extract", "h3_compact_actions", "i4_induce_selectors",
    "c12_merge_identical_cols", "d5_indexed_walk", "d6_paginated_extract", "i2_site_routing", "i2_many_sites",
    "i3_job_spec", "i3_pipeline", "i5_broaden",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    n = int(cpus) if cpus.isdigit() else 8
    spark = (
        builder(f"local[{cpus}]", shuffle_partitions=n, input_partitions=n)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(3)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
             "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
