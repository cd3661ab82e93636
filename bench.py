"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scholia.queries import all_queries
from scholia.session import local_session

HEADLINE = [
    "q_match_status", "q_title_candidates", "q_similarity_join", "q_clue_candidates",
    "q_filename_clues", "q_leaves", "q_stats_sections", "q_value_counts", "q_repair_json",
    "q_normalise_tex", "q_title_scored", "q_html_text", "q_assemble_pages", "q_pair_captions",
    "q_rate_audit", "q_skip_completed", "q_merge_state", "q_enrich",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    runs, seconds = all_queries(), {}
    # start the JVM, the Python workers and the code generator before timing
    runs["q_run_batch"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
