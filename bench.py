"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from termweave.plans import catalogue  # noqa: E402
from termweave.runtime import build_session  # noqa: E402

HEADLINE = (
    "staging_rebuild",
    "profile_observations",
    "load_metadata",
    "bridge_valid_mappings",
    "concept_view",
    "mapping_view",
    "mapping_statistics",
    "fold_mappings",
    "fold_mappings_without_dialect",
    "apply_requests",
    "concept_worklist",
    "progress_summary",
    "candidate_dictionary",
    "candidates_exact",
    "destination_groups",
    "mapping_history",
    "table_sort",
    "search_totals",
    "descendant_counts",
    "combine",
    "facets",
    "search_by_concept",
    "order_descriptions",
    "references_by_type",
    "product_ingredients",
    "definition_expression",
    "integrity_audit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or HEADLINE
    spark = build_session(
        "termweave-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    timings = {}
    for name in chosen:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
