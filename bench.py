"""Headline queries, timed end to end (plan building, intermediate tables, full result).

env: BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import time

from dialoggraph.plans import catalog
from dialoggraph.session import build_session

HEADLINE = [
    "turns_profile", "client_turn_number", "recent_exchanges", "transcript_view", "evidence_window", "chunk_ranges",
    "rule_candidates", "valence_temporality", "parsed_candidates", "atomised", "jaccard_pairs", "greedy_merge",
    "merged_nodes", "folded_props", "entity_components", "anchor_lists", "asserted_edges", "orphans", "retry_set",
    "reframe_best", "edge_validation", "class_rollup", "phase_entry_turns", "phase_timeline", "technique_carry",
    "list_quotes", "list_filtered", "describe_first5", "trace_nodes", "summarize_chain", "overlay_nodes", "op_replay",
    "branch_timeline", "graph_roundtrip", "guard_entities", "guard_clean", "turn_stream", "guard_stream", "built_graph",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the workers
    times, failed = {}, {}
    for name in HEADLINE:
        t0 = time.time()
        try:
            catalog.QUERIES[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
