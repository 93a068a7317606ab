"""Time the headline queries: one warm-up, then the median of three runs each.

Prints one JSON line.  ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "flow_messages_to_snapshot": "flow_messages_to_snapshot",
    "decode_messages": "src_02_apply_ums_schema",
    "left_lookup": "jon_02_lookup_left",
    "snapshot": "cdc_02_snapshot",
    "apply_changes": "cdc_06_apply_changes",
    "split_table_plan": "cdc_08_plan_split_upsert",
    "union_lookup": "set_01_union_lookup",
    "grouped_aggregates": "agg_01_grouped",
    "tumbling_window": "stm_04_tumbling_window",
    "tumbling_window_stream": "stm_02_ascending_watermark_stream",
    "strict_pattern": "cep_03_next",
    "quantifier_pattern": "cep_08_oneormore",
    "encode_messages": "snk_04_to_ums_packing",
    "encode_flat_json": "snk_05_flat_json",
}


def main() -> None:
    from changeloom.catalog import QUERIES
    from changeloom.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for label, name in HEADLINE.items():
        run(name)
        times[label] = round(statistics.median(run(name) for _ in range(3)), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
