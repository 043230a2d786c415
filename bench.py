"""Headline queries, timed warm: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "vote_directory c03_asof_latest c03_asof_in_stream c07_overlap_inclusive c11_clip_three_ways d18_bill_vote_summaries d19_vote_coverage_summaries "
    "d20_member_activity d21_entity_search_index d22_derived_group_totals d23_agreement_with_group d38_conflict_preserving e03_runs e06_coalesce_touching "
    "f04_distinct_on g04_reconciliation i01_components k07_vote_by_non_sitting n_composition_on_date j06_sections"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from tallyloom.plans import registry
    from tallyloom.session import local_session

    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    found, seconds = registry.queries(), {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    sys.exit(main())
