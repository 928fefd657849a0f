"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.  Every
query is run once untimed (first use compiles its code) and then timed while
its whole result is written to a no-op sink.  The one row group of ``documents``
is dealt over all cores (``evistrata.documents.tasks``); that shuffle is timed too.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evistrata.plans import all_queries  # noqa: E402
from evistrata.plans.registry import DOCUMENT_TASKS  # noqa: E402
from evistrata.session import local_session  # noqa: E402

HEADLINE = (
    "a2_merge_duplicates", "j8_match_extractions", "a1_collection_coverage", "p10_screen", "w1_latest_decisions",
    "w2_previous_decision", "j11_u4_completeness", "j13_eligibility_required", "w7_sections_and_windows", "w12_evidence_pack",
    "w6_merge_ranges", "j21_p27_validated_quotes", "j21_p28_prefix_quotes", "j24_reference_issues", "p24_p25_normalized_findings",
    "a7_leading_dimension", "w5_reingest_opened", "a8_j9_evidence_matrix", "a9_a10_contradiction_groups", "j14_section_selection",
    "a14_w10_evidence_memos", "j17_contradiction_omissions", "a25_linkage_status", "j22_relevant_documents", "a18_audit_roll_up",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "evistrata-bench", int(cpus) if cpus.isdigit() else 8)
    spark.conf.set(DOCUMENT_TASKS, str(spark.sparkContext.defaultParallelism))
    queries = all_queries()
    seconds = {}
    for name in names:
        for timed in (False, True):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
